"""URL and path scalars as Column builders (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings that mark a page as non-content.
JUNK_SUBSTRINGS = (
    "privacy", "terms", "conditions", "certificate", "bylaws", "legal", "cookie", "disclaimer", "copyright",
    "sitemap", "accessibility", "gdpr", "compliance", "unsubscribe", "preferences", "settings", "login", "signup",
    "register", "forgot-password", "reset-password", "404", "error", "search", "tag/", "wp-admin", "wp-content",
)

# Crawl snapshots in order of preference.
CRAWL_PRIORITY = ("CC-MAIN-2018-05", "CC-MAIN-2017-51", "CC-MAIN-2018-09", "CC-MAIN-2018-13")

PATH_PATTERN = r"^[^:]+://[^/?#]*([^?#]*)"
HOST_PATTERN = r"^[^:]+://([^/?#]*)"


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH_PATTERN, 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, HOST_PATTERN, 1)


def domain(url: Column) -> Column:
    """Lower-case host without a leading ``www.``."""
    return F.regexp_replace(F.lower(host(url)), r"^www\.", "")


def is_junk(url: Column) -> Column:
    return F.lower(url).rlike("|".join(JUNK_SUBSTRINGS))


def is_excluded(url: Column) -> Column:
    return F.lower(path(url)).endswith(".txt") | is_junk(url)


def depth(url: Column) -> Column:
    """Slashes of the path after its closing slashes are cut; 0 for an empty path."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def segment_count(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def normalized(url: Column) -> Column:
    p = F.regexp_replace(path(url), "/+$", "")
    return F.concat(F.regexp_extract(url, r"^([^:]+)://", 1), F.lit("://"), domain(url), F.when(p == "", "/").otherwise(p))


def norm_path(url: Column) -> Column:
    return F.lower(F.regexp_replace(path(url), "/$", ""))


#: File endings that a slug leaves out.
PAGE_ENDINGS = r"(?i)\.(html?|php|aspx?|jsp|cfm|do)$"


def slug(url: Column) -> Column:
    """File-name form of a path; long ones keep 200 characters and a digest of the whole."""
    p = F.regexp_replace(path(url), "^/+|/+$", "")
    p = F.regexp_replace(p, PAGE_ENDINGS, "")
    p = F.regexp_replace(F.regexp_replace(p, "/", "__"), "[^A-Za-z0-9_-]", "_")
    p = F.regexp_replace(F.regexp_replace(p, "_+", "_"), "^_+|_+$", "")
    return (
        F.when(p == "", "index")
        .when(F.length(p) > 200, F.concat(F.substring(p, 1, 200), F.lit("_"), F.substring(F.md5(p), 1, 12)))
        .otherwise(p)
    )


def crawl_rank(crawl: Column) -> Column:
    out = F.when(crawl == CRAWL_PRIORITY[0], 0)
    for i, name in enumerate(CRAWL_PRIORITY[1:], 1):
        out = out.when(crawl == name, i)
    return out.otherwise(4)
