"""Queries over crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglake.functions import urls
from filinglake.operators import manifest, sites
from filinglake.operators.corpus import concat_pages, ranked, ranked_in
from filinglake.session import ship_package, table, written


def crawl_index(spark: SparkSession, sf: str) -> DataFrame:
    """pages as a crawl index: the crawl follows from page_id."""
    crawl = F.element_at(F.array(*map(F.lit, urls.CRAWL_PRIORITY)), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", "url", urls.domain(F.col("url")).alias("domain"), crawl.alias("crawl"))


def manifest_select(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.select_pages(crawl_index(spark, sf)).select("domain", "page_rank", "page_id", "url", "crawl", "depth")


def manifest_sql_variant(spark, sf):
    """The declarative twin: lower-case path keys, depth by segments, a domain list, order by depth and path."""
    u = F.col("url")
    wanted = table(spark, sf, "pages").select(urls.domain(u).alias("domain")).filter(~F.col("domain").contains("casino")).distinct()
    base = crawl_index(spark, sf).filter(u.isNotNull() & ~u.endswith(".txt") & ~urls.is_junk(u)).join(wanted, "domain", "left_semi")
    base = base.withColumn("norm_path", urls.norm_path(u)).withColumn("depth", urls.segment_count(u))
    best = manifest.keep_first(base, ["domain", "norm_path"], [urls.crawl_rank(F.col("crawl")), "page_id"])
    out = manifest.top_k_per_group(best, ["domain"], ["depth", "norm_path", "page_id"], manifest.PAGE_CAP, "page_rank")
    return out.select("domain", "norm_path", "depth", "page_rank", "page_id", "url", "crawl").orderBy("domain", "page_rank")


def manifest_nested(spark, sf):
    """One row a domain: its pages in rank order."""
    m = manifest_select(spark, sf)
    held = F.array_sort(F.collect_list(F.struct("page_rank", "url")))
    return m.groupBy("domain").agg(F.count(F.lit(1)).alias("n_pages"), F.array_join(F.transform(held, lambda x: x["url"]), " ").alias("urls"))


def url_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.slug(F.col("url")).alias("slug"))


def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.domain(u).alias("domain"), urls.depth(u).alias("depth"), urls.segment_count(u).alias("segments"), urls.normalized(u).alias("norm_url"), urls.norm_path(u).alias("norm_path"), urls.is_excluded(u).alias("excluded"))


def registered_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", sites.registered_domain(F.col("url")).alias("registered"))


def domain_blocklist(spark, sf):
    """Candidate domains less those in the manifest and those blocked."""
    d = table(spark, sf, "pages").select(urls.domain(F.col("url")).alias("domain"))
    have = manifest_select(spark, sf).filter("page_id % 2 = 0").select("domain").distinct()
    blocked = d.filter(F.col("domain").rlike("casino|adult|bets")).distinct()
    return d.distinct().join(have, "domain", "left_anti").join(blocked, "domain", "left_anti")


def statuses(spark, sf):
    s = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("ok: "), "event_type")).when(F.col("event_type") == "signup", "skipped").otherwise(F.concat(F.lit("failed: "), "event_type"))
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("domain"), s.alias("status"))


def fetch_status_rollup(spark, sf):
    """Pages in use and in all of each domain, and whether it must be fetched (again)."""
    known = statuses(spark, sf).groupBy("domain").agg(F.count_if(F.col("status").rlike("^(ok|skipped)")).alias("n_ok"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status").rlike("^(ok|skipped)")).alias("usable"))
    return known.select("domain", "n_ok", "n", (~F.col("usable")).alias("needs_fetch"))


def outcome_counts(spark, sf):
    """Outcomes by the text before the colon, most common first."""
    return statuses(spark, sf).groupBy(F.substring_index("status", ":", 1).alias("outcome")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "outcome")


def dedup_keep_first(spark, sf):
    return manifest.keep_first(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("event_id", "user_id", "event_type", "value")


def page_usability(spark, sf):
    """Pages fetched well, whose event says so, with enough text; a page without an event is not usable."""
    ok = statuses(spark, sf).filter(F.col("status").rlike("^(ok|skipped)")).select(F.col("event_id").alias("page_id")).distinct()
    return table(spark, sf, "pages").filter(F.length("html") >= 50).join(ok, "page_id", "left_semi").select("page_id", F.length("html").alias("n"))


def nearest_ancestor(spark, sf):
    """Nearest existing page on the path above (5 levels at most), else the page before in (depth, path) order."""
    p = table(spark, sf, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"), F.regexp_replace(urls.path(F.col("url")), "/+$", "").alias("path"))
    parents = p.filter("page_id % 3 = 0").select((F.col("page_id") + 1000000).alias("page_id"), "domain", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"))
    return sites.reference_pages(p.unionByName(parents), "page_id", "domain", "path")


def added_lines(spark, sf):
    """Lines of each document that the one before it in the source does not have, by line difference."""
    ship_package(spark)
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    # places without texts first, then each document meets the text before it
    at = ranked(d.select("source", "doc_id"), "source", "doc_id")
    link = at.join(at.select("source", (F.col("rank") + 1).alias("rank"), F.col("doc_id").alias("before")), ["source", "rank"], "left").select("doc_id", "before")
    prev = d.join(link, "doc_id").join(d.select(F.col("doc_id").alias("before"), F.col("text").alias("ref")), "before", "left")
    return prev.select("doc_id", sites.added_lines(F.coalesce("ref", F.lit("")), F.coalesce("text", F.lit(""))).alias("added"))


TAGS = r"<([a-z][a-z0-9]*)"


def dom_counts(spark, sf):
    return sites.tag_counts(table(spark, sf, "pages"))


def tag_entropy(spark, sf):
    names = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(TAGS), 1)).alias("tag")).groupBy("page_id", "tag").count()
    total = names.groupBy("page_id").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log2("count")).alias("s"), F.count(F.lit(1)).alias("unique_tags"))
    return total.select("page_id", "unique_tags", F.round(F.log2("n") - F.col("s") / F.col("n"), 4).alias("entropy"))


def domain_stats_merge(spark, sf):
    d = table(spark, sf, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))
    return sites.merge_counts(dom_counts(spark, sf).join(d, "page_id"), "domain")


def dom_stats(spark, sf):
    ship_package(spark)
    return table(spark, sf, "pages").select("page_id", sites.dom_stats()(F.col("html")).alias("s")).select("page_id", "s.*")


def dom_stats_by_domain(spark, sf):
    ship_package(spark)
    d = table(spark, sf, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"), sites.dom_stats()(F.col("html")).alias("s")).select("page_id", "domain", "s.*")
    return sites.combine_stats(d, "domain", "page_id")


def html_markdown(spark, sf):
    ship_package(spark)
    return table(spark, sf, "pages").select("page_id", sites.markdown()(F.col("html")).alias("markdown"))


def sanitize_html(spark, sf):
    ship_package(spark)
    return table(spark, sf, "pages").select("page_id", sites.sanitized()(F.col("html")).alias("html"))


def filing_text(spark, sf):
    ship_package(spark)
    return table(spark, sf, "pages").select("page_id", sites.filing_text()(F.col("html")).alias("s")).select("page_id", "s.text", F.size("s.tables").alias("n_tables"))


def _order_tables(spark, sf):
    o = table(spark, sf, "orders")
    html = F.concat(F.lit("<table><tr><th colspan=2>Total</th><th>$</th></tr><tr><td rowspan='2'>"), "o_orderkey", F.lit("</td><td>$ ("), "o_custkey", F.lit("</td><td>) %</td></tr><tr><td>"), "o_totalprice", F.lit("</td></tr></table>"))
    return o.select("o_orderkey", html.alias("html"))


def table_grid(spark, sf):
    """(row, col, content) of every cell of a table under its spans."""
    ship_package(spark)
    return _order_tables(spark, sf).select("o_orderkey", F.explode(sites.grid()(F.col("html"))).alias("c")).select("o_orderkey", "c.*")


def table_repair(spark, sf):
    ship_package(spark)
    return _order_tables(spark, sf).select("o_orderkey", sites.repaired()(F.col("html")).alias("html"))


def _page_tables(spark, sf):
    """The links of each page as a table: address and label, labels over up to three columns, every other address of an even label over two rows."""
    ship_package(spark)
    held = lambda k: F.regexp_extract_all("html", F.lit(r'<li><a href="([^"]*)">([^<]*)</a>'), k)
    links = F.arrays_zip(held(1).alias("href"), held(2).alias("label"))

    def row(x, i):
        tall = F.when((i % 2 == 0) & (F.length(x["label"]) % 2 == 0), F.lit(' rowspan="2"')).otherwise(F.lit(""))
        return F.concat(F.lit("<tr><td"), tall, F.lit(">"), x["href"], F.lit('</td><td colspan="'), F.length(x["label"]) % 3 + 1, F.lit('">'), x["label"], F.lit("</td></tr>"))

    rows = F.array_join(F.transform(links, row), "")
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("<table>"), rows, F.lit("</table>")).alias("html"))


def page_table_grid(spark, sf):
    """(row, col, content) of every cell of the link table of every page."""
    return _page_tables(spark, sf).select("page_id", F.explode(sites.grid()(F.col("html"))).alias("c")).select("page_id", "c.*")


def page_table_repair(spark, sf):
    """The link table of every page with pushed rows put back, needless columns gone and cells split."""
    return _page_tables(spark, sf).select("page_id", sites.repaired()(F.col("html")).alias("html"))


PATH = r"regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"
HOST = r"regexp_extract(url, '^[^:]+://([^/?#]*)', 1)"
DOMAIN = rf"regexp_replace(lower({HOST}), '^www\.', '')"
STEM = f"regexp_replace({PATH}, '/+$', '')"
JUNK = "|".join(urls.JUNK_SUBSTRINGS)
CRAWLS = "[" + ", ".join(f"'{c}'" for c in urls.CRAWL_PRIORITY) + "]"
DEPTH = f"length({STEM}) - length(replace({STEM}, '/', ''))"
NORM = rf"regexp_extract(url, '^([^:]+)://', 1) || '://' || {DOMAIN} || CASE WHEN {STEM} = '' THEN '/' ELSE {STEM} END"
INDEX = f"SELECT page_id, url, {DOMAIN} AS domain, {CRAWLS}[page_id % 4 + 1] AS crawl, page_id % 4 AS crawl_rank FROM pages"

MANIFEST_BASE = f"""SELECT *, {NORM} AS norm_url, {DEPTH} AS depth, {PATH} AS p FROM ({INDEX}) WHERE url IS NOT NULL AND NOT (lower({PATH}) LIKE '%.txt') AND NOT regexp_matches(lower(url), '{JUNK}')"""
SEGS = f"len(list_filter(string_split({PATH}, '/'), lambda x: x <> ''))"
NORM_PATH = f"lower(regexp_replace({PATH}, '/$', ''))"
STATUS = "SELECT event_id, user_id AS domain, CASE WHEN event_type IN ('view', 'click') THEN 'ok: ' || event_type WHEN event_type = 'signup' THEN 'skipped' ELSE 'failed: ' || event_type END AS status FROM events"
COUNTS = "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}[ >]')) AS n_{t}" for t in sites.COUNTED) + ", strlen(html) AS n_bytes FROM pages"

QUERIES = {f.__name__: f for f in (
    manifest_select, manifest_sql_variant, manifest_nested, url_slug, url_parts, registered_domain, domain_blocklist, fetch_status_rollup, outcome_counts, dedup_keep_first, page_usability, nearest_ancestor, added_lines,
    dom_counts, tag_entropy, domain_stats_merge, dom_stats, dom_stats_by_domain, html_markdown, sanitize_html, filing_text, table_grid, table_repair, page_table_grid, page_table_repair,
)}
ORACLES = {
    "page_table_grid": r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages),
r AS (SELECT page_id, unnest(h) AS href, unnest(t) AS label, generate_subscripts(h, 1) - 1 AS i FROM l),
p AS (SELECT *, coalesce(i % 2 = 1 AND length(lag(label) OVER (PARTITION BY page_id ORDER BY i)) % 2 = 0, false)::INT AS first FROM r)
SELECT page_id, i::INT AS row, unnest([first, first + 1])::INT AS col, unnest([trim(href, ' '), trim(label, ' ')]) AS content FROM p""",
    "manifest_select": rf"""
WITH base AS (
  SELECT *, {NORM} AS norm_url, {DEPTH} AS depth, {PATH} AS p FROM ({INDEX})
  WHERE url IS NOT NULL AND NOT (lower({PATH}) LIKE '%.txt') AND NOT regexp_matches(lower(url), '{JUNK}')),
best AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY domain, norm_url ORDER BY crawl_rank, page_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY depth,
  CASE WHEN regexp_matches(lower(p), '\.html?$') THEN 0 ELSE 1 END, p, page_id) AS page_rank FROM best)
SELECT domain, page_rank, page_id, url, crawl, depth FROM ranked WHERE page_rank <= 20""",
    "manifest_sql_variant": f"""
WITH wanted AS (SELECT DISTINCT {DOMAIN} AS domain FROM pages WHERE NOT contains({DOMAIN}, 'casino')),
base AS (SELECT *, {NORM_PATH} AS norm_path, {SEGS} AS depth FROM ({INDEX}) WHERE url IS NOT NULL AND NOT (url LIKE '%.txt') AND NOT regexp_matches(lower(url), '{JUNK}') AND domain IN (SELECT domain FROM wanted)),
deduped AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY domain, norm_path ORDER BY crawl_rank, page_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY depth, norm_path, page_id) AS page_rank FROM deduped)
SELECT domain, norm_path, depth, page_rank, page_id, url, crawl FROM ranked WHERE page_rank <= 20""",
    "url_slug": rf"""SELECT page_id, CASE WHEN s = '' THEN 'index' WHEN length(s) > 200 THEN left(s, 200) || '_' || left(md5(s), 12) ELSE s END AS slug
FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({PATH}, '^/+|/+$', '', 'g'), '(?i)\.(html?|php|aspx?|jsp|cfm|do)$', ''), '/', '__'), '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)""",
    "url_parts": f"SELECT page_id, {DOMAIN} AS domain, {DEPTH} AS depth, {SEGS} AS segments, {NORM} AS norm_url, {NORM_PATH} AS norm_path, (lower({PATH}) LIKE '%.txt' OR regexp_matches(lower(url), '{JUNK}')) AS excluded FROM pages",
    "registered_domain": f"SELECT page_id, regexp_extract(lower({HOST}), '([^.]+\\.[^.:]+)(?::[0-9]+)?$', 1) AS registered FROM pages",
    "domain_blocklist": f"""WITH base AS ({MANIFEST_BASE}), best AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY domain, norm_url ORDER BY crawl_rank, page_id) = 1),
m AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY domain ORDER BY depth, CASE WHEN regexp_matches(lower(p), '\\.html?$') THEN 0 ELSE 1 END, p, page_id) <= 20)
SELECT DISTINCT {DOMAIN} AS domain FROM pages WHERE {DOMAIN} NOT IN (SELECT domain FROM m WHERE page_id % 2 = 0) AND NOT regexp_matches({DOMAIN}, 'casino|adult|bets')""",
    "fetch_status_rollup": f"""WITH s AS ({STATUS}) SELECT domain, count(*) FILTER (regexp_matches(status, '^(ok|skipped)')) AS n_ok, count(*) AS n,
  count(*) FILTER (regexp_matches(status, '^(ok|skipped)')) = 0 AS needs_fetch FROM s GROUP BY domain""",
    "outcome_counts": f"SELECT split_part(status, ':', 1) AS outcome, count(*) AS n FROM ({STATUS}) GROUP BY 1",
    "dedup_keep_first": "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "page_usability": f"SELECT page_id, length(html) AS n FROM pages WHERE length(html) >= 50 AND page_id IN (SELECT event_id FROM ({STATUS}) WHERE regexp_matches(status, '^(ok|skipped)'))",
    "dom_counts": COUNTS,
    "tag_entropy": r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages), c AS (SELECT page_id, tag, count(*) AS c FROM t GROUP BY 1, 2), n AS (SELECT *, sum(c) OVER (PARTITION BY page_id) AS n FROM c)
SELECT page_id, count(*) AS unique_tags, round(-sum(c / n * log2(c / n)), 4) AS entropy FROM n GROUP BY page_id""",
    "domain_stats_merge": f"WITH c AS ({COUNTS}), d AS (SELECT c.*, {DOMAIN} AS domain FROM c JOIN pages USING (page_id)) SELECT domain, count(*) AS n_pages, " + ", ".join(f"sum(n_{t})::BIGINT AS n_{t}" for t in sites.COUNTED) + ", sum(n_bytes)::BIGINT AS n_bytes, max(n_bytes) AS max_bytes, bool_or(n_script > 0) AS has_script, round(sum(n_a) / nullif(sum(n_p), 0), 4) AS links_per_p, round(avg(n_bytes), 4) AS mean_bytes FROM d GROUP BY domain",
    "nearest_ancestor": rf"""
WITH p0 AS (SELECT page_id, {DOMAIN} AS domain, {STEM} AS path FROM pages),
p AS (SELECT * FROM p0 UNION ALL SELECT page_id + 1000000, domain, regexp_extract(path, '^(.*)/[^/]*$', 1) FROM p0 WHERE page_id % 3 = 0),
u AS (SELECT domain, path, min(page_id) AS ref FROM p WHERE path <> '' GROUP BY 1, 2),
a AS (SELECT page_id, domain, unnest(range(1, 6)) AS lvl, string_split(path, '/') AS s FROM p),
c AS (SELECT page_id, domain, lvl, array_to_string(s[1:len(s) - lvl], '/') AS anc FROM a WHERE len(s) - lvl >= 2),
f AS (SELECT c.page_id, arg_min(u.ref, lvl) AS ancestor FROM c JOIN u ON c.domain = u.domain AND c.anc = u.path GROUP BY c.page_id),
w AS (SELECT *, lag(page_id) OVER (PARTITION BY domain ORDER BY length(path) - length(replace(path, '/', '')), path, page_id) AS prev FROM p)
SELECT w.page_id, w.domain, coalesce(f.ancestor, w.prev) AS ref_id, f.ancestor IS NOT NULL AS is_ancestor FROM w LEFT JOIN f USING (page_id)""",
}
ORACLES["manifest_nested"] = f"SELECT domain, count(*) AS n_pages, string_agg(url, ' ' ORDER BY page_rank) AS urls FROM ({ORACLES['manifest_select']}) GROUP BY domain"


def page_keys(spark, sf):
    """Hierarchical key of a page: host without www and path. The index's mime column is dropped before output."""
    p = crawl_index(spark, sf).withColumn("mime", F.lit("text/html")).drop("mime")
    return p.withColumn("key", F.concat("domain", urls.path(F.col("url"))))


def page_texts(spark, sf):
    """The site pipeline in one query: pages to Markdown, in order of depth and path, each less the lines of the page it hangs on, joined to one text a domain and piece of 100 pages."""
    ship_package(spark)
    u = F.col("url")
    p = written(table(spark, sf, "pages").select("page_id", urls.domain(u).alias("domain"), F.regexp_replace(urls.path(u), "/+$", "").alias("path"), urls.depth(u).alias("depth"), "url", sites.markdown()(F.col("html")).alias("markdown")), "page-texts")
    refs = sites.reference_pages(p.select("page_id", "domain", "path"), "page_id", "domain", "path").select("page_id", "ref_id")
    above = p.select(F.col("page_id").alias("ref_id"), F.col("markdown").alias("above"))
    own = p.join(refs, "page_id").join(above, "ref_id", "left").withColumn("own", sites.added_lines(F.coalesce("above", F.lit("")), F.coalesce("markdown", F.lit(""))))
    seq = ranked_in(p.select("page_id", "domain", "depth", "path"), "domain", "depth", "path", "page_id", rank="seq").select("page_id", "seq")
    placed = own.select("page_id", "domain", "url", "own").join(seq, "page_id")
    return concat_pages(placed.withColumn("piece", F.floor(F.col("seq") / 100)), ["domain", "piece"], "seq", "url", "own")


QUERIES |= {f.__name__: f for f in (page_keys, page_texts)}
ORACLES["page_keys"] = f"SELECT page_id, url, domain, crawl, domain || {PATH} AS key FROM ({INDEX})"


#: A few rules of the public suffix list; a deployment passes the whole list as a table.
SUFFIXES = ("com", "net", "org", "io", "example", "co.uk", "org.uk", "uk", "*.ck", "!www.ck")


def registered_by_list(spark, sf):
    """Registered domains by a public suffix table."""
    rules = spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    return sites.registered_by_list(table(spark, sf, "pages").select("page_id", "url"), "url", rules).select("page_id", "registered")


QUERIES["registered_by_list"] = registered_by_list
ORACLES["registered_by_list"] = rf"""WITH h AS (SELECT page_id, string_split(regexp_extract(lower({HOST}), '^(?:[^@]*@)?([^:]*)', 1), '.') AS l FROM pages), r AS (SELECT unnest({list(SUFFIXES)!r}) AS s),
k AS (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM h), e AS (SELECT page_id, k, array_to_string(l[len(l) - k + 1:], '.') AS e FROM k),
m AS (SELECT page_id, max(CASE WHEN s LIKE '!%' THEN k - 1 END) AS c, max(CASE WHEN s LIKE '*.%' THEN k + 1 WHEN s NOT LIKE '!%' THEN k END) AS g FROM e JOIN r ON e = regexp_replace(s, '^(\*\.|!)', '') GROUP BY page_id),
n AS (SELECT page_id, l, coalesce(c, g, 1) AS n FROM h LEFT JOIN m USING (page_id)) SELECT page_id, CASE WHEN len(l) > n THEN array_to_string(l[len(l) - n:], '.') END AS registered FROM n"""
