"""Per-domain page manifest: filter, dedup by crawl priority, rank, cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filinglake.functions import urls

PAGE_CAP = 20


def top_k_per_group(df: DataFrame, keys: list, order: list, k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows of each group; Spark plans this as a group limit before and after the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    return top_k_per_group(df, keys, order, 1, "_first").drop("_first")


def select_pages(index: DataFrame, cap: int = PAGE_CAP, tie: Column | None = None) -> DataFrame:
    """Manifest of at most ``cap`` pages a domain: best crawl of each normalised URL, shallow pages first.

    ``index`` has url, domain, crawl and a tie-break column (page_id unless given).
    """
    tie = F.col("page_id") if tie is None else tie
    url = F.col("url")
    kept = (
        index.filter(url.isNotNull() & ~urls.is_excluded(url))
        .withColumn("norm_url", urls.normalized(url))
        .withColumn("depth", urls.depth(url))
    )
    best = keep_first(kept, ["domain", "norm_url"], [urls.crawl_rank(F.col("crawl")), tie])
    html_first = F.when(F.lower(urls.path(url)).rlike(r"\.html?$"), 0).otherwise(1)
    return top_k_per_group(best, ["domain"], ["depth", html_first, urls.path(url), tie], cap, "page_rank")
