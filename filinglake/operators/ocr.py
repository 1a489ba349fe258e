"""Recognised regions of scanned pages put back together: regions in reading order to pages, pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGIONS_A_PIECE = 1000


def _in_order(order: str | Column, value: str, sep: str) -> Column:
    held = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.array_join(F.transform(held, lambda x: x[value]), sep)


def pages_of_regions(regions: DataFrame, per_piece: int = REGIONS_A_PIECE) -> DataFrame:
    """(stem, page, piece, markdown, n_regions, missing) of (stem, page, region, task, content).

    Regions of task ``abandon`` do not count. Those of task ``skip`` are figures without text. Any other region without content was not
    recognised: it is named in ``missing`` as page and region, in order. Of several rows of a region the one with most content counts, the
    last by value of equally long ones. A piece has at most ``per_piece`` regions, so that no row grows with a page.
    """
    real = regions.filter(~F.col("task").eqNullSafe("abandon"))
    best = F.max(F.struct(F.length("content").alias("n"), "content"))["content"]
    one = real.groupBy("stem", "page", "region").agg(best.alias("content"), F.bool_and(F.col("task").eqNullSafe("skip")).alias("skipped"))
    text = F.when(F.trim("content") != "", F.trim("content"))
    lost = F.when(F.col("content").isNull() & ~F.col("skipped"), F.concat(F.lit("p"), F.col("page"), F.lit("r"), F.col("region")))
    rows = one.select("stem", "page", (F.floor(F.col("region") / per_piece)).cast("int").alias("piece"), "region", text.alias("text"), lost.alias("lost"))
    return rows.groupBy("stem", "page", "piece").agg(_in_order("region", "text", "\n\n").alias("markdown"), F.count(F.lit(1)).alias("n_regions"), _in_order("region", "lost", " ").alias("missing"))


def documents_of_pages(pages: DataFrame, files: DataFrame, per_piece: int = 50) -> DataFrame:
    """(stem, part, markdown, n_pages, n_empty, missing) of every file (stem, n_pages): its pages in order, ``per_piece`` of them a part.

    A page without text takes no place in the markdown and counts as empty. A file without a recognised region has no part at all, as after
    a run that failed: ``unfinished`` names those.
    """
    part = F.floor(F.col("page") / per_piece).cast("int")
    text = F.when(F.col("markdown") != "", F.col("markdown"))
    lost = F.when(F.col("missing") != "", F.col("missing"))
    order = F.struct("page", "piece").alias("at")
    rows = pages.select("stem", part.alias("part"), "page", order, text.alias("text"), lost.alias("lost"))
    joined = rows.groupBy("stem", "part").agg(_in_order("at", "text", "\n\n").alias("markdown"), F.countDistinct(F.when(F.col("text").isNotNull(), F.col("page"))).alias("__full"), _in_order("at", "lost", " ").alias("missing"))
    parts = files.filter("n_pages > 0").select("stem", "n_pages", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_pages") - 1) / per_piece).cast("int"))).alias("part"))
    here = F.least(F.lit(per_piece), F.col("n_pages") - F.col("part") * per_piece)
    known = parts.join(rows.select("stem").distinct(), "stem", "left_semi").select("stem", "part", here.cast("long").alias("n_pages"))
    full = F.coalesce("__full", F.lit(0))
    return known.join(joined, ["stem", "part"], "left").select("stem", "part", F.coalesce("markdown", F.lit("")).alias("markdown"), "n_pages", (F.col("n_pages") - full).alias("n_empty"), F.coalesce("missing", F.lit("")).alias("missing"))


def unfinished(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Files of which no region came back."""
    return files.join(pages.select("stem").distinct(), "stem", "left_anti").select("stem")
