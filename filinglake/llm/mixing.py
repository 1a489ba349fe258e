"""Mixing sources to target weights by Poisson replication, in SQL expressions only.

A source of n rows and target share s of T output rows has repetition rate
s*T/n. Each document's count is the inverse of the Poisson distribution with
that mean at a uniform number hashed from the seed and the document's id, so
counts do not depend on partitions, retries or other documents. Documents are
exploded by their counts and dealt out by a hash of (seed, id, copy), which
shuffles the whole output.

A null source is a source of its own; sources without a stated weight have
``default_weight``; weights at or below 0 remove a source. A row without an id
goes by a digest of its text. Rows of equal id get equal counts. Null, empty
and very long texts are moved as they are. Empty tables give empty results.
Input columns named copy, rate or shuffle_key are replaced where those are
asked for, and kept otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglake.llm._shared import by_name, by_position, staged

MEAN_STEP = 500.0  # a larger mean is split over several draws, so that exp() does not underflow


def uniform(*parts: Column) -> Column:
    """Number in (0, 1) with 48 bits, from the MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def poisson_cdf(mean: Column) -> Column:
    """Array of P(X <= k), k = 0, 1, … until the rest is below double precision."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["c"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", default_weight: float = 1.0, target_rows: int | None = None) -> DataFrame:
    """One row a source: __source (null-safe key), n, rate, draws and cdf (of one draw)."""
    counts = staged(docs.groupBy(_key(source_col).alias("__source"), F.col(source_col).alias("__name")).agg(F.count(F.lit(1)).alias("n")), "source-counts")
    weight = F.lit(float(default_weight))
    if weights:
        stated = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        weight = F.coalesce(F.when(F.col("__name").isNotNull(), F.try_element_at(stated, F.col("__name"))), weight)
    counts = counts.withColumn("weight", F.greatest(weight, F.lit(0.0)))
    total = counts.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    rows, whole = float(target_rows if target_rows is not None else total["n"] or 0), float(total["w"] or 0)
    rate = F.lit(rows) * F.col("weight") / F.lit(whole or 1.0) / F.col("n")
    out = counts.select("__source", "n", rate.alias("rate"))
    out = out.withColumn("draws", F.greatest(F.ceil(F.col("rate") / MEAN_STEP), F.lit(1)).cast("int"))
    return out.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws")))


def _key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", default_weight: float = 1.0, target_rows: int | None = None, seed: int = 42, text_col: str = "text", figures: bool = True) -> DataFrame:
    """Replicated and shuffled documents: the input's columns and, with ``figures``, copy (from 0), rate and shuffle_key."""
    given, (docs, at) = docs, by_position(docs)
    id_col, source_col, text_col = at(id_col), at(source_col), at(text_col)
    rates = source_rates(docs, weights, source_col, default_weight, target_rows)
    # a row a source: adaptive execution broadcasts it if its measured size allows, else joins by shuffle
    joined = docs.withColumn("__source", _key(source_col)).join(rates.select("__source", F.col("rate").alias("__rate"), F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf")), "__source")
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null-"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    draw = lambda j: F.size(F.filter(F.col("__cdf"), lambda c: c < uniform(F.lit(seed), name, j)))
    one = F.size(F.filter(F.col("__cdf"), lambda c: c < F.col("__u")))
    more = F.aggregate(F.sequence(F.lit(1), F.col("__draws") - 1), F.lit(0), lambda a, j: a + draw(j))
    counted = joined.withColumn("__u", uniform(F.lit(seed), name, F.lit(0))).withColumn("__n", F.when(F.col("__draws") > 1, one + more).otherwise(one))
    copies = counted.filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"shuffle:{seed}"), name, F.col("__copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    out = copies.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key")
    made = {"copy": "__copy", "rate": "__rate", "shuffle_key": "__key"} if figures else {}
    return out.select(*by_name(given, list(made)), *[F.col(c).alias(n) for n, c in made.items()])
