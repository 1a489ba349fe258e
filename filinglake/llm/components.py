"""Connected components of a link table by alternating stars, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglake.llm._shared import discard, spread_join, staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link with the least node that it reaches.

    Large star: hang a node's greater neighbours on its least neighbour; small
    star: hang its lesser neighbours and itself there. Minima come from partial
    aggregation and meet the links of a hub in many tasks, and the number of
    rounds grows with the logarithm of the longest chain. Null ends and
    self-links are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"u > v and {a} is not null and {b} is not null").distinct()
    edges, state = staged(edges, "edges"), (None, None)
    total = edges.count()
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = spread_join(both, low, ["u"], F.col("n"), 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = staged(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, low, ["u"], F.col("n"), 2 * total).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        before, edges = edges, staged(small.filter("u > v").distinct(), "edges")
        discard(before)
        discard(large)
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("sum(xxhash64(u, v)::decimal(38,0))")).first())
        if now == state:
            break
        state, total = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
