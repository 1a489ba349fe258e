"""Column functions in Python hold a few rows at a time."""

import pytest
from pyspark.sql import functions as F

from filinglake.operators import sites, tagging


def wide(x):
    import resource

    return f"{resource.getrusage(resource.RUSAGE_SELF).ru_maxrss}:".ljust(200_000, "x")


def test_results_leave_before_a_batch_is_done(spark):
    rows = spark.range(3000, numPartitions=1).select(F.substring(tagging.text_udf(wide)(F.col("id").cast("string")), 1, 20).alias("s"))
    assert max(int(r.s.partition(":")[0]) for r in rows.collect()) < 500_000  # KB; all results of a batch are 600 MB


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_values_and_nulls_keep_their_rows(spark, n):
    rows = spark.range(n, numPartitions=2).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("<p>"), "id", F.lit("</p>"))).alias("h"))
    got = rows.select("id", sites.filing_text()("h").alias("f"), sites.sanitized()("h").alias("s"), sites.added_lines(F.lit("a"), F.concat_ws("\n", F.lit("a"), "id")).alias("a")).collect()
    assert sorted((r.id, r.f.text, r.s is None, r.a) for r in got) == [(k, str(k) if k % 3 else None, k % 3 == 0, str(k)) for k in range(n)]
