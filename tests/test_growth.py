"""Growth whose rounding decides: figures next to nought and on halves, against the SQL and DuckDB's round()."""

import datetime
import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from filinglake.functions import numbers
from filinglake.plans import catalogue
from tests.compare import differences


def test_rounding_is_that_of_duckdb_to_the_sign_of_nought(spark):
    r = random.Random(4)
    near = lambda x: (math.nextafter(x, -9), x, math.nextafter(x, 9))
    values = [s * v for s in (1.0, -1.0) for v in (0.0, 3e-7, 4.9e-5, 2.5, 1e12, 0.49999999999999994e-6, math.inf, *(x for k in range(400) for d in (4, 6) for x in near((r.randrange(10 ** r.randint(1, 7)) + 0.5) / 10**d)), *(r.uniform(0, 4) for _ in range(400)))]
    con = duckdb.connect()
    for digits in (4, 6):
        want = [con.execute(f"SELECT round(?::DOUBLE, {digits})", [v]).fetchone()[0] for v in values]
        got = [x.y for x in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(numbers.rounded(numbers.F.col("x"), digits).alias("y")).collect()]
        assert [(repr(v), repr(a)) for v, a, b in zip(values, got, want) if repr(a) != repr(b)] == []
    odd = spark.createDataFrame([(math.nan,), (None,)], "x double").select(numbers.rounded(numbers.F.col("x"), 6).alias("y")).collect()
    assert math.isnan(odd[0].y) and odd[1].y is None


@pytest.mark.parametrize("name", ["growth_unweighted", "growth_weighted", "growth_ranked", "growth_summary"])
@pytest.mark.parametrize("late", [[102000.0, 202000.0], [102000.02, 202000.0], [102000.01, 202000.0], [107000.0, 212000.0]])
def test_growth_next_to_nought_has_the_sign_of_its_sql(spark, tmp_path, name, late):
    early = [102000.01, 202000.0]
    day = [datetime.datetime(1996, 1, 1), datetime.datetime(2000, 1, 1)]
    orders = [(k, 7, day[k]) for k in (0, 1)]
    lines = [(k, 1, 1, n + 1, price, "R", "F") for k, prices in enumerate((early, late)) for n, price in enumerate(prices)]
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string(), pa.string()
    table = lambda names, kinds, rows: pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names.split())
    pq.write_table(table("o_orderkey o_custkey o_orderdate", (pa.int64(), pa.int64(), pa.timestamp("us")), orders), tmp_path / "orders.parquet")
    pq.write_table(table("l_orderkey l_partkey l_suppkey l_linenumber l_extendedprice l_returnflag l_linestatus", kinds, lines), tmp_path / "lineitem.parquet")
    assert differences(catalogue.QUERIES[name](spark, str(tmp_path)), catalogue.ORACLES[name], str(tmp_path)) == ""
