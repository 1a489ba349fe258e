"""Streaming extensions over events, run to the end of the input and returned as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglake.session import shared_dir
from filinglake.streaming import events as S


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return S.landing(spark, sf, schema, glob="events.parquet")


def _paths(spark: SparkSession) -> tuple[str, str]:
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def ext_stream_dedup(spark, sf):
    """Keys of events seen first; any one row stands for a key."""
    out, state = _paths(spark)
    S.run_to_parquet(S.keep_first(_stream(spark, sf), ["user_id", "event_type"]).select("user_id", "event_type"), out, state)
    return spark.read.parquet(out)


def ext_tumbling(spark, sf):
    """Daily counts and sums by type, in complete mode."""
    out, state = _paths(spark)
    last = S.run_snapshots(S.tumbling(_stream(spark, sf), "event_type", "value"), out, state)
    return spark.read.parquet(last).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def ext_ranking_snapshot(spark, sf):
    """Users by the number of events, as a table replaced after every batch."""
    out, state = _paths(spark)
    last = S.run_snapshots(_stream(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), out, state)
    return spark.read.parquet(last).orderBy(F.desc("n"), "user_id").limit(20)


def ext_sessions(spark, sf):
    """Sessions of each user with gaps under 6 hours, whole (batch form of the streaming operator)."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (ext_stream_dedup, ext_tumbling, ext_ranking_snapshot, ext_sessions)}
ORACLES = {
    "ext_stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "ext_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "ext_ranking_snapshot": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20",
    "ext_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS c FROM n GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(c) AS longest FROM c GROUP BY 1""",
}
