"""Structured Streaming extensions: keep-first dedup, windows, resumable appends and ranking snapshots.

The streams read a landing folder of Parquet files, run until it is exhausted
(available-now trigger) and keep their progress in a checkpoint, so that a
restart continues where the last run ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landing(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_batch: int = 100) -> DataFrame:
    """Stream of a folder's Parquet files; ``ts`` becomes a timestamp, as watermarks need one."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        r = r.option("pathGlobFilter", glob)
    s = r.parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def keep_first(stream: DataFrame, keys: list[str], ts: str = "ts", within: str = "30 days") -> DataFrame:
    """First row of each key inside the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, key: str, value: str, width: str = "1 day", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Count and sum of each key and window; late rows up to ``late`` are counted."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", F.round("total", 4).alias("total"))


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Append everything available now; a second run appends only what is new."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def run_snapshots(stream: DataFrame, path: str, checkpoint: str) -> str:
    """A whole result table for every batch (rankings and the like), each in a folder of its own; returns the last one's.

    A batch that fails or runs again touches its own folder alone, so the result before it stays readable.
    """
    last = [f"{path}/batch=0"]

    def put(df: DataFrame, batch_id: int) -> None:
        last[0] = f"{path}/batch={batch_id}"
        df.write.mode("overwrite").parquet(last[0])

    stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return last[0]
