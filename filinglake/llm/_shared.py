"""Folders and written tables that every executor can see, and joins that spread hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglake.session import note, shared_dir

HOT = 1000  # a key with more than one row in so many is hot; there are fewer than HOT such keys


def _hadoop_path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(sc._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    note(spark, path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for made in scratch.open[-1:]:
        made.tables.append(out)
    return out


class scratch:
    """Tables staged inside the block are deleted at its end, but for those that are kept."""

    open: list[scratch] = []

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> scratch:
        self.open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables = [t for t in self.tables if t is not df]
        return df

    def __exit__(self, *_) -> None:
        self.open.remove(self)
        for df in self.tables:
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path, fs = _hadoop_path(df.sparkSession, df._staged_at)
    fs.delete(path, True)


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: Column, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key, keys not null), so that no hot key meets in one task.

    ``weight`` is the number of ``rows`` of a key, ``total`` that of all. Keys with over a ``HOT``-th of all
    are fewer than ``HOT`` rows and are broadcast; the others are shuffled. Both inputs are read twice: stage them.
    """
    hot = F.broadcast(table.filter(weight * HOT > total))
    met = rows.join(hot, list(keys))
    rest = rows.join(hot.select(*keys), list(keys), "left_anti").join(table.filter(weight * HOT <= total), list(keys), how)
    return met.select(*rest.columns).union(rest)


def spread_left(rows: DataFrame, table: DataFrame, key: str, weight: Column, total: int) -> DataFrame:
    """``rows`` left-joined with ``table`` (staged, one row a key, not null) on a string key, each row read and moved once.

    Keys with over a ``HOT``-th of all rows are broadcast as in ``spread_join``. Their rows, and rows without a
    key, go through the shuffle of the others under keys that spread them.
    """
    hot, cold = table.filter(weight * HOT > total), table.filter(weight * HOT <= total)
    names = [c for c in table.columns if c != key]
    near = rows.join(F.broadcast(hot.select(F.col(key), F.struct(*names).alias("near_"))), key, "left")
    apart = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    near = near.withColumn("spread_", F.when(F.col("near_").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(apart))
    far = near.join(cold.select(F.col(key).alias("spread_"), F.struct(*names).alias("far_")), "spread_", "left")
    return far.select(*rows.columns, *(F.coalesce(F.col("near_")[n], F.col("far_")[n]).alias(n) for n in names))


def by_position(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """The rows with columns named c0, c1, …, so that no name meets a working column or needs quoting, and the new name of an old one."""
    names = {n.lower(): f"c{k}" for k, n in reversed(list(enumerate(docs.columns)))}
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), lambda name: names[name.lower()]


def by_name(docs: DataFrame, made: Sequence[str] = ()) -> list[Column]:
    """Back from ``by_position``: the columns of ``docs`` under their own names, less those that are made anew."""
    gone = {m.lower() for m in made}
    return [F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns) if n.lower() not in gone]
