"""What is left to do, and what became of it: work lists for calls to slow services whose results land as tables.

The service itself is a function from items to outcomes. A state row an item says how often it was tried, with what
outcome, and when it may be tried again; results are appended batch by batch, so a run that stops loses one batch at most and the
next run goes on behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglake.sources import writers
from filinglake.sources.readers import current, read_or_empty

DONE, FAILED, GIVEN_UP = "done", "failed", "given_up"
STATE = "item string, status string, attempts long, last_try timestamp, next_try timestamp, error string"


def attempts(outcomes: DataFrame, most: int = 5, wait_seconds: int = 60, longest_wait: int = 86_400) -> DataFrame:
    """The state of each item from all its outcomes (item, ok, at, error).

    One good outcome makes it done for good. An item that failed may be tried again after a wait that doubles with each attempt, up to the
    longest; after ``most`` attempts it is given up. The error is that of the last failure, the least of several at one time. Outcomes
    without item or time are ignored; a null ``ok`` is a failure.
    """
    good = F.coalesce("ok", F.lit(False))
    rows = outcomes.filter("item is not null and at is not null").withColumn("ok", good)
    error = F.coalesce("error", F.lit(""))
    seen = rows.groupBy("item").agg(
        F.bool_or("ok").alias("__done"), F.count(F.lit(1)).alias("attempts"), F.max("at").alias("last_try"),
        F.min_by(error, F.when(~F.col("ok"), F.struct(-F.unix_micros(F.col("at").cast("timestamp_ltz")), error))).alias("error"),
    )
    wait = F.least(F.lit(longest_wait), wait_seconds * F.pow(F.lit(2), F.least(F.col("attempts") - 1, F.lit(40)))).cast("long")
    status = F.when(F.col("__done"), DONE).when(F.col("attempts") >= most, GIVEN_UP).otherwise(FAILED)
    later = F.when(F.col("status") == FAILED, F.timestamp_seconds(F.unix_micros(F.col("last_try").cast("timestamp_ltz")) / F.lit(1e6) + wait))
    return seen.withColumn("status", status).select("item", "status", "attempts", "last_try", later.cast(rows.schema["at"].dataType).alias("next_try"), F.when(F.col("status") != DONE, F.col("error")).alias("error"))


def merged(state: DataFrame, outcomes: DataFrame, **waits: int) -> DataFrame:
    """The state after further outcomes: attempts add up, what was done stays done."""
    new = attempts(outcomes, most=1 << 40, **{k: v for k, v in waits.items() if k != "most"})
    old = state.select("item", F.col("status").alias("o"), F.col("attempts").alias("oa"), F.col("last_try").alias("ol"), F.col("next_try").alias("on"), F.col("error").alias("oe"))
    both = new.join(old, "item", "full_outer")
    total = F.coalesce("attempts", F.lit(0)) + F.coalesce("oa", F.lit(0))
    most, first, longest = waits.get("most", 5), waits.get("wait_seconds", 60), waits.get("longest_wait", 86_400)
    done = F.coalesce(F.col("status") == DONE, F.lit(False)) | F.coalesce(F.col("o") == DONE, F.lit(False))
    status = F.when(done, DONE).when(F.col("__n") >= most, GIVEN_UP).otherwise(FAILED)
    wait = F.least(F.lit(longest), first * F.pow(F.lit(2), F.least(F.col("__n") - 1, F.lit(40)))).cast("long")
    last = F.greatest("last_try", "ol")
    later = F.when(F.col("__s") == FAILED, F.timestamp_seconds(F.unix_micros(F.col("__l").cast("timestamp_ltz")) / F.lit(1e6) + wait))
    return (
        both.withColumn("__n", total).withColumn("__l", last).withColumn("__s", status)
        .select("item", F.col("__s").alias("status"), F.col("__n").alias("attempts"), F.col("__l").alias("last_try"), later.cast(state.schema["next_try"].dataType).alias("next_try"), F.when(F.col("__s") != DONE, F.when(F.col("attempts").isNull() | (F.col("ol") > F.col("last_try")), F.col("oe")).otherwise(F.col("error"))).alias("error"))
    )


def pending(items: DataFrame, state: DataFrame, finished: DataFrame, now, item: str = "item", ending: str = ".md") -> DataFrame:
    """``items`` whose output name (stem and ``ending``) is not among the ``finished`` names, and that the state does not hold back at ``now``."""
    stems = finished.filter(F.col("name").endswith(ending)).select(F.expr(f"substring(name, 1, length(name) - {len(ending)})").alias(item)).distinct()
    held = state.filter(F.col("status").isin(DONE, GIVEN_UP) | (F.col("next_try") > F.lit(now))).select(F.col("item").alias(item))
    return items.join(stems, item, "left_anti").join(held, item, "left_anti")


def summary(items: DataFrame, state: DataFrame, item: str = "item") -> DataFrame:
    """Items by status; those never tried are ``pending``."""
    known = items.select(F.col(item).alias("item")).join(state.select("item", "status"), "item", "left")
    return known.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def run(items: DataFrame, path: str, call: Callable[[DataFrame], DataFrame], now, batches: int = 16, item: str = "item", **waits: int) -> DataFrame:
    """Put all items that may be tried through ``call`` and return the state afterwards.

    ``call`` gives (item, ok, at, error, result) for the rows of a batch. Good results are appended to ``path``/results, one row an item, before the
    state in ``path``/state is replaced as a whole; where a run stops in between, the results say what is done.
    """
    spark = items.sparkSession
    results, states = f"{path}/results", f"{path}/state"
    for k in range(batches):
        state = current(spark, states, STATE)
        landed = read_or_empty(spark, results, "item string, result string")
        mine = items.filter(F.pmod(F.xxhash64(item), F.lit(batches)) == k)
        names = landed.select(F.concat("item", F.lit(".md")).alias("name"))
        work = pending(mine, state, names, now, item)
        outcomes = writers.written(call(work), "outcomes")
        writers.append_new(outcomes.filter("ok").select("item", "result"), results, "item")
        tried = outcomes.select("item", "ok", "at", "error")
        known = landed.join(state.filter(F.col("status") == DONE), "item", "left_anti").select("item", F.lit(True).alias("ok"), F.lit(now).cast("timestamp").alias("at"), F.lit("").alias("error"))
        writers.replace(merged(state, tried.unionByName(known), **waits), states)
    return current(spark, states, STATE)
