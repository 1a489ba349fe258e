"""Sinks: every writer leaves a whole new result or appends whole files; nothing is changed in place."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglake.functions import numbers
from filinglake.operators.corpus import evenly_spaced, ranked
from filinglake.session import written


def write_manifest(pages: DataFrame, path: str) -> None:
    """One JSON row a domain with its pages in rank order."""
    held = F.sort_array(F.collect_list(F.struct("page_rank", "url", "crawl")))
    pages.groupBy("domain").agg(held.alias("pages")).write.mode("overwrite").json(path)


def company_file_name(ticker, cik, name):
    """Ticker, else CIK<id>_<safe name>."""
    return F.coalesce(ticker, F.concat(F.lit("CIK"), cik, F.lit("_"), numbers.safe_name(name)))


def write_company_json(facts: DataFrame, path: str) -> None:
    """Facts nested by date and metric, one partition folder a company file name."""
    entry = F.struct(numbers.tagged(F.col("value")).alias("value"), "unit")
    by_date = facts.groupBy("file_name", "period_end").agg(F.map_from_entries(F.collect_list(F.struct("metric", entry.alias("v")))).alias("m"))
    nested = by_date.groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("period_end", "m"))).alias("financials"))
    nested.write.mode("overwrite").partitionBy("file_name").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_ranking(df: DataFrame, path: str, order: str, tie: str, top: int) -> None:
    """The first ``top`` rows by value, in one small file."""
    df.orderBy(F.desc(order), tie).limit(top).coalesce(1).write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append one row of each key that is not there yet; returns their number. Only a missing table counts as empty."""
    from pyspark.errors import AnalysisException

    df = df.dropDuplicates([key])
    try:
        df = df.join(df.sparkSession.read.parquet(path).select(key).distinct(), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    df = written(df, "appended")
    df.write.mode("append").parquet(path)
    return df.count()


def write_tokens(docs: DataFrame, path: str, parts: int | None = None) -> None:
    """Tokenised documents sorted by source file inside each file."""
    d = docs.repartitionByRange(parts, "source_file") if parts else docs.repartitionByRange("source_file")
    d.sortWithinPartitions("source_file").write.mode("overwrite").parquet(path)


def write_by_period(facts: DataFrame, path: str, period: str = "year", files: int = 16) -> None:
    """A folder a period, written by up to ``files`` tasks each, so that no period is one task."""
    some = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(files))
    facts.repartition(F.col(period), some).write.mode("overwrite").partitionBy(period).parquet(path)


def copy_matched(files: DataFrame, wanted: DataFrame, key: str, path: str) -> None:
    files.join(wanted.select(key).distinct(), key, "left_semi").write.mode("overwrite").parquet(path)


def band_report(banded: DataFrame, band: str, value: str, text_col: str | None = None, order: str | None = None, samples: int = 3, most: int = 400, title: str = "Samples by band") -> str:
    """Markdown of every band: its range, its rows and its share of all characters, and evenly spaced sample rows cut to ``most`` characters.

    ``order`` names the rows and orders them with the value; the samples are those of ``corpus.evenly_spaced``, at most ``samples`` a band.
    """
    chars = F.sum(F.length(text_col)) if text_col else F.lit(0)
    by = banded.groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.coalesce(chars, F.lit(0)).alias("chars")).orderBy(band).collect()
    shown: dict = {}
    if text_col and order:
        # the whole text is measured, only its beginning travels
        body = F.trim(text_col)
        rows = evenly_spaced(banded, samples, by=band).select(band, value, order, F.substring(body, 1, most).alias("cut"), F.length(body).alias("size"))
        for r in rows.orderBy(band, value, order).collect():
            shown.setdefault(r[0], []).append(r)
    total, size = sum(r.n for r in by), sum(r.chars for r in by)
    out = [f"# {title}", "", f"{total} rows, {size:,} characters", ""] if text_col else []
    for r in by:
        share = f", {r.chars:,} characters, {100 * r.chars / size if size else 0:.1f} % of all" if text_col else ""
        out.append(f"## Band {r[0]}: {r.n} rows, {r.lo} to {r.hi}{share}")
        for k, row in enumerate(shown.get(r[0], []), 1):
            fence = "`" * max(3, 1 + max((len(m) for m in re.findall("`+", row.cut or "")), default=0))
            out += ["", f"### Sample {k}: {row[2]}, {row[1]}", "", fence, row.cut or "", fence] + ([f"(cut; {row.size} characters)"] if (row.size or 0) > most else [])
        if shown:
            out.append("")
    return "\n".join(out)


def _hadoop(spark, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(sc._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, keep: int = 2) -> str:
    """Replace the table under ``path`` by another, all at once; returns the new table's folder.

    The rows go to a folder of their own first. Only when they are whole, a pointer with its name is written and renamed over the old pointer, so readers
    (``readers.current``) see the old table or the new one, and a write that fails leaves the old one. The last ``keep`` tables
    stay, for readers that have begun; older ones go. One writer at a time.
    """
    import uuid

    spark = df.sparkSession
    root, fs = _hadoop(spark, path)
    fs.mkdirs(root)
    made = f"{0 if not (old := generations(spark, path)) else int(old[-1][4:14]) + 1:010d}"
    name = f"gen-{made}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    jvm = spark.sparkContext._jvm
    fresh, pointer = _hadoop(spark, f"{path}/_pointer-{name}")[0], _hadoop(spark, f"{path}/_current")[0]
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(kind, 1)
    overwrite[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(pointer), overwrite)
    for stale in generations(spark, path)[:-keep]:
        fs.delete(_hadoop(spark, f"{path}/{stale}")[0], True)
    return f"{path}/{name}"


def generations(spark, path: str) -> list[str]:
    """Folders of the tables written so far, the oldest first; also those of writes that failed."""
    root, fs = _hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(root) if f.getPath().getName().startswith("gen-")) if fs.exists(root) else []


def write_shards(df: DataFrame, path: str, order: str, shard_rows: int) -> int:
    """Write rows in folders shard=k of ``shard_rows`` places each, in order; returns how many shards were new.

    Shards that a run before has finished are left alone, so a run that stopped goes on behind them. Each is written under a name of its
    own and renamed when it is whole.
    """
    spark = df.sparkSession
    rows = ranked(df, order, rank="__at").withColumn("shard", F.floor(F.col("__at") / shard_rows)).drop("__at")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = hadoop(path)
    done = {int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(target) if f.getPath().getName().startswith("shard=")} if fs.exists(target) else set()
    waiting = f"{path}/_waiting"
    rows.filter(~F.col("shard").isin(*done) if done else F.lit(True)).write.mode("overwrite").partitionBy("shard").parquet(waiting)
    new = [f.getPath() for f in fs.listStatus(hadoop(waiting)) if f.getPath().getName().startswith("shard=")]
    for p in new:
        fs.rename(p, hadoop(f"{path}/{p.getName()}"))
    fs.delete(hadoop(waiting), True)
    return len(new)
