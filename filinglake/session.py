"""Session construction with the settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session in UTC with adaptive execution on; settings already made by spark-submit win."""
    b = SparkSession.builder.appName("filinglake")
    if master or not os.environ.get("MASTER"):
        b = b.master(master or "local[8]")
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver tables; a parquet file or a directory of parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python workers can import it anywhere."""
    import io
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_filinglake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="filinglake-package-")
    target = Path(folder, "filinglake_package.zip")
    target.write_bytes(data.getvalue())
    sc.addPyFile(str(target))
    sc._filinglake_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: the same rows for every later use, whatever executors are lost."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    note(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def note(spark: SparkSession, path: str) -> None:
    """Remember an intermediate table for ``forget``."""
    spark.sparkContext.__dict__.setdefault("_filinglake_written", []).append(path)


def forget(spark: SparkSession) -> int:
    """Delete the intermediate tables of all queries so far, once nothing reads their results any more; returns their number."""
    held = spark.sparkContext.__dict__.pop("_filinglake_written", [])
    for path in held:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(held)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, with its scheme; only where that is unset on one machine (tests) a temporary folder, the same for the whole session."""
    import re
    import tempfile

    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_filinglake_shared", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = sc._filinglake_shared = "file://" + tempfile.mkdtemp(prefix="filinglake-")
        sc.setCheckpointDir(found)
    # a path without a scheme belongs to the cluster's default file system; Python readers need it spelt out
    path = sc._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + full[5:] if re.match("file:/(?!/)", full) else full
