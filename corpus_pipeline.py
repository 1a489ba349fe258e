"""The training-corpus pipeline: five stages, each on all that the one before kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last
return the columns of documents; between stages the rows are written as
Parquet and read again. Columns are read by the names of documents; further
columns pass through every stage but bear no meaning, whatever their names.
Empty tables give empty results in every stage, and texts of any length are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filinglake.llm import decontam, mixing, quality, sharding, simhash
from filinglake.llm._shared import staged
from filinglake.llm.queries import MIX_WEIGHTS
from filinglake.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have no words and go; repeated rows are judged alike."""
    return quality.cascade(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates (0.8 of five-word shingles).

    Null and empty texts are one text. Of rows alike in id and text one stays; an id with two texts is judged by each; rows without id stay.
    """
    ship_package(spark)
    return simhash.deduplicate(docs, k=11, width=3, check_width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. Null and empty texts stay, every row is judged by its own text, null items match nothing."""
    ship_package(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order. A null source is one of its own; rows without id go by their text; rows of equal id repeat alike."""
    return mixing.poisson_mix(docs, MIX_WEIGHTS, figures=False)


def hilbert_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with size, text_crc32, hilbert, shard (0 to 23) and slot. Null dimensions come first; copies of a row may change places; input columns of these names are replaced."""
    return sharding.hilbert_shards(docs, 24)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("hilbert_shards", hilbert_shards),
]

#: SQL cannot express the fingerprints' links or string tiling; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
