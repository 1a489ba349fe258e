"""Columns of any name pass through every operator and stage with their values."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from filinglake.llm import decontam, mixing, pii, quality, queries, sharding, simhash, token_counts

SF = "/root/testdata/sf0.001"
NAMES = ["meta.url", "back`tick", "__rate", "__h", "__base", "__node", "__source", "__n", "__row", "__key", "__cdf", "__g", "c0", "c3", "Largest Size", "spread_", "copies", "fp", "node", "x", "a", "b", "i", "t"]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [F.concat(F.lit(f"{k}:"), "doc_id").alias(n) for k, n in enumerate(NAMES)]
    return own.select("doc_id", *extra[:12], "text", "lang", *extra[12:], "source", "n_chars")


def unchanged(rows, made=()):
    for r in rows:
        d = r.asDict()
        assert all(d[n] == f"{k}:{d['doc_id']}" for k, n in enumerate(NAMES) if n not in made)
    return len(rows)


@pytest.mark.parametrize("k", range(5), ids=[n for n, _ in P.STAGES])
def test_stages(spark, docs, k):
    out = P.STAGES[k][1](spark, docs, SF)
    assert out.columns[: len(docs.columns)] == docs.columns and unchanged(out.collect()) > 50
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in P.STAGES[k][1](spark, plain, SF).collect())


def test_operators_that_keep_columns(spark, docs):
    n = docs.count()
    assert unchanged(quality.quality_report(docs).collect()) == n
    assert unchanged(pii.pseudonymise(docs, b"key").collect()) == n
    assert unchanged(mixing.poisson_mix(docs).collect()) > n / 2
    assert unchanged(sharding.hilbert_shards(docs, 3).collect()) == n
    few = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert unchanged(decontam.decontaminate(docs, few, block_bytes=500).collect()) > 50  # several blocks
    assert unchanged(simhash.deduplicate(docs).collect()) > 50


def test_operators_that_make_their_own_columns(spark, docs, tmp_path, monkeypatch):
    for t in ("pages", "benchmark", "labels", "conversations"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df.select(*df.columns, *[F.lit("x").alias(n) for n in ("meta.url", "__row", "__mark", "__source")]).write.parquet(f"{tmp_path}/{t}.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_token_counts", "op3_url_templates", "op4_string_tiling", "op6_simhash", "op9_token_ids", "op11_filter_audit", "op12_warc", "op13_turn_repair"):
        got, want = (queries.QUERIES[name](spark, d) for d in (str(tmp_path), SF))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    assert token_counts.token_counts(docs).count() > 0


def test_columns_that_an_operator_makes_are_replaced(spark, docs):
    odd = docs.withColumn("KEPT", F.lit("old")).withColumn("Slot", F.lit("old")).withColumn("RATE", F.lit("old")).withColumn("N_Replaced", F.lit("old"))
    assert "old" not in {r.kept for r in quality.quality_report(odd).collect()}
    assert "old" not in {r.slot for r in sharding.hilbert_shards(odd, 3).collect()}
    assert "old" not in {r.rate for r in mixing.poisson_mix(odd).collect()}
    assert "old" not in {r.n_replaced for r in pii.pseudonymise(odd, b"key").collect()}
