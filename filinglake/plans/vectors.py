"""Queries over embeddings and linear baselines."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from filinglake.operators import vectors as V
from filinglake.operators.corpus import ranked, ranked_in
from filinglake.session import shared_dir, ship_package, table
from filinglake.sources import readers, writers

DIMS = 64
PIECE = 1000  # chunks of a label in one row


def emb(spark, sf):
    ship_package(spark)
    return table(spark, sf, "embeddings")


def cosine_stats(spark, sf):
    """Figures of the cosines of every 20th vector, the stated query set, with all others."""
    return V.cosine_figures(emb(spark, sf), "vec_id", "embedding", DIMS, F.col("vec_id") % 20 == 0)


def cosine_hist(spark, sf):
    return V.cosine_counts(emb(spark, sf), "vec_id", "embedding", DIMS, F.col("vec_id") % 20 == 0)


def cosine_random_pairs(spark, sf):
    e = emb(spark, sf)
    return V.histogram(V.sampled_pairs(e, "vec_id", "embedding", 50_000, e.count()), "cos")


def dim_variance(spark, sf):
    return V.dim_variances(emb(spark, sf), "embedding").select("dim", F.round("variance", 7).alias("variance"), F.round("mean", 6).alias("mean"))


def norms(spark, sf):
    n = V.norm(F.col("embedding"))
    return emb(spark, sf).agg(F.round(F.avg(n), 5).alias("mean"), F.round(F.stddev_samp(n), 5).alias("std"), F.round(F.min(n), 5).alias("min"), F.round(F.max(n), 5).alias("max"))


def participation_ratio(spark, sf):
    return spark.createDataFrame([(round(V.moments(emb(spark, sf), "embedding").participation_ratio(), 3),)], "participation_ratio double")


def pca_spectrum(spark, sf):
    m = V.moments(emb(spark, sf), "embedding")
    s = m.spectrum()
    share = s.cumsum() / s.sum()
    return spark.createDataFrame(pd.DataFrame({"k": range(1, len(s) + 1), "eigenvalue": s, "cumulative": share, "entropy_dim": m.entropy_dim()}))


def components_needed(spark, sf):
    m = V.moments(emb(spark, sf), "embedding")
    return spark.createDataFrame([(t, m.components_for(t)) for t in (0.5, 0.9, 0.95, 0.99)], "share double, components int")


def zca(spark, sf):
    return V.whiten(emb(spark, sf), "embedding").select("vec_id", "label", "white")


def ridge(spark, sf):
    w = V.ridge(emb(spark, sf).filter("vec_id % 5 <> 0"), "embedding", "label", 1.0)
    score = V.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in w[:-1]])) + float(w[-1])
    return emb(spark, sf).filter("vec_id % 5 = 0").select("vec_id", "label", F.round(score, 6).alias("predicted"))


def ridge_pca_sweep(spark, sf):
    e = emb(spark, sf)
    rows = V.ridge_sweep(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "embedding", "label", [0.0, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0])
    return spark.createDataFrame(pd.DataFrame(rows))


def doc_mean_pool(spark, sf):
    p = V.mean_pool(emb(spark, sf), "label", "embedding", DIMS)
    return p.select("label", "n", F.posexplode("pooled").alias("dim", "x")).select("label", "n", "dim", F.round("x", 6).alias("x"))


def masked_mean_pool(spark, sf):
    """Mean of the chunks of each label that are not padding; every fourth vector and the whole of label 3 is."""
    e = emb(spark, sf).withColumn("valid", (F.col("vec_id") % 4 != 0) & (F.col("label") != 3))
    return V.masked_mean(e, "label", "embedding", "valid", DIMS).select("label", "n", F.posexplode("pooled").alias("dim", "x")).select("label", "n", "dim", F.round("x", 6).alias("x"))


def off_diagonal_cosine(spark, sf):
    return V.off_diagonal_cosine(emb(spark, sf), "label", "embedding", DIMS).select("label", "n", F.round("mean_cosine", 6).alias("mean_cosine"))


def peak_decode(spark, sf):
    return emb(spark, sf).select("vec_id", F.round(V.decode_peak(F.transform("embedding", lambda x: x.cast("double"))), 5).alias("magnitude"))


def bin_cross_entropy(spark, sf):
    t = (F.col("vec_id") % 630) / 10.0
    return emb(spark, sf).select("vec_id", F.round(V.interpolated_nll(F.transform("embedding", lambda x: x.cast("double")), t), 5).alias("nll"))


def contrastive_loss(spark, sf):
    e = emb(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / 32))
    return V.contrastive_loss(e, "batch", "vec_id", "label", "embedding").select("batch", F.round("loss", 5).alias("loss"), "n")


def anchor_choice(spark, sf):
    """Of every three vectors in order, which of the last two is closer to the first."""
    e = emb(spark, sf).select("vec_id", "embedding")
    at = ranked(e.select("vec_id"), "vec_id").select("vec_id", F.floor(F.col("rank") / 3).alias("triple"), (F.col("rank") % 3).alias("place"))
    rows = e.join(at, "vec_id")
    a = rows.filter("place = 0").select("triple", F.col("vec_id").alias("anchor"), F.col("embedding").alias("u"))
    b = rows.filter("place > 0").select("triple", F.col("vec_id").alias("candidate"), F.col("embedding").alias("v"))
    return a.join(b, "triple").groupBy("anchor").agg(F.max_by("candidate", V.cosine(F.col("u"), F.col("v"))).alias("closer"))


def scatter_dense(spark, sf):
    """Chunks of each label back in order, in pieces of ``PIECE`` chunks, as an array of ids and the number of values."""
    e = ranked_in(emb(spark, sf), "label", "vec_id", rank="chunk_idx")
    held = F.array_sort(F.collect_list(F.struct("chunk_idx", "vec_id", "embedding")))
    return e.groupBy("label", F.floor(F.col("chunk_idx") / PIECE).alias("piece")).agg(held.alias("h")).select("label", "piece", F.array_join(F.transform("h", lambda x: x["vec_id"]), ",").alias("ids"), F.aggregate(F.transform("h", lambda x: F.size(x["embedding"])), F.lit(0), lambda a, x: a + x).alias("n_values"))


def sigreg_statistic(spark, sf):
    """Normality statistic of each label's vectors, scaled to unit variance; labels hold a bounded number of samples here."""
    import numpy as np

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        x = (x - x.mean(0)) / (x.std(0) + 1e-9)
        return pd.DataFrame({"label": [int(pdf["label"].iloc[0])], "n": [len(x)], "statistic": [V.sigreg(x)]})

    batch = emb(spark, sf).withColumn("part", F.floor(F.col("vec_id") / 4096))
    return batch.groupBy("label", "part").applyInPandas(one, "label int, n long, statistic double")


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


_PAIRS = f"SELECT a.vec_id AS i, b.vec_id AS j, {_dot('a.embedding', 'b.embedding')} / sqrt({_dot('a.embedding', 'a.embedding')} * {_dot('b.embedding', 'b.embedding')}) AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id"
_LONG = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings"
_EDGES = list(zip(V.COSINE_EDGES, V.COSINE_EDGES[1:]))

QUERIES = {f.__name__: f for f in (
    cosine_stats, cosine_hist, cosine_random_pairs, dim_variance, norms, participation_ratio, pca_spectrum, components_needed, zca, ridge, ridge_pca_sweep, doc_mean_pool, off_diagonal_cosine, peak_decode,
    masked_mean_pool, bin_cross_entropy, contrastive_loss, anchor_choice, scatter_dense, sigreg_statistic,
)}

ORACLES = {
    "cosine_stats": f"SELECT count(*) AS n, round(avg(cos), 5) AS mean, round(stddev_samp(cos), 5) AS std, round(min(cos), 5) AS min, round(max(cos), 5) AS max, round(median(round(cos, 5)), 5) AS median FROM ({_PAIRS})",
    "cosine_hist": f"SELECT {', '.join(f'count(*) FILTER (cos >= {a} AND cos < {b}) AS bin{k}' for k, (a, b) in enumerate(_EDGES))}, count(*) AS n FROM (SELECT round(cos, 6) AS cos FROM ({_PAIRS}))",
    "dim_variance": f"SELECT dim, round(var_samp(x), 7) AS variance, round(avg(x), 6) AS mean FROM ({_LONG}) GROUP BY dim",
    "norms": f"SELECT round(avg(n), 5) AS mean, round(stddev_samp(n), 5) AS std, round(min(n), 5) AS min, round(max(n), 5) AS max FROM (SELECT sqrt({_dot('embedding', 'embedding')}) AS n FROM embeddings)",
    "participation_ratio": f"""WITH l AS ({_LONG}), m AS (SELECT dim, avg(x) AS m FROM l GROUP BY dim), c AS (SELECT vec_id, l.dim, x - m AS x FROM l JOIN m USING (dim)), n AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT a.dim AS i, b.dim AS j, sum(a.x * b.x) / (any_value(n) - 1) AS c FROM c a JOIN c b USING (vec_id), n GROUP BY 1, 2) SELECT round(power(sum(CASE WHEN i = j THEN c ELSE 0 END), 2) / sum(c * c), 3) AS participation_ratio FROM v""",
    "masked_mean_pool": f"""SELECT label, count(*) FILTER (valid) AS n, dim, round(coalesce(avg(x) FILTER (valid), 0), 6) AS x
FROM (SELECT *, vec_id % 4 <> 0 AND label <> 3 AS valid FROM ({_LONG})) GROUP BY label, dim""",
    "doc_mean_pool": f"SELECT label, count(*) AS n, dim, round(avg(x), 6) AS x FROM ({_LONG}) GROUP BY label, dim",
    "off_diagonal_cosine": f"""WITH l AS ({_LONG}), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM l GROUP BY 1), s AS (SELECT label, dim, sum(x / n) AS s, count(*) AS c FROM l JOIN n USING (vec_id) GROUP BY 1, 2)
SELECT label, any_value(c) AS n, round((sum(s * s) - any_value(c)) / (any_value(c) * (any_value(c) - 1)), 6) AS mean_cosine FROM s GROUP BY label""",
    "peak_decode": f"""WITH l AS ({_LONG}), t AS (SELECT vec_id, max(x) AS t, arg_min(dim, (-x, dim)) AS pk FROM l GROUP BY 1), w AS (SELECT l.vec_id, exp(x - t) AS w, -12 + dim * 24.0::DOUBLE / 63 AS v FROM l JOIN t USING (vec_id) WHERE dim BETWEEN pk - 2 AND pk + 2)
SELECT vec_id, round(sum(w * v) / sum(w), 5) AS magnitude FROM w GROUP BY vec_id""",
    "bin_cross_entropy": f"""WITH l AS ({_LONG}), s AS (SELECT vec_id, ln(sum(exp(x))) AS lse FROM l GROUP BY 1), t AS (SELECT vec_id, embedding, (vec_id % 630) / 10.0::DOUBLE AS t FROM embeddings)
SELECT vec_id, round((1 - (t - floor(t))) * (lse - embedding[floor(t)::INT + 1]::DOUBLE) + (t - floor(t)) * (lse - embedding[least(floor(t)::INT + 1, 63) + 1]::DOUBLE), 5) AS nll FROM t JOIN s USING (vec_id)""",
    "contrastive_loss": f"""WITH e AS (SELECT *, vec_id // 32 AS batch FROM embeddings), s AS (SELECT a.batch, a.vec_id AS i, a.label = b.label AS same, {_dot('a.embedding', 'b.embedding')} / sqrt({_dot('a.embedding', 'a.embedding')} * {_dot('b.embedding', 'b.embedding')}) / 0.07::DOUBLE AS s
FROM e a JOIN e b ON a.batch = b.batch AND a.vec_id <> b.vec_id), r AS (SELECT batch, i, ln(sum(exp(s))) AS lse, avg(CASE WHEN same THEN s END) AS pos FROM s GROUP BY 1, 2) SELECT batch, round(avg(lse - pos), 5) AS loss, count(*) AS n FROM r WHERE pos IS NOT NULL GROUP BY batch""",
    "anchor_choice": f"""WITH r AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) AS r FROM embeddings)
SELECT a.vec_id AS anchor, arg_max(b.vec_id, {_dot('a.embedding', 'b.embedding')} / sqrt({_dot('b.embedding', 'b.embedding')})) AS closer FROM r a JOIN r b ON a.r % 3 = 0 AND b.r // 3 = a.r // 3 AND b.r % 3 > 0 GROUP BY 1""",
    "scatter_dense": f"SELECT label, piece, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids, sum(len(embedding))::INT AS n_values FROM (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // {PIECE} AS piece FROM embeddings) GROUP BY label, piece",
}


def variance_summary(spark, sf):
    return V.variance_summary(emb(spark, sf), "embedding")


def cached_shards(spark, sf):
    """Embeddings cached in shards of 100 places: a first run that stopped after some of them, a second one that goes on, and the cache read back."""
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    e = emb(spark, sf).select("vec_id", "embedding")
    writers.write_shards(e.filter("vec_id < 300"), path, "vec_id", 100)
    writers.write_shards(e, path, "vec_id", 100)
    return readers.read_cache(spark, path).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.sum(F.size("embedding")).alias("n_values"))


QUERIES |= {f.__name__: f for f in (variance_summary, cached_shards)}
ORACLES |= {
    "variance_summary": f"WITH v AS (SELECT dim, var_samp(x) AS v FROM ({_LONG}) GROUP BY dim) SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(sum(v), 6) AS total FROM v",
    "cached_shards": "SELECT shard, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id, sum(len(embedding))::BIGINT AS n_values FROM (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS shard FROM embeddings) GROUP BY shard",
}
