"""Statistics of embeddings and linear baselines; sums run on the executors, small matrices on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filinglake.operators.corpus import ranked

#: Edges of the cosine histogram, each bin closed below and open above.
COSINE_EDGES = (-1.0, 0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def sampled_pairs(df: DataFrame, id_col: str, vec: str, n_pairs: int, n_rows: int, seed: int = 0) -> DataFrame:
    """Cosines of ``n_pairs`` pairs of rows drawn by hash of their places in the order of ids, which may have gaps; i = j is dropped."""
    df = ranked(df.select(id_col, vec), id_col, rank="__at")
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(n_rows))
    pairs = df.sparkSession.range(n_pairs).select(h(0).alias("i"), h(1).alias("j")).filter("i <> j")
    a, b = df.select(F.col("__at").alias("i"), F.col(vec).alias("u")), df.select(F.col("__at").alias("j"), F.col(vec).alias("v"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", cosine(F.col("u"), F.col("v")).alias("cos"))


def histogram(df: DataFrame, col: str, edges=COSINE_EDGES) -> DataFrame:
    c = F.col(col)
    return df.agg(*[F.count_if((c >= a) & (c < b)).alias(f"bin{k}") for k, (a, b) in enumerate(zip(edges, edges[1:]))], F.count(F.lit(1)).alias("n"))


STRIP = 1 << 16  # vectors of one side that meet in one task
TILE = (512, 2048)  # queries and vectors of one product


def query_cosines(df: DataFrame, id_col: str, vec: str, dims: int, query: Column, fold: Callable[[Iterator[np.ndarray], int], pa.RecordBatch], schema: str) -> DataFrame:
    """``fold`` of the cosines of queries with all vectors of another id, by strips of both sides; ``n`` of a strip pair's row counts its pairs.

    Every strip of queries meets every strip of vectors, so work is a product by nature, while a task holds two strips. A vector without
    length has no direction: its cosines are NaN. Nulls and vectors of another size have none; their pairs count in ``n`` alone.
    """
    usable = (F.size(vec) == dims) & ~F.exists(vec, lambda x: x.isNull())
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(usable, F.col(vec).cast("array<double>")).alias("v"), query.alias("asks"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    wide, high = max(min(64, -(-n // TILE[1])), -(-n // STRIP), 1), max(1, -(-asked // STRIP))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    at = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    a = rows.filter("asks").select("id", "v", at(high).alias("y")).withColumn("x", every(wide))
    b = rows.select("id", "v", at(wide).alias("x")).withColumn("y", every(high))

    def strip(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = t.filter(t.column("v").is_valid()).combine_chunks()
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks]
        v = (np.concatenate(flat) if flat else np.zeros(0)).reshape(-1, dims)
        with np.errstate(invalid="ignore", divide="ignore"):
            return t.column("id").to_numpy(), v / np.sqrt((v * v).sum(1))[:, None]

    def tiles(q: tuple, r: tuple) -> Iterator[np.ndarray]:
        for y in range(0, len(q[0]), TILE[0]):
            for x in range(0, len(r[0]), TILE[1]):
                i, j = q[0][y : y + TILE[0]], r[0][x : x + TILE[1]]
                cos = q[1][y : y + TILE[0]] @ r[1][x : x + TILE[1]].T
                yield cos[i[:, None] != j] if np.isin(i, j).any() else cos.ravel()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, times = np.unique(right.column("id").to_numpy(), return_counts=True)
        mine = left.column("id").to_numpy()
        held = mine[np.isin(mine, ids)]
        same = int(times[np.searchsorted(ids, held)].sum())
        return pa.Table.from_batches([fold(tiles(strip(left), strip(right)), len(mine) * right.num_rows - same)])

    return a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInArrow(run, schema)


def cosine_counts(df: DataFrame, id_col: str, vec: str, dims: int, query: Column, edges=COSINE_EDGES, digits: int = 6) -> DataFrame:
    """Histogram of the cosines, rounded, of queries with all vectors of another id, and the number of pairs."""
    names = [f"bin{k}" for k in range(len(edges) - 1)]

    def fold(tiles: Iterator[np.ndarray], n: int) -> pa.RecordBatch:
        above = np.zeros(len(edges), np.int64)
        for cos in tiles:
            top = np.fmax.reduce(cos, initial=-np.inf)
            for k, edge in enumerate(edges):
                if edge - 1e-5 > top:
                    break
                above[k] += np.count_nonzero(_rounded_above(cos, edge, digits))
        return pa.RecordBatch.from_pydict({**{c: [int(v)] for c, v in zip(names, above[:-1] - above[1:])}, "n": [n]})

    parts = query_cosines(df, id_col, vec, dims, query, fold, ", ".join(f"{c} long" for c in [*names, "n"]))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*names, "n"]])


def _rounded_above(cos: np.ndarray, edge: float, digits: int) -> np.ndarray:
    """Whether a value, rounded half away from zero, is at least ``edge``, itself of so few digits."""
    least = edge - 0.5 / 10**digits
    return cos > least if edge <= 0 else cos >= least


def cosine_figures(df: DataFrame, id_col: str, vec: str, dims: int, query: Column, digits: int = 5) -> DataFrame:
    """n, mean, std, min, max and the median of the rounded cosines of queries with all vectors of another id; NaN is the greatest."""
    unit, nan = 10**digits, 2 * 10**digits + 3

    def fold(tiles: Iterator[np.ndarray], n: int) -> pa.RecordBatch:
        counts, total, squares, low = np.zeros(nan + 1, np.int64), 0.0, 0.0, np.inf
        top = -np.inf
        for cos in tiles:
            place = np.rint(cos * unit)
            place += unit + 1  # rounding may leave a cosine just outside [-1, 1]
            bad = np.isnan(place)
            if bad.any():
                place[bad] = nan
            counts += np.bincount(place.astype(np.int32), minlength=nan + 1)
            total, squares = total + cos.sum(), squares + cos @ cos
            low, top = np.fmin(low, np.fmin.reduce(cos, initial=np.inf)), np.maximum(top, cos.max(initial=-np.inf))
        bins = np.flatnonzero(counts)
        first = lambda v: [v if k == 0 else None for k in range(max(1, len(bins)))]  # noqa: E731  a strip's own figures stand in its first row
        held = pa.array(bins, pa.int64()) if len(bins) else pa.nulls(1, pa.int64())
        k = pa.array(counts[bins] if len(bins) else [0], pa.int64())
        return pa.RecordBatch.from_arrays([held, k, pa.array(first(n), pa.int64()), *(pa.array(first(float(v)), pa.float64()) for v in (total, squares, low, top))], ["bin", "k", "n", "total", "squares", "low", "top"])

    # one row a bin: at most 2 * 10^digits
    bins = query_cosines(df, id_col, vec, dims, query, fold, "bin long, k long, n long, total double, squares double, low double, top double")
    bins = bins.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("k", "n", "total", "squares")], F.min("low").alias("low"), F.max("top").alias("top"))
    run = F.sum("k").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumn("upto", run).withColumn("m", F.sum("k").over(Window.partitionBy()))
    value = F.when(F.col("bin") == nan, F.lit(float("nan"))).otherwise((F.col("bin") - unit - 1) / float(unit))
    pick = lambda at: F.min(F.when(F.col("upto") > at, value))  # noqa: E731  the smallest value that so many do not reach
    m = F.col("m")
    g = bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("m"), F.lit(0)).alias("m"), F.sum("total").alias("t"), F.sum("squares").alias("s"), F.min("low").alias("low"), F.max("top").alias("top"), pick(F.floor((m - 1) / 2)).alias("a"), pick(F.floor(m / 2)).alias("b"))
    some = lambda c: F.when(m > 0, F.round(c, digits))
    variance = F.greatest((F.col("s") - F.col("t") * F.col("t") / F.nullif(m, F.lit(0))) / F.nullif(m - 1, F.lit(0)), F.lit(0.0))
    return g.select("n", some(F.col("t") / F.nullif(m, F.lit(0))).alias("mean"), F.when(m > 1, F.round(F.sqrt(variance), digits)).alias("std"), some(F.col("low")).alias("min"), some(F.col("top")).alias("max"), some((F.col("a") + F.col("b")) / 2).alias("median"))


def dim_variances(df: DataFrame, vec: str) -> DataFrame:
    long = df.select(F.posexplode(vec).alias("dim", "x"))
    return long.groupBy("dim").agg(F.var_samp(F.col("x").cast("double")).alias("variance"), F.avg(F.col("x").cast("double")).alias("mean"))


class Moments:
    """Count, mean and unbiased covariance of vectors."""

    def __init__(self, n: int, mean: np.ndarray, cov: np.ndarray):
        self.n, self.mean, self.cov = n, mean, cov

    def spectrum(self) -> np.ndarray:
        return np.maximum(np.linalg.eigvalsh(self.cov)[::-1], 0)

    def participation_ratio(self) -> float:
        return float(np.trace(self.cov) ** 2 / np.sum(self.cov**2))

    def entropy_dim(self) -> float:
        p = self.spectrum()
        p = p[p > 0] / p.sum()
        return float(np.exp(-(p * np.log(p)).sum()))

    def components_for(self, share: float) -> int:
        s = self.spectrum()
        return int((np.cumsum(s) / s.sum() < share).sum() + 1)

    def whitening(self, eps: float = 1e-5) -> np.ndarray:
        w, v = np.linalg.eigh(self.cov)
        return v @ np.diag(1 / np.sqrt(np.maximum(w, eps))) @ v.T


def gram(df: DataFrame, vec: str, extra: list[str] | None = None) -> tuple[int, np.ndarray]:
    """Row count and X'X of [vector, extra columns, 1]: one small matrix a task, added up on the executors."""
    extra = extra or []

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float)
                x = np.hstack([x, *[b.column(1 + k).to_numpy(zero_copy_only=False).astype(float)[:, None] for k in range(len(extra))], np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [sum(np.frombuffer(v) for v in pdf["m"]).tobytes()]})

    parts = df.select(vec, *extra).mapInArrow(part, "m binary").withColumn("k", F.pmod(F.xxhash64("m"), F.lit(32)))
    rows = parts.groupBy("k").applyInPandas(lambda pdf: add(pdf), "m binary").collect()  # 32 matrices at most
    if not rows:
        return 0, np.zeros((0, 0))
    flat = sum(np.frombuffer(r.m) for r in rows)
    d = int(round(len(flat) ** 0.5))
    m = flat.reshape(d, d)
    return int(round(m[-1, -1])), m


def moments(df: DataFrame, vec: str) -> Moments:
    n, m = gram(df, vec)
    mean = m[:-1, -1] / max(n, 1)
    return Moments(n, mean, (m[:-1, :-1] - n * np.outer(mean, mean)) / max(n - 1, 1))


def multiply(df: DataFrame, vec: str, matrix: np.ndarray, shift: np.ndarray, out: str) -> DataFrame:
    """(vector - shift) @ matrix, in Arrow batches; the matrix has the vectors' dimension squared."""
    names = df.columns
    at = names.index(vec)
    import pyspark.sql.types as T

    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = (np.stack(b.column(at).to_numpy(zero_copy_only=False)).astype(float) - shift) @ matrix
            flat = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), y.ravel())
            keep = [k for k, n in enumerate(names) if n != out]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], flat], [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def whiten(df: DataFrame, vec: str, out: str = "white", eps: float = 1e-5) -> DataFrame:
    m = moments(df, vec)
    return multiply(df, vec, m.whitening(eps), m.mean, out)


def ridge(df: DataFrame, vec: str, y: str, alpha: float = 1.0) -> np.ndarray:
    """Weights and bias of (X'X + alpha I)^-1 X'y with a column of ones, which is penalised too."""
    _, m = gram(df, vec, [y])
    d = len(m) - 2
    keep = [*range(d), d + 1]
    a, b = m[np.ix_(keep, keep)], m[keep, d]
    return np.linalg.solve(a + alpha * np.eye(len(a)), b)


def ridge_sweep(train: DataFrame, test: DataFrame, vec: str, y: str, alphas: list[float]) -> list[dict]:
    """Test MSE and R2 against the training mean for PCA sizes D, D/2, … and each alpha, from two Gram matrices, and MAE from one pass over the test rows."""
    n, m = gram(train, vec, [y])
    nt, t = gram(test, vec, [y])
    d = len(m) - 2
    mean = m[:d, -1] / n
    cov = m[:d, :d] / n - np.outer(mean, mean)
    _, v = np.linalg.eigh(cov)
    v = v[:, ::-1]
    out, k, solved = [], d, []
    while k >= max(1, d // 128):
        # basis of [projected centred x, 1] in terms of [x, 1]
        basis = np.zeros((d + 1, k + 1))
        basis[:d, :k] = v[:, :k]
        basis[d, :k] = -mean @ v[:, :k]
        basis[d, k] = 1
        keep = [*range(d), d + 1]
        a, b = basis.T @ m[np.ix_(keep, keep)] @ basis, basis.T @ m[keep, d]
        ta, tb, tyy = basis.T @ t[np.ix_(keep, keep)] @ basis, basis.T @ t[keep, d], t[d, d]
        y0 = m[d, -1] / n
        base = (tyy - 2 * y0 * t[d, -1] + nt * y0 * y0) / nt
        for alpha in alphas:
            w = np.linalg.lstsq(a + alpha * np.eye(k + 1), b, rcond=None)[0]  # at alpha 0 the matrix may be singular
            solved.append(basis @ w)
            mse = (tyy - 2 * w @ tb + w @ ta @ w) / nt
            out.append({"dims": k, "alpha": float(alpha), "mse": float(mse), "r2": float(1 - mse / base)})
        k //= 2
    models = np.stack(solved, axis=1)  # a column a model

    def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(models.shape[1])
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float)
                total += np.abs(x @ models[:-1] + models[-1] - b.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["model", "miss"])

    for r in test.select(vec, y).mapInArrow(misses, "model long, miss double").groupBy("model").agg(F.sum("miss").alias("miss")).collect():  # a row a model
        out[r.model]["mae"] = r.miss / nt
    return out


def mean_pool(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """Mean vector of each key, by one aggregate a dimension (partial sums before the shuffle)."""
    parts = [F.avg(F.get(F.col(vec), F.lit(k)).cast("double")) for k in range(dims)]
    return df.groupBy(key).agg(F.array(*parts).alias("pooled"), F.count(F.lit(1)).alias("n"))


def masked_mean(df: DataFrame, key: str, vec: str, valid: str, dims: int) -> DataFrame:
    """Mean vector of each key's valid rows, with their number; a key without any has noughts."""
    parts = [F.coalesce(F.avg(F.when(F.col(valid), F.get(F.col(vec), F.lit(k)).cast("double"))), F.lit(0.0)) for k in range(dims)]
    return df.groupBy(key).agg(F.array(*parts).alias("pooled"), F.count_if(F.col(valid)).alias("n"))


def off_diagonal_cosine(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """Mean cosine of the different pairs of each key: (|sum of units|^2 - n) / (n (n - 1)), without forming pairs."""
    unit = F.transform(F.col(vec), lambda x: x.cast("double") / norm(F.col(vec)))
    pooled = mean_pool(df.select(key, unit.alias("u")), key, "u", dims)
    n = F.col("n")
    return pooled.select(key, "n", F.try_divide(dot(F.col("pooled"), F.col("pooled")) * n * n - n, n * (n - 1)).alias("mean_cosine"))


def decode_peak(logits: Column, low: float = -12.0, high: float = 12.0, k: int = 5) -> Column:
    """Expected magnitude over a window of k bins around the likeliest bin."""
    n = F.size(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    at = F.array_position(logits, F.array_max(logits)).cast("int")
    first = F.greatest(at - k // 2, F.lit(1))
    last = F.least(at + k // 2, n)
    inside = F.slice(F.transform(e, lambda x, i: F.struct(x.alias("w"), (F.lit(low) + i * (high - low) / (n - 1)).alias("v"))), first, last - first + 1)
    total = F.aggregate(inside, F.lit(0.0), lambda s, x: s + x["w"])
    return F.aggregate(inside, F.lit(0.0), lambda s, x: s + x["w"] * x["v"]) / total


def interpolated_nll(logits: Column, target: Column) -> Column:
    """Negative log likelihood of a fractional bin: the two neighbours weighted linearly."""
    top = F.array_max(logits).cast("double")
    lse = top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x.cast("double") - top)), F.lit(0.0), lambda s, x: s + x))
    lo = F.floor(target).cast("int")
    hi = F.least(lo + 1, F.size(logits) - 1)
    w = target - F.floor(target)
    return (1 - w) * (lse - F.get(logits, lo).cast("double")) + w * (lse - F.get(logits, hi).cast("double"))


def contrastive_loss(df: DataFrame, batch: str, item: str, doc: str, vec: str, temperature: float = 0.07) -> DataFrame:
    """Supervised contrastive loss of each batch; positives share a document. Batches are bounded by their budget."""
    a = df.select(batch, F.col(item).alias("i"), F.col(doc).alias("d"), F.col(vec).alias("u"))
    b = df.select(batch, F.col(item).alias("j"), F.col(doc).alias("e"), F.col(vec).alias("v"))
    s = a.join(b, batch).filter("i <> j").withColumn("s", cosine(F.col("u"), F.col("v")) / temperature)
    row = s.groupBy(batch, "i").agg(F.log(F.sum(F.exp("s"))).alias("lse"), F.avg(F.when(F.col("d") == F.col("e"), F.col("s"))).alias("pos"))
    return row.filter("pos is not null").groupBy(batch).agg(F.avg(F.col("lse") - F.col("pos")).alias("loss"), F.count(F.lit(1)).alias("n"))


def sigreg(x: np.ndarray, n_proj: int = 64, knots: int = 17, seed: int = 0) -> float:
    """Distance of random projections' characteristic function to the standard normal's, by the trapezoid rule, times n."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(x.shape[1], n_proj))
    p = x @ (a / np.linalg.norm(a, axis=0))
    t = np.linspace(-5, 5, knots)
    arg = p[:, :, None] * t
    gap = (np.cos(arg).mean(0) - np.exp(-(t**2) / 2)) ** 2 + np.sin(arg).mean(0) ** 2
    return float((np.trapezoid(gap * np.exp(-(t**2) / 2), t, axis=1) * len(x)).mean())


def variance_summary(df: DataFrame, vec: str) -> DataFrame:
    """Mean, deviation, least, greatest and sum of the variances of all dimensions."""
    v = F.col("variance")
    return dim_variances(df, vec).agg(*[F.round(f(v), 6).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max), ("total", F.sum))])
