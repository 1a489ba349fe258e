"""Sharding along a Hilbert curve, in SQL expressions only.

Metadata dimensions are quantised to ``bits`` bits each in their own order:
quantiles of the values, strings compared whole. The curve's index
of a document's cell orders the documents, so a run of the order is compact in
every dimension and a reader can skip shards by the range of any of them. Runs
are cut to equal row counts (law ``rows``): counts differ by one at most.

The rank is never taken over one sorted partition. Cells are split by a hash
into groups of about ``GROUP_ROWS`` rows, ranked inside the group, and shifted
by the row counts of the groups before, so a cell with a third of all rows is
dealt out over many tasks. Inside a cell the order is by hash group, id, and
96 bits of checksums of the text; rows alike in all of these change places
freely, as copies of one row do.

Null dimensions go to the lowest bin, null texts have 8 bytes and the checksum
of an empty text. Empty tables give empty results, and fewer rows than shards
leave shards empty. Input columns that bear a result column's name are replaced.
Texts of any length are read once for the facts and, where they are part of
the result, once more for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filinglake.llm._shared import by_name, by_position, staged

GROUP_ROWS = 1 << 14
FILE_BYTES = 256 << 20


def _rot(x: int, k: int, n: int) -> int:
    k %= n
    return ((x << k) | (x >> (n - k))) & ((1 << n) - 1)


def curve_table(n: int) -> tuple[list[int], list[int], int]:
    """Next state and curve digit for (state, digit of the point); the states of an n-dimensional Hilbert curve.

    A state is the entry corner and the direction of a sub-cube; digits follow the Gray code.
    """
    gray = lambda i: i ^ (i >> 1)
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    turn = lambda i: 0 if i == 0 else ones(i - 1) % n if i % 2 == 0 else ones(i) % n
    inverse = {gray(i): i for i in range(1 << n)}
    side = 1 << n
    following, digit = [0] * (side * n * side), [0] * (side * n * side)
    for e in range(side):
        for d in range(n):
            for point in range(side):
                w = inverse[_rot(point ^ e, n - (d + 1) % n, n)]
                at = (e * n + d) * side + point
                digit[at] = w
                following[at] = (e ^ _rot(entry(w), d + 1, n)) * n + (d + turn(w) + 1) % n
    return following, digit, side


def hilbert_index(dims: Sequence[Column], bits: int) -> Column:
    """Curve index of a point with ``bits`` bits a dimension."""
    n = len(dims)
    following, digit, side = curve_table(n)
    nxt, out = F.array(*map(F.lit, following)), F.array(*map(F.lit, digit))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))

    def step(a: Column, level: Column) -> Column:
        point = F.lit(0)
        for k, x in enumerate(dims):
            point = point + F.call_function("shiftright", x, level).bitwiseAND(1) * (1 << k)
        at = (a["s"] * side + point).cast("int")
        return F.struct(F.get(nxt, at).alias("s"), (a["h"] * side + F.get(out, at)).alias("h"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["h"])


def ordinal(name: str, kind: str) -> Column:
    """What stands for a value in comparisons: strings as they are, all else as a number."""
    if kind == "string":
        return F.col(name)
    return F.unix_date(name).cast("double") if kind == "date" else F.col(name).cast("double")


def string_edges(df: DataFrame, name: str, n_bins: int) -> list[str]:
    """Quantile edges of whole strings: distinct values are range-partitioned and counted; only the edges reach the driver."""
    counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = staged(staged(counts, "values").repartitionByRange("v").withColumn("p", F.spark_partition_id()), "values")
    sums = counts.groupBy("p").agg(F.sum("n").alias("t"), F.min("v").alias("first"))
    before = sums.select("p", F.coalesce(F.sum("t").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # a row a partition
    total = sums.agg(F.sum("t")).first()[0] or 0
    up_to = counts.withColumn("c", F.sum("n").over(Window.partitionBy("p").orderBy("v"))).join(F.broadcast(before), "p").withColumn("c", F.col("b") + F.col("c"))
    at = F.floor(F.col("c") * n_bins / max(total, 1)) > F.floor((F.col("c") - F.col("n")) * n_bins / max(total, 1))  # a quantile falls on this value
    return sorted(r.v for r in up_to.filter(at & (F.col("c") < total)).select("v").collect())  # fewer than n_bins


def bin_edges(df: DataFrame, dims: dict[str, str], bits: int) -> dict[str, list]:
    """Distinct quantile edges of each dimension (name: type) over all rows: at most 2**bits - 1 each."""
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [d for d, kind in dims.items() if kind != "string"]
    out = {d: string_edges(df, d, 1 << bits) for d in dims if d not in numbers}
    if numbers:
        found = df.agg(*[F.percentile_approx(ordinal(d, dims[d]), at, 10_000).alias(f"e{k}") for k, d in enumerate(numbers)]).first()
        out |= {d: sorted(set(found[k] or [])) for k, d in enumerate(numbers)}
    return out


def quantised(name: str, kind: str, edges: list, bits: int) -> Column:
    """Bin by the edges below the value; fewer bins than cells are spread over the whole range."""
    if not edges:
        return F.lit(0)
    x = ordinal(name, kind)
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x))
    return F.when(x.isNull(), 0).otherwise((below * ((1 << bits) - 1) / len(edges)).cast("int"))


def hilbert_shards(docs: DataFrame, n_shards: int = 24, dims: Sequence[str] = ("lang", "source", "n_chars"), bits: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, else all) with size, text_crc32, hilbert, shard and slot."""
    given, (docs, at) = docs, by_position(docs)
    shown = given.columns if keep is None else list(keep)
    id_col, text_col, dims, keep = at(id_col), at(text_col), [at(d) for d in dims], keep and [at(c) for c in keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = {d: dict(docs.dtypes)[d] for d in dims}
    facts = {"__size": F.octet_length(text).cast("long") + 8, "__crc": F.crc32(text.cast("binary")), "__x": F.xxhash64(text)}
    light = [c for c in dict.fromkeys([id_col, *dims, *(keep or [])]) if keep is None or c != text_col]
    whole = keep is None or text_col in keep
    # the facts of every row are written once; a result with the text reads it again
    narrow = staged(docs.select(*light, *[v.alias(k) for k, v in facts.items()]), "shard-facts")
    edges = bin_edges(narrow, kinds, bits)
    cell = hilbert_index([quantised(d, kinds[d], edges[d], bits) for d in dims], bits)
    cells = staged(narrow.withColumn("__h", cell).groupBy("__h").count(), "shard-cells")
    top = cells.agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    total, salts = top["n"] or 0, max(1, -(-(top["most"] or 0) // group_rows))
    group = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("__crc"), F.col("__x")), F.lit(salts)).cast("int")

    # row counts of groups: at most cells x salts rows; cells alone (2**(bits*dims) at most) are summed in one task
    placed = narrow.withColumns({"__h": cell, "__g": group})
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = staged(placed.groupBy("__h", "__g").agg(F.count(F.lit(1)).alias("__n")), "shard-groups")
    inside = groups.withColumn("__in", F.coalesce(F.sum("__n").over(before(Window.partitionBy("__h").orderBy("__g"))), F.lit(0)))
    heads = cells.withColumn("__before", F.coalesce(F.sum("count").over(before(Window.orderBy("__h"))), F.lit(0)))
    offsets = inside.join(heads.select("__h", "__before"), "__h").select("__h", "__g", (F.col("__in") + F.col("__before")).alias("__offset"))

    rows = docs.withColumns(facts).withColumns({"__h": cell, "__g": group}) if whole else placed
    rows = rows.select(*dict.fromkeys([*(docs.columns if keep is None else keep), id_col]), "__size", "__crc", "__x", "__h", "__g")
    order = Window.partitionBy("__h", "__g").orderBy(F.col(id_col).asc_nulls_first(), "__crc", "__x", "__size")
    ranked = rows.withColumn("__r", F.row_number().over(order).cast("long") - 1).join(offsets, ["__h", "__g"])
    rank = F.col("__r") + F.col("__offset")
    shard = F.expr(f"(__r + __offset) * {n_shards}L div {max(total, 1)}L")
    out = ranked.withColumns({"size": F.col("__size"), "text_crc32": F.col("__crc"), "hilbert": F.col("__h"), "shard": shard.cast("int")})
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    made = ("size", "text_crc32", "hilbert", "shard", "slot")
    own = [F.col(at(c)).alias(c) for c in shown if c.lower() not in made]
    return out.withColumn("slot", rank - first).select(*own, *made)


def write_shards(sharded: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """One folder a shard, in files of about ``file_bytes`` of text, each a run of slots.

    A run is compact on the curve, so a file's footer carries narrow ranges of every dimension and readers skip it by any of them.
    """
    n = max(1, -(-(sharded.agg(F.sum("size")).first()[0] or 0) // file_bytes))
    sharded.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
