"""Corpus operators: pages in texts, density, bands, budgets, batches, chunks and masks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglake.session import written

# ---- pages inside one text ---------------------------------------------------------------------------------------


def explode_pages(docs: DataFrame, id_col: str, text_col: str, mark: str = "########## ") -> DataFrame:
    """(id, seq, url, content) of the pages behind separator lines; text before the first one is dropped."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), rf"\n(?={mark})")
    rows = docs.select(id_col, F.posexplode(parts).alias("seq", "part")).filter("seq > 0")
    head = F.regexp_extract("part", r"^([^\n]*)", 1)
    return rows.select(id_col, "seq", F.substr(head, F.lit(len(mark) + 1)).alias("url"), F.substr("part", F.length(head) + 2).alias("content"))


def concat_pages(pages: DataFrame, key: str | list[str], order: str, url: str, content: str, mark: str = "########## ") -> DataFrame:
    """One text a key: each page's separator line and content, in order."""
    page = F.concat(F.lit(mark), F.col(url), F.lit("\n"), F.col(content))
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), page.alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(held, lambda x: x["t"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_pages"))


# ---- information density -----------------------------------------------------------------------------------------


def log_spaced_lengths(n: int, low: int, high: int) -> list[int]:
    step = (math.log(high) - math.log(low)) / max(1, n - 1)
    return sorted({round(math.exp(math.log(low) + i * step)) for i in range(n)})


def expected_ratio(n: Column, curve: list[tuple[int, float]]) -> Column:
    """Ratio interpolated in ln(n) between the curve's points, clamped at its ends; 0.5 without a curve."""
    if not curve:
        return F.lit(0.5)
    curve = sorted(curve)
    points = F.array(*[F.struct(F.lit(float(a)).alias("n"), F.lit(float(r)).alias("r")) for a, r in curve])
    k = F.size(F.filter(points, lambda p: p["n"] <= n))
    lo, hi = F.get(points, k - 1), F.get(points, k)
    share = (F.log(n) - F.log(lo["n"])) / (F.log(hi["n"]) - F.log(lo["n"]))
    return F.when(n <= curve[0][0], curve[0][1]).when(n >= curve[-1][0], curve[-1][1]).otherwise(lo["r"] + share * (hi["r"] - lo["r"]))


@F.pandas_udf(T.DoubleType())
def deflate_ratio(s: pd.Series) -> pd.Series:
    """Compressed over plain UTF-8 bytes; null under 50 bytes."""
    import zlib

    def one(t):
        raw = t if isinstance(t, bytes) else t.encode()
        return len(zlib.compress(raw, 6)) / len(raw) if len(raw) >= 50 else None

    return s.map(one, na_action="ignore").astype(float)


def adjusted_density(text: Column, ratio: Column, curve: list[tuple[int, float]]) -> Column:
    """ln(ratio / expected); -1 for texts too short to compress."""
    return F.coalesce(F.log(ratio / expected_ratio(F.octet_length(text), curve)), F.lit(-1.0))


def baseline_curve(blobs: DataFrame, lengths: list[int], text_col: str = "text") -> DataFrame:
    """Mean deflate ratio of the first n bytes of the texts that have so many (n, ratio, n_texts)."""
    raw = F.col(text_col).cast("binary")
    reached = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.octet_length(text_col))
    cut = blobs.select(F.explode(F.transform(reached, lambda n: F.struct(n.alias("n"), F.substr(raw, F.lit(1), n).alias("t")))).alias("c")).select("c.n", "c.t")
    return cut.withColumn("r", deflate_ratio(F.col("t"))).groupBy("n").agg(F.avg("r").alias("ratio"), F.count(F.lit(1)).alias("n_texts"))


# ---- global ranks without one global sort -------------------------------------------------------------------------


def ranked(df: DataFrame, *order: str, rank: str = "rank") -> DataFrame:
    """0-based rank in the order of some columns: rows are dealt to ranges and sorted there, and shifted by the counts of the ranges before.

    The sorted rows are written once, so that ranges and counts belong together.
    """
    place = F.monotonically_increasing_id()  # range << 33 | row
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", place), "ranked")
    part, row = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__k"))  # a row a range
    before = counts.select("__p", F.coalesce(F.sum("__k").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return rows.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(rank, F.col("__b") + row).drop("__p", "__m", "__b")


def ranked_in(df: DataFrame, group: str, *order: str, rank: str = "rank") -> DataFrame:
    """0-based rank inside each group, however large it is: the global rank less the group's first. Null is a group."""
    rows = ranked(df, group, *order, rank="__all")
    first = rows.groupBy(F.col(group).alias("__group")).agg(F.min("__all").alias("__first"))
    return rows.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn(rank, F.col("__all") - F.col("__first")).drop("__all", "__first", "__group")


BANDS = ((0.0, 0.05), (0.05, 0.1), (0.1, 0.2), (0.2, 0.4), (0.4, 0.8), (0.8, 1.0))


def quantile_bands(df: DataFrame, value: str, tie: str, bands=BANDS) -> DataFrame:
    """Rows with their rank and band; band b holds ranks from int(n*lo) up to int(n*hi)."""
    n = df.count()
    cuts = [int(n * hi) for _, hi in bands]
    r = ranked(df, value, tie)
    band = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("rank")))
    return r.withColumn("band", band)


def evenly_spaced(banded: DataFrame, k: int, by: str = "band", rank: str = "rank") -> DataFrame:
    """k rows of each group at index int(size*(i+0.5)/k); the whole group if it has k rows or fewer."""
    size = banded.groupBy(by).agg(F.count(F.lit(1)).alias("__n"), F.min(rank).alias("__m"))
    picks = size.withColumn("__i", F.explode(F.when(F.col("__n") <= k, F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(F.col("__n") * (i + 0.5) / k)))))
    return banded.join(picks.select(by, (F.col("__m") + F.col("__i")).alias(rank)), [by, rank], "left_semi")


def byte_budget(df: DataFrame, order: str, text_col: str, target: int, bucket: int = 1000) -> DataFrame:
    """Rows in order (a number) until the running bytes reach the target; the row that crosses it stays.

    Sizes alone are added up, first over wide and then over narrow buckets of the order, to find where the target falls; only rows up to
    there are read, and their running sums are taken inside buckets and shifted by the bytes of those before.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    sizes = df.select(F.col(order).alias("__o"), size.alias("__b"))
    low = before = None
    for width in (bucket * bucket, bucket):
        inside = sizes if low is None else sizes.filter((F.col("__o") >= low[0]) & (F.col("__o") < low[1]))
        sums = inside.groupBy(F.floor(F.col("__o") / width).alias("g")).agg(F.sum("__b").alias("t"))
        run = F.sum("t").over(Window.orderBy("g")) + F.lit(before or 0)
        reached = sums.select("g", (run - F.col("t")).alias("before"), run.alias("upto")).filter(F.col("upto") >= target).orderBy("g").first()
        if reached is None:
            break
        low, before = (reached.g * width, (reached.g + 1) * width), reached.before
    rows = (df if low is None else df.filter(F.col(order).isNull() | (F.col(order) < low[1]))).withColumn("__b", size).withColumn("__g", F.floor(F.col(order) / bucket))
    totals = rows.groupBy(F.col("__g").alias("__h")).agg(F.sum("__b").alias("__t"))
    start = totals.select("__h", F.coalesce(F.sum("__t").over(Window.orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    inside = F.coalesce(F.sum("__b").over(Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("__r", inside).join(start, F.col("__g").eqNullSafe(F.col("__h"))).withColumn("bytes_before", F.col("__s") + F.col("__r"))
    return out.filter(F.col("bytes_before") < target).drop("__b", "__g", "__h", "__r", "__s")


def every_kth(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n of every step-th row in order, step = max(1, rows // n)."""
    step = max(1, df.count() // n)
    return ranked(df, order).filter((F.col("rank") % step == 0) & (F.col("rank") < step * n))


# ---- batches -----------------------------------------------------------------------------------------------------


def bucket_batches(chunks: DataFrame, id_col: str, length: str, budget: int, width: int = 16, penalty: float = 0.15, span: int = 4096) -> DataFrame:
    """Batches of chunks of like length: key = length rounded up to ``width``, size from the penalised budget.

    Members are dealt by MD5 of the id inside a bucket.
    """
    key = (F.ceil(F.col(length) / width) * width).cast("long")
    size = F.greatest(F.lit(1), F.floor(F.lit(float(budget)) / (1 + penalty * F.col("bucket") / span) / F.col("bucket")).cast("long"))
    rows = chunks.withColumn("bucket", F.greatest(key, F.lit(width))).withColumn("batch_size", size)
    rows = ranked_in(rows.withColumn("__h", F.md5(F.col(id_col).cast("string").cast("binary"))), "bucket", "__h", id_col, rank="__r")
    return rows.withColumn("batch", F.floor(F.col("__r") / F.col("batch_size"))).select(*chunks.columns, "bucket", "batch_size", "batch")


def same_doc_batches(chunks: DataFrame, doc: str, order: str, length: str, budget: int, width: int = 32) -> DataFrame:
    """Batches inside length buckets in document order, so that chunks of one document stay together."""
    key = F.greatest((F.ceil(F.col(length) / width) * width).cast("long"), F.lit(width))
    rows = chunks.withColumn("bucket", key).withColumn("batch_size", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))))
    rows = ranked_in(rows, "bucket", doc, order, rank="__r")
    return rows.withColumn("batch", F.floor(F.col("__r") / F.col("batch_size"))).select(*chunks.columns, "bucket", "batch_size", "batch")


def padding_waste(batched: DataFrame, length: str) -> DataFrame:
    """1 - tokens / padded tokens over all batches (bucket, batch)."""
    per = batched.groupBy("bucket", "batch").agg(F.sum(length).alias("t"), (F.max(length) * F.count(F.lit(1))).alias("p"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.round(1 - F.sum("t") / F.sum("p"), 6).alias("waste"))


def greedy_pack(chunks: DataFrame, group: str, length: str, tie: str, budget: int, padded: bool = False) -> DataFrame:
    """Batch numbers by first-come packing in order of length: a batch closes when the next chunk would exceed the budget.

    ``padded`` counts max * size instead of the sum. Where batches close follows from how many chunks of each length a group
    has: that table, not larger than the lengths that occur, is gone through in order, and the chunks find their batch by their
    rank among those of their length. A null length counts as 0.
    """
    size = F.coalesce(F.col(length), F.lit(0))
    keyed = ranked(chunks.select(F.col(group).alias("__g"), size.cast("long").alias("__n"), F.col(tie).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in chunks.columns]).alias("__row")), "__g", "__n", "__t", rank="__all")
    runs = keyed.groupBy("__g", "__n").agg(F.min("__all").alias("first"), F.count(F.lit(1)).alias("count"))
    kind = chunks.schema[group].dataType.simpleString()

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, used, held = None, 0, 0, 0
        for pdf in frames:
            out = []
            for g, n, first, count in pdf.itertuples(index=False):
                if now is None or not (g == now[0] or (pd.isna(g) and pd.isna(now[0]))):
                    now, batch, used, held = (g,), 0, 0, 0
                # how many more fit the open batch, and how many an empty one
                room = count if n == 0 else budget // n - held if padded else (budget - used) // n
                full = count if n == 0 else max(1, budget // n)
                room = min(count, max(room, 0 if held else 1))
                out.append((g, n, first, batch, room, full))
                rest = count - room
                if rest:
                    batch += -(-rest // full)
                    held = rest - (-(-rest // full) - 1) * full
                    used = held * n
                else:
                    held, used = held + room, used + room * n
            yield pd.DataFrame(out, columns=["g", "n", "first", "open", "room", "full"])

    plan = runs.repartition("__g").sortWithinPartitions("__g", "__n").mapInPandas(close, f"g {kind}, n long, first long, open long, room long, full long")
    met = keyed.join(plan, F.col("__g").eqNullSafe(F.col("g")) & (F.col("__n") == F.col("n")))
    at = F.col("__all") - F.col("first")
    batch = F.when(at < F.col("room"), F.col("open")).otherwise(F.col("open") + 1 + F.floor((at - F.col("room")) / F.col("full")))
    return met.select("__row.*", batch.alias("batch"))


# ---- chunks and masks --------------------------------------------------------------------------------------------


def snap(target: int, bounds: list[int], least: int) -> int:
    """Nearest of the last boundary before the target (if over ``least``) and the first at or behind it; ties go down."""
    from bisect import bisect_left

    i = bisect_left(bounds, target)
    low = bounds[i - 1] if i and bounds[i - 1] > least else None
    high = bounds[i] if i < len(bounds) else None
    if low is None:
        return target if high is None else high
    return low if high is None or target - low <= high - target else high


def chunk_spans(length: int, bounds: list[int], size_of, tail: int = 16, cap: int | None = None) -> list[tuple[int, int]]:
    """(start, end) spans that partition 0 … length, snapped to boundaries; a tail shorter than ``tail`` joins the last, and then no span is longer than ``cap``."""
    out, at = [], 0
    while at < length:
        end = at + size_of(len(out))
        end = length if end >= length else max(at + 1, snap(end, bounds, at))
        if length - end < tail:
            end = length
        if cap is not None:
            end = min(end, at + cap)
        out.append((at, end))
        at = end
    return out


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, low: int = 128, high: int = 1024, seed: int = 0, per_chunk: bool = True, cap: int | None = None, min_chunks: int = 1) -> DataFrame:
    """Chunks of whitespace tokens, snapped to line ends: id, chunk_idx, doc_start, doc_end.

    Targets are drawn by hash of (seed, id, chunk), so they do not depend on partitions.
    """
    import zlib

    def draw(doc, k: int) -> int:
        return low + zlib.crc32(f"{seed}:{doc}:{k if per_chunk else 0}".encode()) % (high - low + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                bounds, n = [], 0
                for line in (text or "").split("\n"):
                    n += len(line.split())
                    bounds.append(n)
                spans = chunk_spans(n, sorted(set(bounds) - {0}), lambda k, doc=doc: draw(doc, k), cap=cap)
                if len(spans) >= min_chunks:
                    rows += [(doc, k, a, b) for k, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["id", "chunk_idx", "doc_start", "doc_end"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"id {kind}, chunk_idx int, doc_start int, doc_end int").withColumnRenamed("id", id_col)


def unit_hash(*parts: Column) -> Column:
    """Number in [0, 1) from the MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def mask_tokens(tokens: DataFrame, doc: str, pos: str, token: str, rate: float = 0.15, seed: int = 0, special: tuple[str, ...] = ()) -> DataFrame:
    """Action of each position: mask (80 %), random (10 %), keep (10 %) of those chosen, and none; label where chosen."""
    chosen = (unit_hash(F.lit(seed), F.col(doc), F.col(pos)) < rate) & ~F.col(token).isin(*special) if special else unit_hash(F.lit(seed), F.col(doc), F.col(pos)) < rate
    u = unit_hash(F.lit(seed + 1), F.col(doc), F.col(pos))
    action = F.when(~chosen, "none").when(u < 0.8, "mask").when(u < 0.9, "random").otherwise("keep")
    return tokens.withColumn("action", action).withColumn("label", F.when(chosen, F.col(token)))


def choose_k(df: DataFrame, group: str, item: str, share: float, least: int = 1, seed: int = 0) -> DataFrame:
    """ceil(share * n) items of each group, at least ``least`` and at most n - 1, by hash."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    order = Window.partitionBy(group).orderBy(unit_hash(F.lit(seed), F.col(group), F.col(item)), item)
    k = F.least(F.greatest(F.ceil(n * share), F.lit(least)), n - 1)
    return df.withColumn("__k", k).withColumn("__r", F.row_number().over(order)).withColumn("chosen", F.col("__r") <= F.col("__k")).drop("__k", "__r")


def pad(arr: Column, n: Column, value) -> Column:
    return F.concat(arr, F.array_repeat(F.lit(value), F.greatest(n - F.size(arr), F.lit(0)).cast("int")))


def mask_with_numbers(rows: DataFrame, row: str, pos: str, token: str, value: str, low: float, high: float, seed: int = 0, special: tuple[str, ...] = ("[CLS]",), sentinel: float = 13.0, floor: float = -12.0, top: float = 12.0) -> DataFrame:
    """``rows`` (one a token; ``value`` is a log magnitude where the token is a number) with rate, action, input, input_value, label and label_value.

    Each row's rate is drawn between ``low`` and ``high``. Of the chosen tokens 80 % are masked, 10 % replaced, 10 % kept; a masked
    number has the sentinel for its value, a replaced one a random magnitude; labels are -100 (null as text) elsewhere.
    """
    rate = F.lit(low) + (high - low) * unit_hash(F.lit(seed), F.col(row))
    u = unit_hash(F.lit(seed + 2), F.col(row), F.col(pos))
    chosen = (unit_hash(F.lit(seed + 1), F.col(row), F.col(pos)) < F.col("rate")) & ~F.col(token).isin(*special)
    number = F.col(value).isNotNull()
    drawn = F.lit(floor) + (top - floor) * unit_hash(F.lit(seed + 3), F.col(row), F.col(pos))
    action = F.when(~chosen, "none").when(u < 0.8, "mask").when(u < 0.9, "random").otherwise("keep")
    a = F.col("action")
    out = rows.withColumn("rate", rate).withColumn("action", action)
    return out.withColumns({
        "input": F.when((a == "mask") & ~number, "[MASK]").when((a == "random") & ~number, F.md5(F.col(token).cast("binary"))).otherwise(F.col(token)),
        "input_value": F.when((a == "mask") & number, F.lit(sentinel)).when((a == "random") & number, drawn).otherwise(F.col(value)),
        "label": F.when((a != "none") & ~number, F.col(token)),
        "label_value": F.when((a != "none") & number, F.col(value)).otherwise(F.lit(-100.0)),
    })


def extract_chunk(arrays: dict[str, tuple[Column, object, object]], start: Column, end: Column) -> dict[str, Column]:
    """Slices [start, end) of parallel arrays, each between an opening and a closing value; name: (array, opening, closing)."""
    return {name: F.concat(F.array(F.lit(a)), F.slice(x, start + 1, F.greatest(end - start, F.lit(0))), F.array(F.lit(b))) for name, (x, a, b) in arrays.items()}


def from_offset(df: DataFrame, order: str, start: int) -> DataFrame:
    """The rows from place ``start`` on, in order: where a run that stopped goes on."""
    return ranked(df, order).filter(F.col("rank") >= start)


def length_stats(df: DataFrame, group: str, length: str) -> DataFrame:
    """Count, total, min, median (the value at n // 2), max and mean of a length in each group; rows are counted by length first, and the counts gone through."""
    by = df.groupBy(group, length).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(group).orderBy(F.col(length).asc_nulls_first()))
    whole = F.sum("__n").over(Window.partitionBy(group))
    placed = by.withColumn("__upto", upto).withColumn("__middle", F.floor(whole / 2))
    middle = F.when((F.col("__upto") > F.col("__middle")) & (F.col("__upto") - F.col("__n") <= F.col("__middle")), F.col(length))
    total = F.sum(F.col(length) * F.col("__n"))
    known = F.sum(F.when(F.col(length).isNotNull(), F.col("__n")))
    return placed.groupBy(group).agg(F.sum("__n").alias("n"), total.alias("total"), F.min(length).alias("min"), F.max(length).alias("max"), F.round(total / known, 4).alias("mean"), F.max(middle).alias("median"))


def drop_low_density(pages: DataFrame, group: str, order: str, text_col: str, curve: list[tuple[int, float]], least: float) -> DataFrame:
    """A new snapshot without pages under the density; groups that lose all their pages are gone. Adds density and n_dropped of the group."""
    scored = pages.withColumn("__ratio", deflate_ratio(F.col(text_col))).withColumn("density", adjusted_density(F.col(text_col), F.col("__ratio"), curve)).drop("__ratio")
    scored = written(scored, "scored")
    lost = scored.groupBy(group).agg(F.count_if(F.col("density") < least).alias("n_dropped"))
    return scored.filter(F.col("density") >= least).join(lost, group)
