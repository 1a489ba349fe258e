"""Benchmark decontamination by greedy string tiling.

Texts become words (runs of letters, digits and underscores, lower-cased; in
scripts without spaces each character is a word).
Seeds are windows of ``min_match`` words whose running Karp-Rabin hash occurs
in a benchmark item. For a document and an item that share seeds, the longest
match of unmarked words is marked again and again, until none of ``min_match``
words is left; matches do not overlap on either side and their order is free,
so reordered passages are caught. A pair is reported if the marked words cover
at least ``coverage`` of the item. An item shorter than ``min_match`` words
must occur as one piece; an item of one word is thus found wherever it stands.

The benchmark meets the documents in blocks of ``BLOCK_BYTES`` of text and at most one item more,
equal items once, one block after the other; a block is all that travels to a task. Each block is a
pass over the documents, of which nothing is shuffled; where one is not enough,
the marks of each pass are written before the next one starts. Null and empty
texts match nothing, items without words are never found, texts of any length
are searched whole, repeated rows and equal items are judged each, extra
columns are ignored. Matches are compared word by word: a hash collision cuts
a match where the words differ and takes no word from it. Of equally long matches the first in the text counts, then
the first in the item. An empty benchmark finds nothing, an empty table of documents gives none.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filinglake.llm._shared import by_name, by_position, staged

#: Thai, Lao, Khmer, kana and Han, which are written without spaces.
UNSPACED = "\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(r"\w+")
UNSPACED_WORD = re.compile(rf"[{UNSPACED}]|(?:(?![{UNSPACED}])\w)+")
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
BLOCK_BYTES = 16 << 20
MOST_SEEDS = 4_000_000  # laid out at once
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SCHEMA = "doc_id long, item_id long, n_tiles int, covered_words int, item_words int, coverage double"


def word_list(text: str | None) -> list[str]:
    low = (text or "").lower()
    return (UNSPACED_WORD if not low.isascii() and HAS_UNSPACED.search(low) else WORD).findall(low)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows, each from the one before in constant time.

    A prefix sum of id * BASE**position gives every window as a difference; BASE is odd, so the power of
    its inverse brings each window back to position 0.
    """
    n = len(ids)
    if n < width:
        return np.zeros(0, np.uint64)
    one = np.ones(1, np.uint64)
    powers = np.cumprod(np.concatenate([one, np.full(n - 1, BASE)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([one, np.full(n - width, INVERSE)]), dtype=np.uint64)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(ids.astype(np.uint64) * powers, dtype=np.uint64)])
    return (prefix[width:] - prefix[:-width]) * back


def tiles(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length) from seed positions ``pairs`` (rows of (a, b))."""
    diagonal = pairs[:, 0] - pairs[:, 1]
    order = np.lexsort((pairs[:, 0], diagonal))
    p, d = pairs[order], diagonal[order]
    cut = np.flatnonzero((d[1:] != d[:-1]) | (p[1:, 0] != p[:-1, 0] + 1)) + 1
    heap = []
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(p)]):  # a run of seeds on a diagonal is one maximal match
        x, y, n = int(p[s, 0]), int(p[s, 1]), e - s + width - 1
        same = a[x : x + n] == b[y : y + n]
        if same.all():
            heapq.heappush(heap, (-n, x, y))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):  # a seed was a collision
            if j - i >= width:
                heapq.heappush(heap, (i - j, x + i, y + i))
    used_a, used_b, out, left = np.zeros(len(a), bool), np.zeros(len(b), bool), [], len(b)
    while heap and left >= width:
        n, x, y = heapq.heappop(heap)
        n = -n
        taken = used_a[x : x + n] | used_b[y : y + n]
        if not taken.any():
            used_a[x : x + n] = used_b[y : y + n] = True
            out.append((x, y, n))
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):  # what is still free of it competes again
            if e - s >= width:
                heapq.heappush(heap, (-(e - s), x + s, y + s))
    return out


class Matcher:
    """Seeds of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, coverage: float):
        self.coverage = coverage
        self.vocab: dict[str, int] = {}
        alike: dict[tuple[int, ...], list[int]] = {}
        for item_id, text in items:
            if w := word_list(text):
                alike.setdefault(tuple(self.vocab.setdefault(x, len(self.vocab) + 1) for x in w), []).append(item_id)
        #: Items of equal words are matched once.
        self.items = [(names, np.array(ids, np.int64)) for ids, names in alike.items()]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {min(min_match, len(ids)) for _, ids in self.items}:
            hashes, owner, at = [], [], []
            for k, (_, ids) in enumerate(self.items):
                if min(min_match, len(ids)) == width:
                    h = rolling(ids, width)
                    hashes.append(h)
                    owner.append(np.full(len(h), k))
                    at.append(np.arange(len(h)))
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            self.seeds[width] = h[order], np.concatenate(owner)[order], np.concatenate(at)[order]

    def match(self, text: str | None) -> Iterator[tuple[int, int, int, int, float]]:
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in word_list(text)], np.int64)
        for width, (hashes, owner, at) in self.seeds.items():
            if len(ids) < width:
                continue
            unknown = np.concatenate([[0], np.cumsum(ids == 0)])
            live = np.flatnonzero(unknown[width:] == unknown[:-width])  # windows of benchmark words only
            if not len(live):
                continue
            h = rolling(ids, width)[live]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            live, lo, hi = live[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(live):
                continue
            for k, where, place in self._by_item(live, lo, hi, owner, at):
                names, item = self.items[k]
                touched = np.zeros(len(item) + 1, np.int64)
                np.add.at(touched, place, 1)
                np.add.at(touched, np.minimum(place + width, len(item)), -1)
                if np.count_nonzero(np.cumsum(touched[:-1])) < self.coverage * len(item):
                    continue  # not even all seeds together cover enough
                found = tiles(ids, item, np.stack([where, place], axis=1), width)
                covered = sum(n for _, _, n in found)
                if covered >= self.coverage * len(item):
                    for item_id in names:
                        yield item_id, len(found), covered, len(item), covered / len(item)

    @staticmethod
    def _by_item(live, lo, hi, owner, at) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, positions in the text, positions in the item) of the seeds.

        All seeds are laid out at once if they are few; else item by item, so that memory holds one item's seeds.
        """
        counts = hi - lo
        if counts.sum() <= MOST_SEEDS:
            slot = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            where, who, place = np.repeat(live, counts), owner[slot], at[slot]
            order = np.argsort(who, kind="stable")
            where, who, place = where[order], who[order], place[order]
            cuts = np.flatnonzero(who[1:] != who[:-1]) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(who)]):
                yield int(who[s]), where[s:e], place[s:e]
            return
        runs, back = np.unique(lo, return_inverse=True)
        length = np.zeros(len(runs), np.int64)
        length[back] = counts
        held: dict[int, list[tuple[int, int]]] = {}
        for r, (start, n) in enumerate(zip(runs.tolist(), length.tolist())):
            for j in range(start, start + n):
                held.setdefault(int(owner[j]), []).append((r, int(at[j])))
        by_run = live[np.argsort(back, kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(back, minlength=len(runs)))])
        for k, seeds in held.items():
            where = [by_run[starts[r] : starts[r + 1]] for r, _ in seeds]
            yield k, np.concatenate(where), np.concatenate([np.full(len(w), p) for w, (_, p) in zip(where, seeds)])


def matches(rows: DataFrame, benchmark: DataFrame, min_match: int, coverage: float, item_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """One row (doc_id, item_id, …) for each row of ``rows`` (doc_id, text) and item that it covers enough of; the blocks of the benchmark come in turn."""
    spark = rows.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    # copies of an item travel once; where there are any, a key stands for the text until the end
    texts = items.groupBy("t").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("copies")).withColumn("size", F.octet_length("t"))
    whole = staged(texts.withColumn("key", F.monotonically_increasing_id()), "items")
    found = whole.agg(F.sum("size").alias("bytes"), F.max("copies").alias("copies")).first()
    buckets, copied = max(1, -(-(found["bytes"] or 0) // block_bytes)), (found["copies"] or 0) > 1
    before = F.coalesce(F.sum("size").over(Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = whole.select("key", "size", F.pmod(F.xxhash64("t"), F.lit(buckets)).alias("bucket")).withColumn("part", F.floor(before / block_bytes))
    cut = staged(whole.join(parts.select("key", "bucket", "part"), "key"), "blocks")
    blocks = cut.select("bucket", "part").distinct().orderBy("bucket", "part").collect()  # a row a block
    n, out = len(blocks), None
    for block in blocks:
        mine = cut.filter((F.col("bucket") == block.bucket) & (F.col("part") == block.part))
        held = [(r.name, r.t) for r in mine.select(F.col("key" if copied else "i").alias("name"), "t").toLocalIterator()]
        sent = spark.sparkContext.broadcast(held)  # block_bytes and one item more

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, min_match, coverage)
            for b in batches:
                found = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for m in matcher.match(t.as_py())]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage"])

        one = rows.mapInArrow(scan, SCHEMA)
        if n > 1:
            one = staged(one, "matches")
            sent.unpersist()
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    if not copied:
        return out
    every = items.join(whole.select("t", F.col("key").alias("item_id")), "t").select("item_id", "i")
    return out.join(every, "item_id").select("doc_id", F.col("i").alias("item_id"), *out.columns[2:])


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and benchmark item that it covers enough of."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return matches(rows, benchmark, min_match, coverage, item_col, "text", block_bytes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.6, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that match no item, in their own columns; each row is judged by its own text.

    A benchmark of one block filters the documents in place. Beyond that they are written once with a row number, which the passes mark.
    """
    given, (docs, name) = docs, by_position(docs)
    text_col = name(text_col)
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index(text_col)
    items = benchmark.select("item_id", "text").filter("text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        found = matches(rows.select(F.col("__row").alias("doc_id"), F.col(text_col).alias("text")), items, min_match, coverage, "item_id", "text", block_bytes)
        return rows.join(found.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti").select(*by_name(given))
    sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in items.toLocalIterator()])  # bounded by block_bytes

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, min_match, coverage)
        for b in batches:
            yield b.filter(pa.array([next(matcher.match(t.as_py()), None) is None for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, schema).select(*by_name(given))
