"""Audit of how five filters interact, whatever their order.

Filters, by the texts that fail: A under 100 words; B distinct words under 80
in a hundred; C over ten capitals A-Z in a hundred code points; D any of
``#$%&*|``; E the text of a smaller id. Words are runs without ASCII blanks.

Documents go as an RDD by the XXH64 of their text. The task that reads them
settles the copies that it can see, so that a text leaves it once (or once in
``HELD_BYTES`` of distinct texts) however often it occurs, and settled rows
travel without text. Where a fingerprint arrives, its rows come in order of
id; a chain holds each different text of that fingerprint with its least id,
and rows with a greater id get filter E's bit. ``combineByKey`` adds up, for each
part, how many documents have each of the 32 masks of failures; what any order of
filters removes follows from those vectors alone.

A null text is empty; a null id is smaller than none and greater than none;
rows alike in id and text do not count as copies of each other; the label of
an id is the greatest of its labels. Null languages are the part of the empty string.
Other columns are ignored. An empty table has no parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
HELD_BYTES = 64 << 20  # distinct texts that a reading task remembers
ROUTED_ROWS = 50_000  # documents, at most, that a routing task gets on average
CAPITALS = bytes(range(65, 91))
SYMBOLS = re.compile(rb"[#$%&*|]")


def failures(text: str, raw: bytes) -> int:
    """Mask of the filters A to D that a text fails; ``raw`` is its UTF-8."""
    words = raw.split()  # bytes are split at ASCII blanks alone
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    failed = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), SYMBOLS.search(raw) is not None)
    return sum(f << k for k, f in enumerate(failed))


def fingerprint(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw)


def _read(rows: Iterator[tuple]) -> Iterator[tuple]:
    """((fingerprint, id), (text, mask, rows by part)) for the least id of each text seen, ((any number, 0), (None, id, part, mask, n)) for all others."""
    held: dict[bytes, list] = {}
    size = turn = 0

    def settled(doc_id, mask: int, parts: dict[str, int]) -> Iterator[tuple]:
        nonlocal turn
        for part, n in parts.items():
            turn += 1
            yield (turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, 0), (None, doc_id, part, mask, n)

    def flush() -> Iterator[tuple]:
        for raw, (doc_id, mask, parts) in held.items():
            yield (fingerprint(raw), doc_id), (raw, mask, parts)
        held.clear()

    for doc_id, text, part in rows:
        text, part = text or "", part or ""
        raw = text.encode("utf-8", "surrogatepass")
        if doc_id is None:
            yield from settled(None, failures(text, raw), {part: 1})
            continue
        entry = held.get(raw)
        if entry is None:
            held[raw] = [doc_id, failures(text, raw), {part: 1}]
            size += len(raw) + 200
            if size > HELD_BYTES:
                yield from flush()
                size = 0
        elif doc_id == entry[0]:
            entry[2][part] = entry[2].get(part, 0) + 1
        else:
            if doc_id < entry[0]:
                doc_id, entry[0], old, entry[2] = entry[0], doc_id, entry[2], {part: 1}
            else:
                old = {part: 1}
            yield from settled(doc_id, entry[1] | COPY, old)
    yield from flush()


def _chained(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, id, part, mask, n) from rows sorted by fingerprint and id; the key is the id, or spreads rows without one."""
    now, chain = None, {}
    for (key, doc_id), value in rows:
        if value[0] is None:
            yield (key >> 1 if value[1] is None else value[1], *value[1:])
            continue
        if key != now:
            now, chain = key, {}  # full text to its least id; more than one text only where fingerprints collide
        raw, mask, parts = value
        least = chain.setdefault(raw, doc_id)
        for part, n in parts.items():
            yield doc_id, doc_id, part, mask | COPY if doc_id > least else mask, n


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(key, doc_id, part, mask, n) for every document; bit k of ``mask`` is set if it fails filter k, rows alike may be one row with their count."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(part_col).cast("string")).rdd
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), docs.count() // ROUTED_ROWS + 1)
    routed = rows.mapPartitions(_read).repartitionAndSortWithinPartitions(width, partitionFunc=lambda key: key[0])
    return spark.createDataFrame(routed.mapPartitions(_chained), "key long, doc_id long, part string, mask int, n long", verifySchema=False)


def copy_ids(docs: DataFrame, **columns: str) -> DataFrame:
    """Ids of the documents whose text a smaller id has."""
    return masks(docs, **columns).filter(F.col("mask").bitwiseAND(COPY) != 0).select("doc_id")


def _vectors(rows: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts): for each mask the documents, the good and the toxic ones."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(is_one("quality"), is_one("toxic"))
    keyed = rows.withColumn("real", F.col("doc_id").isNotNull())  # rows without id have no label
    known = keyed.join(flags.withColumn("real", F.lit(True)), ["key", "real"], "left")
    counts = known.select("part", "mask", "n", (F.coalesce("quality", F.lit(0)) * F.col("n")).alias("good"), (F.coalesce("toxic", F.lit(0)) * F.col("n")).alias("bad"))

    def put(vector: list[int], row) -> list[int]:
        mask, *figures = row
        for k, v in enumerate(figures):
            vector[3 * mask + k] += v
        return vector

    def add(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b)]

    return counts.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: put([0] * (3 * MASKS), row), put, add)


def _orders(part: str, vector: list[int]) -> Iterator[tuple]:
    """The figures of every step of every order of the filters."""
    n, good, toxic = vector[0::3], vector[1::3], vector[2::3]
    share = [120 // m.bit_count() if m else 0 for m in range(MASKS)]  # orders in which a given failed filter of the mask comes first
    shapley = [sum(n[m] * share[m] for m in range(MASKS) if m >> k & 1) for k in range(len(FILTERS))]
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            k = FILTERS.index(name)
            bit = 1 << k
            here = [m for m in range(MASKS) if m & bit and not m & before]
            late = [m for m in range(MASKS) if m & bit and m & before]
            before |= bit
            yield (
                part, "".join(order), step, sum(n[m] for m in range(MASKS) if not m & before), sum(n[m] for m in here), sum(n[m] for m in late), n[bit], sum(good[m] for m in here), sum(toxic[m] for m in here), shapley[k]
            )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row a part, order and step: documents kept, removed here, failing but removed before, failing this filter alone, labelled ones lost, and the filter's share over all orders."""
    rows = _vectors(masks(docs, **columns), labels).flatMap(lambda p: _orders(*p))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)
