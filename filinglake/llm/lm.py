"""Language-model scores of whole documents.

Words are counted over all training documents; a document trains unless the
CRC-32 of its id is divisible by 10. Three layers share these counts:

- the base: add-0.1 unigram probabilities of words and the end token;
- the vocabulary of the network: the end, the most frequent words
  (``net_words``, growing with the corpus), and buckets for all others by their last two bytes, inside which a
  word has its smoothed share of the bucket's count;
- the network: a gated recurrent unit with a class-factored softmax
  (:mod:`filinglake.llm.gru`), whose state runs through the whole document,
  in training as in scoring; only gradients are cut at a window's edge.

Documents are encoded once; training and scoring read the ids. Training
documents are dealt by a hash of id and content to groups of about
``GROUP_TOKENS`` tokens, and the groups in order to rounds, whose number grows with
theirs. In a round every group
starts from the common parameters and trains on its documents in the order of
the hash, each whole; the groups' parameters are then averaged by token
counts, in the order of the groups. Every token of every training document
trains once, and nothing depends on how the input is partitioned: scores on
other partitions differ by the rounding of single-precision sums alone.

Counts of the ``HEAD`` most frequent words at most travel to every task; rarer
words meet their counts in a join, so no step holds the vocabulary.

Null and empty texts are an end token alone; a text of any length is one run
of the network; a null id counts as the empty string; repeated rows each give
a row, and train each; words of equal count rank by their bytes; an empty
table gives an empty result; without training documents every token has the
base's unseen share. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglake.llm import gru
from filinglake.llm._shared import staged

HEAD = 400_000
LONGEST = 64  # bytes of a head word; longer ones are joined like rare ones
NET_WORDS = 1500  # words and hidden units of a corpus of up to NET_TOKENS training tokens; beyond that they grow with it
BUCKETS = 64
HIDDEN = 24
NET_TOKENS = 1 << 27
MANY_ROUNDS = 8
MOST_WORDS, MOST_HIDDEN = 60_000, 512
STREAMS = 256
GROUP_TOKENS = 1 << 22
HELD = 1 << 23  # tokens a task holds before it trains on them
BLOCKS = 16
END = b"\n"  # no word holds white space
LN10 = float(np.log(10))
ALPHA = 0.1


def net_words(total: int) -> int:
    """Words of the network: as the square root of the training tokens."""
    return min(MOST_WORDS, int(NET_WORDS * max(1.0, total / NET_TOKENS) ** 0.5))


def hidden_units(total: int) -> int:
    """Hidden units: as the fourth root of the training tokens."""
    return min(MOST_HIDDEN, int(HIDDEN * max(1.0, total / NET_TOKENS) ** 0.25))


def training_rounds(groups: int) -> int:
    """Rounds of training and averaging: as the cube root of the groups, so that more data makes a model that has learnt more, and a round has the more groups to share out."""
    return max(1, min(groups, 1 + round(groups ** (1 / 3))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, n) over all texts, the end token included; a task sends on its sums when it holds ``most`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                held.update(tokens(t.as_py()))
                if len(held) > most:
                    yield _counts(held)
                    held.clear()
            held[END] += b.num_rows
        if held:
            yield _counts(held)

    def _counts(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Rows(dict):
    """Rows of words; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Words:
    """What tasks need of the counts; bounded by ``HEAD`` words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, bucket_n: np.ndarray, bucket_v: np.ndarray):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.floor = total + ALPHA * (distinct + 1)
        self.bucket_den = bucket_n + ALPHA * (bucket_v + 1)
        most = net_words(total)
        net = [w for w in words[: most + 1] if w != END][:most]
        self.net_words = net
        at = {w: int(c) for w, c in zip(words, counts)}
        outputs = np.array([at.get(END, 0), *(at[w] for w in net), *bucket_n], float)
        rank = np.argsort(-outputs, kind="stable")
        self.output_counts = outputs[rank]
        self.place = np.empty(len(rank), np.int32)
        self.place[rank] = np.arange(len(rank), dtype=np.int32)
        self.end = int(self.place[0])

    def output_of(self) -> dict[bytes, int]:
        return {w: int(self.place[1 + i]) for i, w in enumerate(self.net_words)}

    def bucket_outputs(self) -> np.ndarray:
        return self.place[1 + len(self.net_words) :]

    def lookup(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        """Head word to row; and by row the output id, the base's log10 and the natural log inside the output id."""
        row = _Rows(zip(self.words, range(len(self.words))))
        net, buckets = self.output_of(), self.bucket_outputs()
        late = np.fromiter(map(bucket, self.words), np.int64, len(self.words))
        out, inside = buckets[late], np.log((self.counts + ALPHA) / self.bucket_den[late])
        for w, i in [(END, self.end), *net.items()]:
            if w in row:
                out[row[w]], inside[row[w]] = i, 0.0
        return row, out, np.log10((self.counts + ALPHA) / self.floor), inside


def collect_words(counts: DataFrame, head: int = HEAD) -> Words:
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # at most 64 log-scale bins for each factor e of a count: a bounded number of rows
    level = F.floor(F.log(F.col("n")) * 64)
    short = counts.filter(F.octet_length("word") <= LONGEST)
    kept, least = 0, None
    for r in sorted(short.groupBy(level.alias("b")).count().collect(), key=lambda r: -r.b):
        if kept + r["count"] > head:
            break
        kept, least = kept + r["count"], r.b
    table = short.filter(level >= (least if least is not None else 1 << 30)).toArrow()
    pairs = sorted(zip(table.column("n").to_pylist(), table.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    words, sizes = [w for _, w in pairs], np.array([n for n, _ in pairs], np.int64)
    most = net_words(total["n"] or 0)
    net = {*[w for w in words[: most + 1] if w != END][:most], END}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w not in net:
                    k = bucket(w)
                    n[k] += c
                    v[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(n), pa.array(v)], ["b", "n", "v"])

    n, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.select("word", "n").mapInArrow(fill, "b long, n long, v long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r.b], v[r.b] = r.n, r.v
    return Words(words, sizes, total["n"] or 0, total["v"] or 0, n, v)


_LOOKUPS: dict[str, tuple] = {}  # of the worker's present words


def lookup_of(name: str, words: Words) -> tuple:
    """Made once a worker. A task gets a copy of what its function names, but for functions of a module, so that only these reach ``_LOOKUPS``."""
    if name not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[name] = words.lookup()
    return _LOOKUPS[name]


def drop_lookups() -> None:
    """The worker encodes no more."""
    _LOOKUPS.clear()


def encode(docs: DataFrame, words: Words) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with ids of the network, the base's log10 of head words, the natural log inside their ids, and the rare words."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(words)  # bounded by HEAD words
    name = uuid.uuid4().hex
    fields = "key long, doc_id long, ids binary, n_tokens long, n_tail long, base double, inside double, tail array<struct<word:binary,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        row, out, base, inside = lookup_of(name, held)
        buckets, get = held.bucket_outputs(), row.__getitem__
        at_end = base[row[END]] if END in row else float(np.log10((0 + ALPHA) / held.floor))
        for b in batches:
            parts, ends, tails, late_at, late_bucket, n = [], [], [], [], [], 0
            for t in b.column(2):
                w = tokens(t.as_py())
                found = np.full(len(w) + 1, -2, np.int32)
                found[:-1] = np.fromiter(map(get, w), np.int32, len(w))
                rare = [w[i] for i in np.flatnonzero(found == -1)]
                if rare:
                    late_at.append(n + np.flatnonzero(found == -1))
                    late_bucket += map(bucket, rare)
                n += len(found)
                parts.append(found)
                ends.append(n)
                tails.append(Counter(rare))
            if not ends:
                continue
            r = np.concatenate(parts)
            stops = np.array(ends)
            starts = np.concatenate([[0], stops[:-1]])
            last = stops - 1
            pos, late = np.concatenate(late_at) if late_at else np.zeros(0, np.int64), np.array(late_bucket, np.int64)
            # rows -1 and -2 pick wrong entries at first, which are then overwritten
            ids = out.take(r, mode="wrap") if len(out) else np.zeros(n, np.int32)
            ids[last] = held.end
            ids[pos] = buckets[late]
            part = base.take(r, mode="wrap") if len(base) else np.zeros(n)
            part[last] = at_end
            part[pos] = 0.0
            base_sums = np.add.reduceat(part, starts)
            part = inside.take(r, mode="wrap") if len(inside) else np.zeros(n)
            part[last] = 0.0
            part[pos] = -np.log(held.bucket_den[late])
            inside_sums = np.add.reduceat(part, starts)
            raw = [x.tobytes() for x in np.split(ids.astype("<u2"), stops[:-1])]
            flat = [(w, n) for tail in tails for w, n in tail.items()]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in tails])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.binary()), pa.array([n for _, n in flat], pa.int64())], ["word", "n"]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(stops - starts), pa.array([sum(x.values()) for x in tails], pa.int64()), pa.array(base_sums), pa.array(inside_sums), listed], [f.split()[0] for f in fields.split(", ")]
            )

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return staged(rows.mapInArrow(run, fields), "encoded")


def train(encoded: DataFrame, words: Words, rounds: int | None = None, rate: float = 0.05, group_tokens: int = GROUP_TOKENS) -> dict[str, np.ndarray]:
    """Parameters after ``rounds`` of training in groups and averaging; ``encoded`` has doc_id and ids of the training documents."""
    spark = encoded.sparkSession
    p = gru.init(len(words.place), hidden_units(words.total))
    gru.warm(p, words.output_counts)
    groups = max(1, -(-words.total // group_tokens))
    rounds, salts = min(rounds or training_rounds(groups), groups), max(1, int(groups**0.5))
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    mark = F.xxhash64("doc_id", "ids")
    dealt = encoded.select(F.pmod(mark, F.lit(groups)).alias("g"), mark.alias("mark"), "doc_id", "ids")
    if rounds > MANY_ROUNDS:  # written once in the order of the groups, so that a round reads its own part alone
        dealt = staged(dealt.repartitionByRange(F.col("g"), F.col("mark")).sortWithinPartitions("g", "mark"), "dealt")
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((p, words.end))

        def local(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            drop_lookups()
            start, end = sent.value
            now, model, memory, seen, held, n = None, None, None, 0, [], 0

            def fit() -> int:
                return model.train(np.concatenate(held).astype(np.int32), np.cumsum([len(x) for x in held]), memory, rate) if held else 0

            def trained() -> pa.RecordBatch:
                cuts = np.array_split(gru.flat(model.p).astype(np.float64) * seen, BLOCKS)
                return pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array(np.full(BLOCKS, now % salts)), pa.array(np.full(BLOCKS, now)), pa.array(np.full(BLOCKS, float(seen))), pa.array([c.tobytes() for c in cuts], pa.binary())], ["block", "salt", "g", "w", "v"])

            for b in batches:
                for g, ids in zip(b.column(0).to_pylist(), b.column(1)):
                    if g != now:
                        if now is not None:
                            seen += fit()
                            yield trained()
                        now, seen, held, n = g, 0, [], 0
                        model, memory = gru.Model({k: v.copy() for k, v in start.items()}, end, batch=STREAMS), gru.memory_of(start)
                    held.append(np.frombuffer(ids.as_py(), "<u2"))
                    n += len(held[-1])
                    if n >= HELD:
                        seen += fit()
                        held, n = [], 0
            if now is not None:
                seen += fit()
                yield trained()

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("g")  # sums in one order, whatever the partitions
            total = sum(np.frombuffer(v, np.float64) for v in pdf["v"])
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "salt": [0], "g": [pdf["salt"].iloc[0]], "w": [pdf["w"].sum()], "v": [total.tobytes()]})

        schema = "block long, salt long, g long, w double, v binary"
        first, behind = (-(-turn * groups // rounds), -(-(turn + 1) * groups // rounds))
        mine = dealt.filter((F.col("g") >= first) & (F.col("g") < behind)).repartition(width, "g").sortWithinPartitions("g", "mark", "doc_id", "ids").select("g", "ids")
        parts = mine.mapInArrow(local, schema).groupBy("block", "salt").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema).collect()
        if parts:  # one model: a fixed number of bytes
            parts.sort(key=lambda r: r.block)
            p = gru.unflat(np.concatenate([np.frombuffer(r.v, np.float64) / r.w for r in parts]), p)
    return p


def score(encoded: DataFrame, words: Words, params: dict[str, np.ndarray], counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``encoded``."""
    sent = encoded.sparkSession.sparkContext.broadcast(params)  # one model
    end = words.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_lookups()
        model = gru.Model(sent.value, end, batch=2 * STREAMS)
        for b in batches:
            if not b.num_rows:
                continue
            docs = [np.frombuffer(x.as_py(), "<u2") for x in b.column(1)]
            longest = np.argsort([-len(x) for x in docs], kind="stable")  # the longest first: streams are of near-equal length
            docs = [docs[i] for i in longest]
            stops = np.cumsum([len(x) for x in docs])
            sums = np.empty(len(docs))
            sums[longest] = np.add.reduceat(model.score(np.concatenate(docs).astype(np.int32), stops).astype(np.float64), np.concatenate([[0], stops[:-1]]))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(sums)], ["key", "doc_id", "n_tokens", "n_tail", "base", "inside", "net"])

    scored = encoded.select("key", "ids", "doc_id", "n_tokens", "n_tail", "base", "inside").mapInArrow(run, "key long, doc_id long, n_tokens long, n_tail long, base double, inside double, net double")
    rare = encoded.select("key", F.explode("tail").alias("t")).select("key", F.col("t.word").alias("word"), F.col("t.n").alias("k"))
    met = rare.join(counts, "word", "left").groupBy("key").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("__s"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("__known"))
    s, known = F.coalesce("__s", F.lit(0.0)), F.coalesce("__known", F.lit(0))
    end_known = 1 if words.total else 0
    return scored.join(met, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_tokens") - (1 - end_known) - F.col("n_tail") + known).alias("n_known"),
        (F.col("base") + s - F.col("n_tail") * float(np.log10(words.floor))).alias("base_score"),
        ((F.col("inside") + F.col("net")) / LN10 + s).alias("score"),
    )


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = staged(word_counts(rows.filter(~held_out(F.col("doc_id")))), "word-counts")
    words = collect_words(counts, head)
    encoded = encode(rows, words)
    params = train(encoded.filter(~held_out(F.col("doc_id"))), words, group_tokens=group_tokens)
    out = score(encoded, words, params, counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
