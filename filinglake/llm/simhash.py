"""SimHash near-duplicates by the generalised pigeonhole principle.

Texts are lower-cased (A-Z), cut into words and word shingles, and each
shingle hashed with XXH64; a fingerprint bit is set if it is set in over half
the hashes, repeats included. Equal fingerprints are one class, so copies are
never paired.

For links at up to k differing bits, the 64 bits are dealt into m groups with
thresholds t_i >= -1 whose sum is k - m + 1: any linked pair then differs by
at most t_i bits in some group i (-1 leaves a group out). Correlated bits go
into one group, so that groups differ in as many values as possible. Number
and thresholds come from dynamic programming over candidate counts estimated
on a sample of fingerprints, scaled to their true number; the sample decides
cost, never results. Each fingerprint is filed under its own value of each
group and probes the values within the threshold; what meets is verified on
all 64 bits. Keys with more than ``BLOCK`` entries are dealt out as pairs of
blocks, so no task holds an unbounded group, and each meeting returns a
minimum spanning forest of its links by bits, not the links, so that dense
groups stay linear.

Null texts are empty; texts without a word have fingerprint 0 and link like
any other; very long texts are hashed in pieces. Repeated rows give repeated
rows. Null ids never name a component. Of equal least ids, either row does.
Empty tables give empty results; only the id and the text are read, so further
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglake.llm._shared import by_name, by_position, spread_join, staged
from filinglake.llm.components import connected_components

BITS = 64
SAMPLE = 4096
BLOCK = 8192
#: Relative costs of a filed or probing row and of one verified pair.
ROW_COST, PAIR_COST = 3.0, 0.006


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) <= width:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*[w[i:] for i in range(width)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", extra: Column | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and the number ``extra`` as node if it is given."""
    more = [] if extra is None else [extra.cast("long").alias("node")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *["node" for _ in b.columns[2:]]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + (", node long" if more else ""))


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size; each is grown from a seed by the highest mean correlation."""
    bits = np.unpackbits(sample.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(0)
    z = (bits - bits.mean(0)) / np.where(spread > 0, spread, 1)
    corr = np.abs(z.T @ z) / max(len(bits), 1)
    free, out = list(range(BITS)), []
    for i in range(m):
        room = (BITS - sum(map(len, out))) // (m - i)
        seed = max(free, key=lambda b: (corr[b, free].sum(), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < room:
            best = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def choose_plan(sample: np.ndarray, n: int, k: int, most_groups: int = 8, most_threshold: int = 2, whole: bool = False) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated cost, by dynamic programming over thresholds for each number of groups.

    With ``whole``, one group of no bits, in which all meet block by block, competes too.
    """
    from math import comb

    best, plan = float("inf"), None
    if whole:
        best, plan = n * 2 * -(-n // BLOCK) * ROW_COST + n * n * PAIR_COST, [([], 0)]
    scale = n * n / max(len(sample) ** 2, 1)
    for m in range(1, min(most_groups, k + 1) + 1):
        groups = group_bits(sample, m)
        need = k - m + 1
        costs: list[list[tuple[float, int]]] = []
        for g in groups:
            mask = np.int64(np.array(sum(1 << b for b in g), dtype=np.uint64).astype(np.int64))
            part = (sample & mask).view(np.uint64)
            at = np.bincount(np.bitwise_count(part[: len(part) // 2, None] ^ part[None, len(part) // 2 :]).ravel(), minlength=BITS + 1) if len(part) > 1 else np.zeros(BITS + 1)
            seen, rows = at.sum() or 1, 0
            options = [(0.0, -1)]
            for t in range(most_threshold + 1):
                rows += comb(len(g), t)
                # half of the sample's pairs stand for all; a count below one chance in a uniform group is raised to it
                share = max(at[: t + 1].sum() / seen, rows / 2.0 ** len(g))
                options.append((n * (rows + (t > 0)) * ROW_COST + share * len(sample) ** 2 * scale * PAIR_COST, t))
            costs.append(options)
        state = {0: (0.0, ())}
        for options in costs:
            nxt: dict[int, tuple[float, tuple]] = {}
            for s, (c, ts) in state.items():
                for cost, t in options:
                    if (x := s + t) not in nxt or c + cost < nxt[x][0]:
                        nxt[x] = (c + cost, (*ts, t))
            state = nxt
        fit = [v for s, v in state.items() if s >= need]
        if fit and (v := min(fit))[0] < best:
            best, plan = v[0], [(g, t) for g, t in zip(groups, v[1]) if t >= 0]
    if plan is None:
        raise ValueError(f"no grouping allows {k} differing bits")
    return plan


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probe(p: int, own: Column):
    return lambda x: F.struct(F.lit(p).alias("p"), own.bitwiseXOR(x).alias("key"), F.lit(True).alias("probe"))


def _filed(fp: Column, plan: list[tuple[list[int], int]]) -> Column:
    """Array of (p, key, probe): the own value of each group, and the values within its threshold for the probes."""
    from itertools import combinations

    parts = []
    for p, (bits, t) in enumerate(plan):
        own = fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        flips = [0] + [sum(1 << b for b in c) for r in range(1, t + 1) for c in combinations(bits, r)]
        parts.append(F.array(F.struct(F.lit(p).alias("p"), own.alias("key"), F.lit(False).alias("probe"))))
        if t > 0:
            table = F.array(*[F.lit(_signed(x)) for x in flips])
            parts.append(F.transform(table, _probe(p, own)))
    return F.concat(*parts)


class Forest:
    """Minimum spanning forest of links by differing bits, kept up as links arrive in blocks.

    Whatever two nodes a left-out link joins, the forest joins them by links of no more bits.
    """

    HELD = 2_000_000  # links before the forest is taken again

    def __init__(self, n: int):
        self.n = n
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> None:
        self.parts.append((x, y, bits))
        self.held += len(x)
        if self.held > self.HELD:
            self.parts = [self.links()]
            self.held = len(self.parts[0][0])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, bits = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 3
        lab, kept = np.arange(self.n), []
        for level in np.unique(bits):
            at = np.flatnonzero(bits == level)
            while len(at := at[lab[x[at]] != lab[y[at]]]):  # join one tree with all its neighbours at a time
                root = lab[x[at[0]]]
                mine = at[(lab[x[at]] == root) | (lab[y[at]] == root)]
                other = np.where(lab[x[mine]] == root, lab[y[mine]], lab[x[mine]])
                new, first = np.unique(other, return_index=True)
                kept.append(mine[first])
                lab[np.isin(lab, new)] = root
        kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return x[kept], y[kept], bits[kept]


def forest(index: np.ndarray, probes: np.ndarray | None, k: int) -> list[tuple[int, int]]:
    """Minimum spanning forest of the links between the two sides (within ``index`` if there are no probes)."""
    same = probes is None
    left = index.view(np.uint64)
    right = left if same else probes.view(np.uint64)
    nodes, inverse = np.unique(left if same else np.concatenate([left, right]), return_inverse=True)
    li, ri = inverse[: len(left)], inverse[len(left) :] if not same else inverse[: len(left)]
    out = Forest(len(nodes))
    step = max(1, (1 << 21) // max(len(right), 1))
    for at in range(0, len(left), step):
        bits = np.bitwise_count(left[at : at + step, None] ^ right[None, :])
        rows, cols = np.nonzero(bits <= k)
        x, y, d = li[at + rows], ri[cols], bits[rows, cols]
        keep = x < y if same else x != y
        if keep.any():
            out.add(x[keep], y[keep], d[keep])
    x, y, _ = out.links()
    signed = nodes.view(np.int64)
    return list(zip(signed[x].tolist(), signed[y].tolist()))


def every_link(left: dict[str, np.ndarray], right: dict[str, np.ndarray], k: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of all links at <= k bits between the two sides whose labels differ and whose shingle sets may be alike, the lesser first, in bounded pieces.

    The differing bits of two parity sketches never exceed the shingles that only one of the texts has, so no pair that is alike is left out.
    """
    most = (1 - similarity) / (1 + similarity)
    step = max(1, (1 << 21) // max(len(right["fp"]), 1))
    for at in range(0, len(left["fp"]), step):
        near = np.bitwise_count(left["fp"].view(np.uint64)[at : at + step, None] ^ right["fp"].view(np.uint64)[None, :]) <= k
        rows, cols = np.nonzero(near & (left["lab"][at : at + step, None] != right["lab"][None, :]))
        for s in range(0, len(rows), 1 << 17):
            i, j = at + rows[s : s + (1 << 17)], cols[s : s + (1 << 17)]
            apart = np.bitwise_count(left["sketch"][i] ^ right["sketch"][j]).sum(1, dtype=np.int64)
            a, b = left["node"][i], right["node"][j]
            keep = (apart <= most * (left["size"][i] + right["size"][j]) + 1e-6) & (a != b)
            if keep.any():
                yield np.minimum(a, b)[keep], np.maximum(a, b)[keep]


def plan_of(classes: DataFrame, k: int, whole: bool = False) -> list[tuple[list[int], int]]:
    n = classes.count()
    every = max(1, n // (2 * SAMPLE))  # thinned by hash before any row moves
    rows = classes.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(SAMPLE).collect()
    return choose_plan(np.array([r.fp for r in rows] or [0], dtype=np.int64), max(n, 1), k, whole=whole)


def _links(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _array(column: pa.Array) -> np.ndarray:
    """A column as numpy has it; a row of words a row for sketches."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def meetings(rows: DataFrame, plan: list[tuple[list[int], int]], block: int, work: Callable[[dict, dict | None], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Links (a, b) that ``work`` finds where rows (fp and more) meet under a key: it gets the filed rows, and the probing ones where a group has a threshold."""
    more = rows.columns
    probing = {p for p, (_, t) in enumerate(plan) if t > 0}
    filed = rows.select(*more, F.explode(_filed(F.col("fp"), plan)).alias("e")).select(*more, "e.p", "e.key", "e.probe")
    crowded = filed.groupBy("p", "key").count().filter(F.col("count") > block).select("p", "key", F.ceil(F.col("count") / block).cast("int").alias("g"))
    # a crowded key's rows go to a pair of blocks each: row i meets column j; few keys are crowded, and adaptive
    # execution broadcasts them only if their measured size allows
    crowded = staged(crowded, "crowded")
    two = F.col("p").isin(*probing) if probing else F.lit(False)
    if crowded.limit(1).count():
        dealt = filed.join(crowded, ["p", "key"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
        own = F.pmod(F.xxhash64("fp", *[c for c in more if c == "node"]), F.col("g")).cast("int")
        others = F.sequence(F.lit(0), F.col("g") - 1)
        as_row = F.transform(others, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(False).alias("side")))
        as_col = F.transform(others, lambda j: F.struct(j.alias("i"), own.alias("j"), F.lit(True).alias("side")))
        single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("probe").alias("side")))
        place = F.when(F.col("g") == 1, single).when(two & F.col("probe"), as_col).when(two, as_row).otherwise(F.concat(as_row, as_col))
        dealt = dealt.withColumn("b", F.explode(place)).select("p", "key", "b.i", "b.j", F.col("b.side").alias("side"), F.when(F.col("g") == 1, two).otherwise(True).alias("two"), *more)
    else:
        dealt = filed.select("p", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("probe").alias("side"), two.alias("two"), *more)
    keys = ["p", "key", "i", "j"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        waiting: list[pa.RecordBatch] = []

        def gathered(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in found:
                waiting.append(x)
                if len(waiting) >= 1000 or x.num_rows > 10_000:
                    yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                    waiting.clear()

        def group(_, two, parts) -> Iterator[pa.RecordBatch]:
            side, *cols = (np.concatenate(c) for c in zip(*parts))
            index = {n: c[~side] for n, c in zip(more, cols)}
            if len(index["fp"]) >= 2 - two and (not two or side.any()):
                yield from work(index, {n: c[side] for n, c in zip(more, cols)} if two else None)

        for b in batches:
            if not b.num_rows:
                continue
            p, key, i, j, side, two, *cols = map(_array, b.columns)
            change = (p[1:] != p[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), len(p)]
            for s, e in zip(starts, starts[1:]):
                name, part = (int(p[s]), int(key[s]), int(i[s]), int(j[s])), [x[s:e] for x in (side, *cols)]
                if held is not None and held[0] == name:
                    held[2].append(part)
                    continue
                if held is not None and (len(held[2]) > 1 or len(held[2][0][0]) > 1):
                    yield from gathered(group(*held))
                held = (name, bool(two[s]), [part])
        if held is not None:
            yield from gathered(group(*held))
        if waiting:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(meet, "a long, b long")


def linked_pairs(classes: DataFrame, k: int = 3, block: int = BLOCK, plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that span the same components as all links at <= k bits."""

    def spanning(index: dict, probes: dict | None) -> Iterator[pa.RecordBatch]:
        if links := forest(index["fp"], probes and probes["fp"], k):
            yield _links(*zip(*links))

    return meetings(classes.select("fp"), plan or plan_of(classes, k), block, spanning)


def left_over(labelled: DataFrame, k: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) at <= k bits between the nodes of different ``lab`` that may be alike; rows are (fp, node, lab, size, sketch)."""

    def across(index: dict, probes: dict | None) -> Iterator[pa.RecordBatch]:
        for found in every_link(index, probes or index, k, similarity):
            yield _links(*found)

    return meetings(labelled.select("fp", "node", "lab", "size", "sketch"), plan_of(labelled, k, whole=True), block, across).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, k: int = 3, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least id that links reach) of every row."""
    fps = staged(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    named = staged(components_of(classes, linked_pairs(classes, k, block)), "named")
    out = spread_join(fps, named, ["fp"], F.col("n"), fps.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def components_of(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root, component_id, …) of every class (fp, least, …) under the links: the least class and the least id that it reaches."""
    roots = staged(connected_components(links), "roots")
    least = roots.join(classes, roots.node == classes.fp).groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    linked = spread_join(roots, staged(least, "least"), ["root"], F.col("size"), roots.count()).select(F.col("node").alias("fp"), "root", "component_id")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"), *[c for c in classes.columns if c != "fp"])


def shingle_set(text: str | None, width: int) -> set[bytes]:
    w = (text or "").encode().lower().split()
    if len(w) <= width:
        return {b" ".join(w)}
    return set(map(b" ".join, zip(*[w[i:] for i in range(width)])))


SKETCH = 1024  # bits


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """(node, size, sketch) of texts: the number of different shingles, and the parities of how many fall on each bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sizes, out = [], []
            for t in b.column(1):
                held = shingle_set(t.as_py(), width)
                at = np.fromiter((xxhash.xxh64_intdigest(x) % SKETCH for x in held), np.int64, len(held))
                sizes.append(len(held))
                out.append(np.packbits(np.bincount(at, minlength=SKETCH) % 2 == 1).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["node", "size", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "node long, size long, sketch binary")


def alike(links: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts' shingle sets are at least ``similarity`` alike (Jaccard); ``texts`` has (node, text)."""
    paired = links.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set[bytes]] = {}

        def shingles(node: int, text: pa.Scalar) -> set[bytes]:
            if node not in known:
                if len(known) >= 500:
                    known.clear()
                known[node] = shingle_set(text.as_py(), width)
            return known[node]

        for b in batches:
            keep = []
            for i, j, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                s, t = shingles(i, x), shingles(j, y)
                small, large = sorted((len(s), len(t)))
                both = len(s & t) if small >= similarity * large else 0
                keep.append(both >= similarity * (len(s) + len(t) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return paired.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def near_duplicate_classes(docs: DataFrame, k: int = 11, width: int = 3, check_width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fp, root, component_id, least) of every distinct text, named ``fp`` by its 64-bit hash: texts joined by links at <= k bits whose shingle sets are at least ``similarity`` alike (Jaccard).

    The minimum spanning forests and the texts of equal fingerprint are verified first. Then every link between texts that these have not
    joined is verified, so none is lost; links inside what is joined already change nothing and are not made. ``least`` is the least id of a text.
    """
    node = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = staged(fingerprints(docs, width, id_col, text_col, node), "fingerprints")
    nodes = staged(rows.groupBy("fp", "node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    classes = staged(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "classes")
    plan = plan_of(classes, k)
    links = staged(linked_pairs(classes, k, plan=plan), "links")
    ends = links.select(F.col("a").alias("fp")).union(links.select(F.col("b").alias("fp"))).union(classes.filter("n > 1").select("fp")).distinct()
    met = staged(nodes.join(ends, "fp", "left_semi").select("fp", "node", "copies"), "met")
    wanted = met.groupBy("node").agg(F.sum("copies").alias("copies"))
    texts = spread_join(docs.select(node.alias("node"), F.col(text_col).alias("text")), wanted, ["node"], F.col("copies"), rows.count())
    texts = staged(texts.select("node", "text").dropDuplicates(["node"]), "linked-texts")
    heads = classes.select("fp", "head")
    spanning = links.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = met.join(heads, "fp").filter(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    passed = staged(alike(spanning.union(same), texts, check_width, similarity), "alike")

    roots = staged(connected_components(passed), "joined")
    labelled = met.select("fp", "node").join(roots, "node", "left").join(sketches(texts, check_width), "node").select("fp", "node", F.coalesce("root", "node").alias("lab"), "size", "sketch")
    more = left_over(staged(labelled, "labelled"), k, similarity)
    checked = staged(passed.union(alike(more, texts, check_width, similarity)), "checked")
    return components_of(nodes.groupBy(F.col("node").alias("fp")).agg(F.min("least").alias("least")), checked)


def deduplicate(docs: DataFrame, k: int = 11, width: int = 3, check_width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: the one of least id, in the input's columns.

    Where that id has several texts in the group, one of them stays; its texts in other groups are judged there.
    Rows without an id are kept; of repeated rows (same id, same text) one stays.
    """
    given, (docs, at) = docs, by_position(docs)
    id_col, text_col = at(id_col), at(text_col)
    named = near_duplicate_classes(docs, k, width, check_width, similarity, id_col, text_col)
    kept = named.filter(F.col("least") == F.col("component_id")).groupBy("component_id", "root").agg(F.min("fp").alias("__node")).select(F.col("component_id").alias(id_col), "__node")
    node = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    one = docs.withColumn("__node", node).join(kept, [id_col, "__node"], "left_semi").dropDuplicates([id_col, text_col])
    return one.select(*docs.columns).union(docs.filter(F.col(id_col).isNull())).select(*by_name(given))
