import random

import numpy as np
import pytest

from filinglake.llm import decontam
from filinglake.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute_tiling(a, b, width):
    """Words of b that greedy string tiling marks, by trying every pair of positions."""
    ua, ub, marked = [False] * len(a), [False] * len(b), 0
    while True:
        best = None
        for x in range(len(a)):
            for y in range(len(b)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n] and not ua[x + n] and not ub[y + n]:
                    n += 1
                key = (-n, x, y)
                if n >= width and (best is None or key < best):
                    best = key
        if best is None:
            return marked
        n, x, y = -best[0], best[1], best[2]
        for k in range(n):
            ua[x + k] = ub[y + k] = True
        marked += n


@pytest.mark.parametrize("seed", range(25))
def test_tiles_match_brute_force(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(r.choice([3, 8, 40]))]
    item = [r.choice(words) for _ in range(r.randint(5, 24))]
    doc = []
    for _ in range(r.randint(1, 5)):
        k = r.randrange(len(item))
        doc += item[k : k + r.randint(2, 12)] + [r.choice(words + ["x"]) for _ in range(r.randint(0, 3))]
    got = list(decontam.Matcher([(1, " ".join(item))], 3, 1e-9).match(" ".join(doc)))
    want = brute_tiling(doc, item, 3)
    assert sum(g[2] for g in got) == want


def test_seeds_item_by_item_are_the_same(monkeypatch):
    items = [(1, ITEM), (2, ITEM), (3, "seven eight nine ten eleven other words here"), (4, "one two three four five " * 3)]
    text = (ITEM + " and ") * 40 + "one two three four five " * 7
    m = decontam.Matcher(items, 5, 0.6)
    want = sorted(m.match(text))
    monkeypatch.setattr(decontam, "MOST_SEEDS", 0)
    assert sorted(m.match(text)) == want and {w[0] for w in want} == {1, 2, 3, 4}


def test_running_hash_is_that_of_the_window():
    ids = np.random.default_rng(1).integers(0, 9, 500)
    h = decontam.rolling(ids, 5)
    seen = {}
    for i in range(496):
        assert seen.setdefault(h[i], tuple(ids[i : i + 5])) == tuple(ids[i : i + 5])
    assert len(seen) == len({tuple(ids[i : i + 5]) for i in range(496)})


ITEM = "one two three four five six. Seven eight nine ten eleven twelve"
DOCS = [
    (1, f"before {ITEM} after"),
    (2, "seven EIGHT nine, ten eleven twelve! then one two three four five six"),
    (3, "one two three four filler five six seven"),
    (4, None),
    (5, ""),
    (None, ITEM),
    (7, "word " * 40_000 + ITEM),
    (8, "tiny"),
    (9, (ITEM + " ") * 300),
    (1, f"before {ITEM} after"),
]


def test_odd_rows_and_reordered_passages(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in DOCS], "doc_id long, text string, coverage double")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "??"), (4, "tiny"), (1, ITEM)], "item_id long, text string")
    rows = decontam.contaminated(docs, items).collect()
    got = sorted({(r.doc_id if r.doc_id is not None else -1, r.item_id) for r in rows})
    assert got == [(-1, 1), (1, 1), (2, 1), (7, 1), (8, 4), (9, 1)]
    assert {r.n_tiles for r in rows if r.doc_id == 2} == {2} and {r.coverage for r in rows if r.doc_id == 2} == {1.0}
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    small = decontam.contaminated(docs, items, block_bytes=20)  # many blocks of the benchmark
    assert sorted(map(str, small.collect())) == sorted(map(str, rows))
    many = decontam.decontaminate(docs, items, block_bytes=20)
    assert many.columns == docs.columns and sorted(map(str, many.collect())) == sorted(map(str, kept.collect()))
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.decontaminate(docs, items.limit(0)).count() == len(DOCS)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = set()
    for b in items:
        w = decontam.word_list(b.text)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for d in docs:
            v = decontam.word_list(d.text)
            # brute force only where windows are shared; elsewhere nothing can be tiled
            at = [i for i in range(len(v) - 4) if tuple(v[i : i + 5]) in grams]
            if at and brute_tiling(v[max(0, at[0] - 5) : at[-1] + 10], w, 5) >= 0.6 * len(w):
                want.add((d.doc_id, b.item_id))
    got = {(r.doc_id, r.item_id) for r in Q.op4_string_tiling(spark, SF).collect()}
    assert got == want and want


def test_a_collision_takes_no_word_from_a_match():
    a, b = np.arange(20), np.arange(20)
    a[9] = 99  # every window over it is a collision in this list of seeds
    pairs = np.stack([np.arange(16), np.arange(16)], axis=1)
    assert sorted(decontam.tiles(a, b, pairs, 5)) == [(0, 0, 9), (10, 10, 10)]


def test_text_without_spaces_is_found_inside_a_run():
    item = "人工智能的发展改变了世界的面貌"
    m = decontam.Matcher([(1, item)], 5, 0.6)
    assert [x[0] for x in m.match("他们说" + item + "而且如此")] == [1]
    assert decontam.word_list("a1 漢字b_2") == ["a1", "漢", "字", "b_2"]
    assert not list(m.match("天气很好我们去公园散步吧"))
