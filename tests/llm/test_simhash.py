import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from filinglake.llm import queries as Q
from filinglake.llm import simhash
from filinglake.llm.components import connected_components


def brute_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs_of, nodes, k):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if bin(a ^ b).count("1") <= k:
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def check(rows, docs, k=3):
    fps = [(i, brute_fp(t)) for i, t in docs]
    comp = brute_components(None, sorted({f for _, f in fps}), k)
    least = {}
    for i, f in fps:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = [(i, f"{f:016x}", least.get(comp[f])) for i, f in fps]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


TEXTS = [None, "", " \t", "One", "ONE", "one two", "one two three four", "Ünï one\xa0two three", "a b c d e f g"] + ["x y z " * 50, "x y z " * 51, "x y z " * 49 + "q"]


def test_odd_texts(spark):
    docs = [(i * 3 + 1, t) for i, t in enumerate(TEXTS)] + [(1, None), (None, "one two"), (None, "only without id")]
    df = spark.createDataFrame([(i, t, "f") for i, t in docs], "doc_id long, text string, fp string")
    check(simhash.near_duplicates(df).collect(), docs)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_whole_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(Q.op6_simhash(spark, "/root/testdata/sf0.001").collect(), docs)


def cloud(seed, n, k):
    """Fingerprints with dense balls, chains and noise."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n)}
    for c in list(out)[:5]:
        for _ in range(n // 5):
            x = c
            for b in r.sample(range(64), r.randint(0, k + 3)):
                x ^= 1 << b
            out.add(x)
    x = r.getrandbits(64)
    for _ in range(40):
        for b in r.sample(range(64), k):
            x ^= 1 << b
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64).view(np.int64)


PLANS = {
    "own": None,
    "even": lambda k: [(list(range(16 * i, 16 * i + 16)), [0, 0, 0, 0][i]) for i in range(4)],
    "uneven": lambda k: [(list(range(21)), 1), (list(range(21, 42)), 0), (list(range(42, 64)), 0)],
    "wide": lambda k: [(list(range(32)), 1), (list(range(32, 64)), 1)],
    "one side": lambda k: [(list(range(0, 64, 2)), 2), (list(range(1, 64, 2)), 0)],
}


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("block", [8192, 16])
def test_no_link_is_lost(spark, plan, block):
    fps = cloud(block, 150, 3)
    classes = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps)], "fp long, least long")
    links = simhash.linked_pairs(classes, 3, block, PLANS[plan] and PLANS[plan](3)).collect()
    u = [int(x) & (2**64 - 1) for x in fps]
    assert all(0 < bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in links)
    want = brute_components(None, u, 3)
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a & (2**64 - 1))] = find(b & (2**64 - 1))
    got = {}
    for x in u:
        got.setdefault(find(x), set()).add(x)
    expected = {}
    for x, c in want.items():
        expected.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("n", [10**3, 10**6, 10**9])
@pytest.mark.parametrize("k", [0, 1, 3, 8])
def test_plans_obey_the_principle(n, k):
    plan = simhash.choose_plan(cloud(1, 200, 3), n, k)
    bits = sorted(b for g, _ in plan for b in g)
    assert len(bits) == len(set(bits))
    # an adversary must spend t + 1 flips on every group in use to miss it, and skipped groups take any number
    assert sum(t + 1 for _, t in plan) > k


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (None, 1), (7, None)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(50)] + [(2, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3)}, 4: 4, 5: 4, **{i: 100 for i in range(100, 141)}, **{i: 200 for i in range(200, 251)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_verifies_similarity(spark):
    r = random.Random(3)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(300)] for _ in range(6)]
    docs = []
    for i, w in enumerate(base):
        docs.append((i * 10 + 1, " ".join(w)))
        near = list(w)
        near[150] = "changed"
        docs += [(i * 10 + 2, " ".join(near)), (i * 10, " ".join(w).upper())]
    docs += [(1, docs[0][1]), (None, "no id"), (90, None), (91, "")]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted((x.doc_id for x in kept.collect()), key=lambda x: (x is None, x))
    assert got[:6] == [0, 10, 20, 30, 40, 50] and got[6:] == [90, None]
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_no_similar_pair_is_lost_in_a_large_group(spark):
    r = random.Random(5)
    base = [f"w{r.randint(0, 5000)}" for _ in range(300)]
    texts = []
    for _ in range(300):
        w = list(base)
        for at in r.sample(range(300), r.randint(4, 6)):
            w[at] = f"v{r.randint(0, 10**6)}"
        texts.append(" ".join(w))
    # texts of one fingerprint that are not alike
    texts += ["a b c " * 40 + "p q", "a b c " * 40 + " ".join(f"z{i}" for i in range(60))]
    fps, sets = [brute_fp(t) for t in texts], [simhash.shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 11 and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.deduplicate(df).collect()) == sorted({find(i) for i in range(len(texts))})
