"""The pipeline against a plain version with dictionaries and loops."""

import collections
import hashlib
import itertools
import re

import corpus_pipeline
from filinglake.llm import decontam, simhash
from filinglake.llm.queries import MIX_WEIGHTS
from tests.llm.test_decontam import brute_tiling
from tests.llm.test_native import brute, poisson_inverse

SF = "/root/testdata/sf0.001"


def passes_quality(t):
    n_words, chars, symbols, dup, _, failed = brute(t)
    lines = [s for s in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", s)]
    lettered = [w for w in re.findall("[^\x20\x09-\x0d]+", t or "") if w.lower() != w.upper()]
    capitals = sum(w == w.upper() and len(w) > 1 for w in lettered)
    return not (failed or symbols * 10 > n_words or dup * 2 > len(lines) or capitals * 2 > len(lettered) or (n_words and not 2 * n_words <= chars <= 15 * n_words))


def deduplicated(rows):
    """Components of all pairs of different texts at 11 bits or fewer and a Jaccard similarity of 0.8 or more."""
    least = {}
    for r in rows:
        t = r.text or ""
        least[t] = min(r.doc_id, least.get(t, r.doc_id))
    texts = list(least)
    fps = [simhash.fingerprint(t, 3) for t in texts]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= 11 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, t in enumerate(texts):
        groups[find(k)].append(least[t])
    kept = {min(g) for g in groups.values()}
    return [r for r in rows if r.doc_id in kept]


def test_near_duplicates_of_a_table_by_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(r.doc_id for r in deduplicated(docs.collect()))
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == want and len(got) < docs.count()


def test_ids_with_two_texts_are_judged_by_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (" ".join(f"{p}{k}" for k in range(60)) for p in ("left", "right"))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (0, b + " more", "en", "s", 1), (3, a, "en", "s", 1), (3, a, "en", "s", 1)]
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), SF).collect())
    assert got == [(0, b + " more"), (1, a)]


def test_a_dense_group_is_joined_without_its_pairs(spark):
    """Copies of one text with many edits: alike to it or not, close in bits; every link between different groups is found."""
    import random

    r = random.Random(4)
    base = [f"w{r.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in r.sample(range(150), r.randint(1, 12)):
            w[k] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    want = sorted(x.doc_id for x in deduplicated(df.collect()))
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == want and 1 < len(want) < 160


def test_sketches_never_part_what_is_alike(spark):
    import random

    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.choice((30, 300, 3000)))) for _ in range(12)]
    rows = {x.node: x for x in simhash.sketches(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5).collect()}
    for i, j in itertools.combinations(range(12), 2):
        s, t = (simhash.shingle_set(texts[k], 5) for k in (i, j))
        a, b = (int.from_bytes(rows[k].sketch, "big") for k in (i, j))
        assert (a ^ b).bit_count() <= len(s ^ t) and rows[i]["size"] == len(s)


def test_stages_match_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [decontam.word_list(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = docs.collect()
    rows = [r for r in rows if passes_quality(r.text)]
    rows = deduplicated(rows)

    def leaks(t):
        w = decontam.word_list(t)
        for item in items:
            grams = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
            at = [i for i in range(len(w) - 4) if tuple(w[i : i + 5]) in grams]
            if at and brute_tiling(w[max(0, at[0] - 5) : at[-1] + 10], item, 5) >= 0.6 * len(item):
                return True
        return False

    rows = [r for r in rows if not leaks(r.text)]
    n = collections.Counter(r.source for r in rows)
    weight = {s: MIX_WEIGHTS.get(s, 1.0) for s in n}
    want = collections.Counter()
    for r in rows:
        u = (int(hashlib.md5(f"42:{r.doc_id}:0".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        k = poisson_inverse(u, len(rows) * weight[r.source] / sum(weight.values()) / n[r.source])
        if k:
            want[r.doc_id] += k
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.collect()
    assert collections.Counter(r.doc_id for r in got) == want
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes[s] for s in range(24)) - min(sizes[s] for s in range(24)) <= 1
    text = {r.doc_id: r.text for r in rows}
    assert all(r.text == text[r.doc_id] for r in got)


def test_stages_take_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)] + [(2, "the same words again and again in this long enough text of more than twenty words for every rule to pass it all right", "en", None, 9)] * 2, docs.schema)
    for start in (docs.limit(0), odd):
        d = start
        for name, f in corpus_pipeline.STAGES:
            d = f(spark, d, SF)
            assert d.columns[: len(docs.columns)] == docs.columns, name
        assert {r.doc_id for r in d.collect()} <= {2}


def test_near_copies_go_and_clean_documents_stay(spark):
    import random

    r = random.Random(11)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "te") for b in ("n", "r", "st", "la", "mo", "vi")]
    base = [[r.choice(words) + r.choice(words) for _ in range(400)] for _ in range(20)]
    rows = []
    for i, w in enumerate(base):
        rows.append((i, " ".join(w), "en", "s", 1))
        near = list(w)
        for k in r.sample(range(400), 4):
            near[k] = "other"
        rows.append((100 + i, " ".join(near), "en", "s", 1))
    kept = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), SF).collect())
    assert kept[:20] == list(range(20)) and len(kept) <= 22
