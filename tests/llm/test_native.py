import collections
import math
import random
import re
import zlib

import pytest

from filinglake.llm import mixing, quality, sharding
from filinglake.llm import queries as Q
from tests.compare import differences

SF = "/root/testdata/sf0.001"
rng = random.Random(5)
VOCAB = ["the", "of", "and", "cat", "dog's", "naïve", "x*y", "😀", "THE", "|", "&&"]
PHRASE = "one two three four five six seven eight nine ten"
TEXTS = [
    None,
    "",
    "   \n\t ",
    "short text",
    PHRASE,
    f"{PHRASE} {PHRASE}",
    f"{PHRASE} and {PHRASE} {PHRASE}",
    "a " * 500,
    "line one\nline two\nline one\n\n\nline one\r\n line one",
    "sep\x0bvt\x0cff\xa0nbsp em sep\x1cfs " * 5,
    "\n".join([PHRASE] * 40),
    "THIS IS ALL IN CAPITALS " * 4 + " ".join(f"W{i}X" for i in range(30)),
    " ".join(f"w{i}" for i in range(20_000)) + f" {PHRASE} x {PHRASE}",
    "ab cd " * 30_000,
] + [" ".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 120))) for _ in range(40)]


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    inside = set()
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                inside.update(range(i, i + 8))
    lines = [s for s in t.split("\n") if re.search("[^\x20\x09-\x0d]", s)]
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed


def test_quality_figures_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id int, text string, N_WORDS int")
    rows = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, t and t[:60])
        assert not (r.base_failed and r.kept)
    assert rows[12].kept and not rows[11].kept


def test_cascade_keeps_what_no_rule_rejects(spark):
    docs = spark.createDataFrame([(i % 50, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    kept = sorted(r.doc_id for r in quality.cascade(docs).collect())
    want = sorted(r.doc_id for r in quality.quality_report(docs).filter("kept").collect())
    assert kept == want and kept
    assert quality.cascade(docs.limit(0)).columns == docs.columns
    assert quality.cascade(docs.limit(0)).count() == 0
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_rules_run_by_rejections_per_second():
    r = [quality.Rule(n, None) for n in "abc"]
    m = [{"rule": r[0], "seconds": 1.0, "rate": 0.1}, {"rule": r[1], "seconds": 10.0, "rate": 0.5}, {"rule": r[2], "seconds": 0.1, "rate": 0.0}]
    assert [x.name for x in quality.ordered(m)] == ["a", "b", "c"]


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    from pyspark.sql import functions as F

    pts = spark.range(1 << (n * bits)).select(*[((F.col("id") / (1 << (bits * k))).cast("int") % (1 << bits)).alias(f"d{k}") for k in range(n)])
    rows = pts.withColumn("h", sharding.hilbert_index([F.col(f"d{k}") for k in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (n * bits)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[k] - b[k]) for k in range(n)) == 1


def check_shards(rows, n):
    count = collections.Counter(r.shard for r in rows)
    full = [count.get(s, 0) for s in range(n)]
    assert max(full) - min(full) <= 1 and set(count) <= set(range(n))
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))


def test_shards_of_a_table(spark):
    rows = Q.op7_hilbert_shards(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == set(docs)
    check_shards(rows, 24)
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    by_order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert all(a.hilbert <= b.hilbert for a, b in zip(by_order, by_order[1:]))
    # runs are compact: a shard meets fewer languages than the table has
    langs = collections.defaultdict(set)
    for r in rows:
        langs[r.shard].add(docs[r.doc_id].lang)
    assert sum(map(len, langs.values())) / 24 < len({d.lang for d in docs.values()}) * 0.7, langs


def test_shards_of_odd_rows(spark):
    odd = [(None, None, None, None, None, 1), (1, "a", "en", "s", 1, 2), (1, "a", "en", "s", 1, 2), (2, "", "de", None, 0, 3)] + [(i, "hot", "en", "s", 3, 0) for i in range(100, 400)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, shard int")
    rows = sharding.hilbert_shards(docs, 7, group_rows=16).collect()
    assert len(rows) == len(odd)
    check_shards(rows, 7)
    assert sharding.hilbert_shards(docs.limit(0), 7).count() == 0
    few = sharding.hilbert_shards(docs.filter("doc_id = 2"), 7).collect()
    assert [(r.shard, r.slot, r["size"]) for r in few] == [(0, 0, 8)]


def test_written_shards_prune_on_every_dimension(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.hilbert_shards(docs, 5).cache()
    total = out.agg(F.sum("size")).first()[0]
    sharding.write_shards(out, str(tmp_path / "s"), file_bytes=total // 40)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count()
    files = back.groupBy(F.input_file_name()).agg(F.sum("size").alias("b"), *[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "n_chars") for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    assert len(files) > 30 and max(r.b for r in files) < total / 8
    rows = [tuple(r) for r in docs.select("lang", "source", "n_chars").collect()]
    for k, c in enumerate(("lang", "source", "n_chars")):
        read = [sum(r[f"lo_{c}"] <= row[k] <= r[f"hi_{c}"] for r in files) for row in rows[::10]]
        assert sum(read) / len(read) < 0.75 * len(files), c  # a look-up of one value skips a quarter of the files or more


def quantile_edges(values, bits):
    """Edges by sorting all values: a value is an edge if a quantile falls on it and it is not the last."""
    v = sorted(x for x in values if x is not None)
    n, out = len(v), set()
    for q in range(1, 1 << bits):
        out.add(v[-(-q * n // (1 << bits)) - 1])
    return sorted(out)


def test_cells_of_a_table_recomputed(spark):
    """Bins from sorted values, curve index by the curve's own table, order and cuts from one sort."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    following, digit, side = sharding.curve_table(3)
    dims = [[getattr(d, c) for d in docs.values()] for c in ("lang", "source", "n_chars")]
    edges = [quantile_edges(v, 4) for v in dims]
    edges = [[e for e in es if e != max(v)] if isinstance(es[0], str) else es for es, v in zip(edges, dims)]

    def index(d):
        bins = []
        for c, es in zip(("lang", "source", "n_chars"), edges):
            bins.append(int(sum(e < getattr(d, c) for e in es) * 15 / len(es)) if es else 0)
        s = h = 0
        for level in (3, 2, 1, 0):
            at = s * side + sum((b >> level & 1) << k for k, b in enumerate(bins))
            s, h = following[at], h * side + digit[at]
        return h

    rows = Q.op7_hilbert_shards(spark, SF).collect()
    assert {r.doc_id: r.hilbert for r in rows} == {i: index(d) for i, d in docs.items()}
    n = len(rows)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.shard for r in order] == [k * 24 // n for k in range(n)]


def test_names_with_a_common_prefix_part_the_shards(spark):
    rows = [(i, "t", "en", f"https://common-crawl-archive/{i % 8}", 5) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = sharding.hilbert_shards(docs, 8).collect()
    met = collections.defaultdict(set)
    for r in out:
        met[r.shard].add(r.source)
    assert max(map(len, met.values())) <= 2
    assert sharding.string_edges(docs, "source", 8) == [f"https://common-crawl-archive/{k}" for k in range(7)]


def poisson_inverse(u, mean):
    k, p = 0, math.exp(-mean)
    c = p
    while c < u:
        k += 1
        p *= mean / k
        c += p
    return k


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_its_sql(spark, name):
    assert differences(Q.QUERIES[name](spark, SF), Q.ORACLES[name], SF) == ""


def test_mixing_counts_and_weights(spark):
    import hashlib

    rows = [(i, "t", "hot" if i % 3 else ("cold" if i % 2 else None), i) for i in range(3000)] + [(7, "t", "hot", 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    out = mixing.poisson_mix(docs, {"cold": 3.0, "unseen": 2.0}, target_rows=6000).collect()
    n = collections.Counter(r[2] for r in rows)
    share = {"hot": 1 / 5, "cold": 3 / 5, None: 1 / 5}
    made = collections.Counter((r.doc_id, r.source) for r in out)
    held = collections.Counter((r[0], r[2]) for r in rows)
    for (i, s), k in held.items():
        u = (int(hashlib.md5(f"42:{i}:0".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        assert made[(i, s)] == k * poisson_inverse(u, share[s] * 6000 / n[s])
    total = collections.Counter(r.source for r in out)
    for s, x in share.items():
        assert abs(total[s] - 6000 * x) < 5 * math.sqrt(6000 * x)
    assert {r.copy for r in out if (r.doc_id, r.source) == (7, "hot")} == set(range(made[(7, "hot")] // 3))


def test_rows_without_an_id_go_by_their_text(spark):
    rows = [(None, f"text {i}", "a" if i % 3 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.poisson_mix(docs, {"a": 3.0, "b": 1.0}).collect()
    n = collections.Counter(r.source for r in out)
    assert abs(n["a"] - 2250) < 5 * math.sqrt(2250) and abs(n["b"] - 750) < 5 * math.sqrt(750)
    assert len({r.shuffle_key for r in out}) == len(out)  # and no key is shared
    named = docs.withColumnRenamed("source", "copy").withColumn("rate", docs.doc_id)
    bare = mixing.poisson_mix(named, source_col="copy", figures=False)
    assert bare.columns == named.columns and {r.copy for r in bare.collect()} == {"a", "b"}


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(None, None, None, "c"), (1, "a", "s", "c"), (1, "a", "s", "c")], "doc_id long, text string, source string, RATE string")
    out = mixing.poisson_mix(docs, {"s": 0.0}, target_rows=3000).collect()
    assert {r.source for r in out} == {None} and 2700 < len(out) < 3300  # a mean of 3000 is drawn in steps
    assert mixing.poisson_mix(docs.limit(0)).collect() == []
