import re
import zlib

from filinglake.operators import corpus, examples
from filinglake.operators import vectors as V


def test_slugs_and_splits():
    assert examples.slugify("Café de l'Été: 2 Go!") == "cafe_de_lete_2_go"
    text = "One. Two. Three. Four. Five."
    p = examples.split_text(text, 3, "k")
    assert len(p) == 3 and " ".join(p) == text and p == examples.split_text(text, 3, "k")
    assert examples.split_text("abcdefgh", 4, "k") == ["ab", "cd", "ef", "gh"]


def test_windows_are_inside_the_text():
    text = "".join(f"Sentence {i} goes on. " for i in range(400))
    for k in range(30):
        w = examples.window(text, 500, 2000, 300, 1, k)
        assert w in text and 300 <= len(w) <= 2000 and w.endswith(".")
    assert examples.window("short", 500, 2000, 300, 1, 1) is None


class Words:
    """Words and marks by hash, so that a test needs no tokenizer file."""

    def spans(self, text):
        return [(zlib.crc32(m[0].encode()) % 50_000, *m.span()) for m in re.finditer(r"\w+|[^\w\s]", text)]

    def mark(self, text):
        return {"\t": examples.TAB, "\n": examples.NEW_LINE}[text]


def test_numbers_become_one_token():
    ids, mask, values = examples.encode_numbers("a <number>1000</number> <table><tr><td>x</td><td><number>-0.01</number></td></tr></table>", Words())
    assert ids[0] == examples.CLS and ids[-1] == examples.SEP and len(ids) == len(mask) == len(values)
    assert [v for v, m in zip(values, mask) if m] == [3.0, -2.0]
    assert ids.index(examples.TABLE_START) < ids.index(examples.TABLE_END) and ids.count(examples.TAB) == 2
    assert examples.decode_numbers(ids, mask, values, lambda i: "w").startswith("w 1000 <table> w \t 0.01")
    assert len(examples.encode_numbers("w " * 100, Words(), most=20)[0]) == 20


def test_chunk_spans_partition_the_document():
    for n in (0, 1, 15, 100, 5000):
        for cap in (None, 600):
            spans = corpus.chunk_spans(n, list(range(7, n, 37)), lambda k: 128 + k % 50, cap=cap)
            assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]][: len(spans)] and (not spans or spans[-1][1] == n)
            assert cap is None or all(b - a <= cap for a, b in spans)
    assert corpus.snap(10, [8, 12], 0) == 8 and corpus.snap(10, [8, 11], 0) == 11 and corpus.snap(10, [3], 5) == 10


def test_packing_never_exceeds_the_budget(spark):
    rows = spark.createDataFrame([(i, "g" if i % 3 else "h", (i * 37) % 90 + 1) for i in range(200)] + [(999, "g", 500)], "id int, g string, n int")
    for padded in (False, True):
        out = corpus.greedy_pack(rows, "g", "n", "id", 100, padded).toPandas()
        for _, b in out.groupby(["g", "batch"]):
            assert len(b) == 1 or (b["n"].max() * len(b) if padded else b["n"].sum()) <= 100
        assert len(out) == 201


def test_blobs(spark):
    a = spark.createDataFrame([(i, "x" * 10) for i in range(20)], "i int, t string")
    got = {r.blob: (r.n_articles, len(r.text)) for r in examples.fill_blobs(a, "i", "t", 3, 25).collect()}
    assert got == {0: (3, 34), 1: (3, 34), 2: (3, 34)}


def test_linear_models(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    y = x @ np.arange(6) + 2 + rng.normal(size=300) * 0.01
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "i int, v array<double>, y double")
    m = V.moments(df, "v")
    assert m.n == 300 and np.allclose(m.cov, np.cov(x.T)) and np.allclose(m.spectrum(), np.linalg.eigvalsh(np.cov(x.T))[::-1])
    w = V.ridge(df, "v", "y", 1e-9)
    assert np.allclose(w, [0, 1, 2, 3, 4, 5, 2], atol=0.05)
    white = np.array([r.white for r in V.whiten(df, "v").collect()])
    assert np.allclose(np.cov(white.T), np.eye(6), atol=1e-6)
    sweep = V.ridge_sweep(df, df, "v", "y", [1e-6, 1e3])
    best = min(sweep, key=lambda r: r["mse"])
    assert best["dims"] == 6 and best["r2"] > 0.999 and {r["dims"] for r in sweep} == {6, 3, 1}
    assert V.sigreg(rng.normal(size=(4000, 8))) < 1.5 < V.sigreg(np.ones((4000, 8)))
