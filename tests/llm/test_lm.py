import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from filinglake.llm import gru, lm
from filinglake.llm import queries as Q


def brute_base(docs):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    toks = []
    for i, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        toks.append([*re.findall("[^\x20\x09-\x0d]+", low), None])
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in docs]
    c = Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws, h in zip(toks, held)]


def check(rows, docs):
    want = sorted(zip([i if i is not None else -1 for i, _ in docs], brute_base(docs)), key=str)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)) for r in rows), key=str)
    assert len(got) == len(want)
    key = lambda x: (x[0], x[1][:4], round(x[1][4], 4))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[0] == w[0] and g[1][:4] == w[1][:4] and g[1][4] == pytest.approx(w[1][4], rel=1e-9, abs=1e-9)


def test_table_base_is_exact_and_the_model_beats_it(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = Q.op8_gru_scores(spark, sf).collect()
    check(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # held-out log-likelihood
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_rare_words_meet_their_counts(spark):
    docs = [(i, t) for i, t in enumerate(["The cat sat", "the dog SAT down", None, "", " \n", "ünï the", "word " * 5000])] + [(3, "the cat"), (3, "the cat"), (None, "the end")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    full = lm.language_model_scores(df).collect()
    check(full, docs)
    few = lm.language_model_scores(df, head=3).collect()  # nearly every word is joined
    check(few, docs)
    assert lm.language_model_scores(df.limit(0)).collect() == []
    none = df.filter("doc_id is null")  # held out: nothing to learn from
    check(lm.language_model_scores(none).collect(), [(None, "the end")])


def small(seed=0, n_out=10, hidden=5):
    p = gru.init(n_out, hidden, seed)
    return p, gru.Model(p, 0, batch=4)


def test_probabilities_sum_to_one():
    p, m = small()
    states = np.random.default_rng(0).normal(size=(3, 5)).astype(np.float32)
    total = sum(np.exp(m._output(states, np.full(3, y))) for y in range(10))
    assert np.allclose(total, 1, atol=1e-5)


def test_state_is_carried_over_windows():
    p, m = small()
    r = np.random.default_rng(1)
    ids = np.append(r.integers(1, 10, 3 * gru.WINDOW + 5), 0).astype(np.int32)
    got = m.score(ids, np.array([len(ids)]))
    h = np.zeros((1, 5), np.float32)
    want = []
    for y in ids:
        want.append(m._output(h, np.array([y]))[0])
        h = m._step(h, p["x"][np.array([y])], np.array([False]))
    assert np.allclose(got, want, atol=1e-4)


def test_documents_do_not_touch_each_other():
    p, m = small()
    r = np.random.default_rng(2)
    docs = [np.append(r.integers(1, 10, n), 0).astype(np.int32) for n in (0, 3, 200, 70, 1, 64, 31, 32)]
    alone = np.concatenate([m.score(d, np.array([len(d)])) for d in docs])
    together = m.score(np.concatenate(docs), np.cumsum([len(d) for d in docs]))
    assert np.allclose(alone, together, atol=1e-4)


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(gru, "WINDOW", 8)
    p, m = small(3, 7, 4)
    ids = np.array([1, 2, 5, 3, 6, 2, 4, 0], np.int32)
    model = gru.Model({k: v.copy() for k, v in p.items()}, 0, 4)
    memory = {k: np.zeros_like(v) for k, v in p.items()}
    before = {k: v.copy() for k, v in model.p.items()}
    model.train(ids, np.array([8]), memory, rate=0.0)
    for name in ("x", "u", "c", "o"):
        # memory holds squared gradients after one window
        for at in list(np.ndindex(before[name].shape))[:: max(1, before[name].size // 12)]:
            q = {k: v.copy() for k, v in before.items()}
            loss = []
            for e in (1e-2, -1e-2):
                q[name][at] = before[name][at] + e
                loss.append(-gru.Model(q, 0, 4).score(ids, np.array([8])).sum())
            slope = (loss[0] - loss[1]) / 2e-2
            assert math.sqrt(memory[name][at]) == pytest.approx(abs(slope), rel=0.03, abs=3e-3), (name, at)


def test_training_learns_a_pattern():
    p = gru.init(12, 16)
    m = gru.Model(p, 0, 8)
    ids = np.array(([1, 2, 3, 4, 5, 6, 7, 8] * 6 + [0]) * 200, np.int32)
    ends = np.arange(1, 201) * 49
    before = m.score(ids[:49], ends[:1]).mean()
    memory = gru.memory_of(p)
    for _ in range(4):
        m.train(ids, ends, memory, 0.1)
    assert m.score(ids[:49], ends[:1]).mean() > before / 4


def test_every_short_document_trains(spark):
    df = spark.createDataFrame([(i, f"a{i} b c d e") for i in range(1, 6)], "doc_id long, text string")
    words = lm.collect_words(lm.word_counts(df))
    untrained = gru.init(len(words.place), lm.HIDDEN)
    gru.warm(untrained, words.output_counts)
    encoded = lm.encode(df, words)
    for i in range(1, 6):
        assert not np.array_equal(gru.flat(lm.train(encoded.filter(f"doc_id = {i}"), words)), gru.flat(untrained))


def test_every_token_trains_once_with_its_state(spark, monkeypatch):
    """Groups hold whole documents; the calls of all rounds together hold each document once."""
    df = spark.createDataFrame([(i, f"w{i} " * (i % 40)) for i in range(1, 200)], "doc_id long, text string").coalesce(1)
    words = lm.collect_words(lm.word_counts(df))
    encoded = lm.encode(df, words)
    seen = []
    monkeypatch.setattr(gru.Model, "train", lambda self, ids, ends, memory, rate: seen.append((ids, ends)) or len(ids))
    # the training function of a task, run here
    monkeypatch.setattr(type(encoded), "mapInArrow", lambda self, f, schema: spark.createDataFrame([tuple(c.as_py() for c in row) for b in f(iter(self.toArrow().to_batches())) for row in zip(*b.columns)], schema), raising=False)
    lm.train(encoded.select("doc_id", "ids"), words, group_tokens=500)
    got = Counter(x.tobytes() for ids, ends in seen for x in np.split(ids.astype("<u2"), ends[:-1]))
    assert got == Counter(r.ids for r in encoded.collect())


def test_scores_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [{r.doc_id: r.score for r in lm.language_model_scores(docs.repartition(n), group_tokens=20_000).collect()} for n in (1, 4, 16)]
    assert len(got[0]) == docs.count()
    for other in got[1:]:
        assert other.keys() == got[0].keys()
        assert all(other[i] == pytest.approx(got[0][i], rel=2e-5) for i in other)


def scalar_scores(ids, p, end):
    """Natural log probability of each token by loops over numbers: gates, candidate, class, and word inside it."""
    k, size = p["u"].shape[0], p["o"].shape[2]
    h, out = [0.0] * k, []
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b))
    log_softmax = lambda z, at: z[at] - math.log(sum(math.exp(v) for v in z))
    for y in ids:
        m = [*h, 1.0]
        c = y // size
        out.append(log_softmax([dot(m, p["c"][:, j]) for j in range(p["c"].shape[1])], c) + log_softmax([dot(m, p["o"][c][:, j]) for j in range(size)], y - c * size))
        a = [dot(h, p["u"][:, j]) for j in range(3 * k)]
        x = p["x"][y]
        s = lambda v: 1 / (1 + math.exp(-v))
        r, z = [s(a[j] + x[j]) for j in range(k)], [s(a[k + j] + x[k + j]) for j in range(k)]
        n = [math.tanh(r[j] * a[2 * k + j] + x[2 * k + j]) for j in range(k)]
        h = [0.0] * k if y == end else [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(k)]
    return out


def test_scores_by_loops_over_numbers(spark):
    """Ten documents of the table under the trained network, words outside it by their share of their bucket."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counts = lm.staged(lm.word_counts(docs.filter(~lm.held_out(docs.doc_id))), "counts")
    words = lm.collect_words(counts)
    encoded = lm.encode(docs, words)
    params = lm.train(encoded.filter(~lm.held_out(encoded.doc_id)), words, group_tokens=20_000)
    got = {r.doc_id: r.score for r in lm.score(encoded, words, params, counts).collect()}
    c = {bytes(r.word): r.n for r in counts.collect()}
    net, buckets = words.output_of(), words.bucket_outputs()
    inside = {}
    for w, n in c.items():
        if w not in net and w != lm.END:
            inside.setdefault(lm.bucket(w), []).append(n)
    short = sorted((len(r.text or ""), r.doc_id, r.text or "") for r in docs.collect())[5:15]
    for _, i, text in short:
        ws = lm.tokens(text)
        ids = [net.get(w, int(buckets[lm.bucket(w)])) for w in ws] + [words.end]
        share = sum(math.log((c.get(w, 0) + 0.1) / (sum(held := inside.get(lm.bucket(w), [])) + 0.1 * (len(held) + 1))) for w in ws if w not in net)
        assert got[i] == pytest.approx((sum(scalar_scores(ids, params, words.end)) + share) / math.log(10), rel=1e-4), i


def test_the_network_grows_with_the_corpus():
    assert [lm.net_words(n) for n in (0, 1 << 27, 1 << 29, 1 << 31)] == [1500, 1500, 3000, 6000] and lm.net_words(1 << 60) == lm.MOST_WORDS
    assert [lm.hidden_units(n) for n in (0, 1 << 27, 1 << 31)] == [24, 24, 48] and lm.hidden_units(1 << 60) == lm.MOST_HIDDEN
    assert [lm.training_rounds(n) for n in (1, 2, 8, 27, 1000, 10**6)] == [1, 2, 3, 4, 11, 101]


def test_many_rounds_read_their_own_groups(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = lm.collect_words(lm.staged(lm.word_counts(docs), "counts"))
    encoded = lm.encode(docs, words)
    few = lm.train(encoded, words, rounds=5, group_tokens=5_000)
    monkeypatch.setattr(lm, "MANY_ROUNDS", 1)
    many = lm.train(encoded, words, rounds=5, group_tokens=5_000)
    assert all(np.allclose(few[k], many[k], atol=1e-5) for k in few)


def test_words_are_looked_up_once_a_worker(spark):
    """A task's own copy of the words' table would be made anew by every task."""
    df = spark.range(1, 200, 1, 16).selectExpr("id AS doc_id", "concat('w', id, ' b c') AS text")
    words = lm.collect_words(lm.word_counts(df))

    def tables():
        def look(batches):
            import pyarrow as pa

            from filinglake.llm import lm as here

            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(here._LOOKUPS)])], ["n"])

        return sum(r.n for r in spark.range(0, 64, 1, 64).mapInArrow(look, "n long").collect())

    encoded = lm.encode(df, words)
    assert tables() > 0
    params = lm.train(encoded, words)
    held = tables()
    for _ in range(5):  # each worker comes to score
        lm.score(encoded.repartition(64), words, params, lm.word_counts(df)).collect()
        held = min(held, tables())
    assert held == 0


def test_scoring_streams_end_together(spark, monkeypatch):
    """Long documents among short ones do not lie behind one another in one stream."""
    sizes = [2000 if i % 100 in (98, 99) else 20 for i in range(2000)]
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string").coalesce(1)
    words = lm.collect_words(counts := lm.word_counts(df))
    encoded = lm.encode(df, words).orderBy("doc_id").coalesce(1)
    p = gru.init(len(words.place), 4)
    steps, found = [], []
    step = gru.Model._step
    monkeypatch.setattr(gru.Model, "_step", lambda self, h, *a: steps.append(len(h)) or step(self, h, *a))
    monkeypatch.setattr(type(encoded), "mapInArrow", lambda self, f, schema: spark.createDataFrame([found.append(row) or row for b in f(iter(self.toArrow().combine_chunks().to_batches())) for row in zip(*(c.to_pylist() for c in b.columns))], schema), raising=False)
    lm.score(encoded, words, p, counts)
    assert len(steps) <= 2001 + gru.WINDOW  # the longest document
    by_id = {row[1]: row[-1] for row in found}
    model = gru.Model(p, words.end)
    for i in (0, 1, 98, 1999):
        ids = np.array([words.output_of()[b"w"]] * sizes[i] + [words.end], np.int32)
        assert by_id[i] == pytest.approx(float(model.score(ids, np.array([len(ids)])).astype(float).sum()), rel=1e-4)


def plain_window(ids, p, end):
    """Loss gradients of one document by loops over steps, in double precision."""
    q = {k: v.astype(float) for k, v in p.items()}
    k, size = q["u"].shape[0], q["o"].shape[2]
    grad = {n: np.zeros_like(v) for n, v in q.items()}
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    h, kept = np.zeros(k), []
    for y in ids:
        a, x = h @ q["u"], q["x"][y]
        r, z = 1 / (1 + np.exp(-a[:k] - x[:k])), 1 / (1 + np.exp(-a[k : 2 * k] - x[k : 2 * k]))
        n = np.tanh(r * a[2 * k :] + x[2 * k :])
        kept.append((y, h, r, z, a[2 * k :], n))
        h = (1 - z) * n + z * h if y != end else np.zeros(k)
    dh = np.zeros(k)
    for y, h, r, z, b, n in reversed(kept):
        if y == end:
            dh = np.zeros(k)
        dn = dh * (1 - z) * (1 - n * n)
        dz, dr = dh * (h - n) * z * (1 - z), dn * b * r * (1 - r)
        da = np.concatenate([dr, dz, dn * r])
        grad["x"][y] += np.concatenate([dr, dz, dn])
        grad["u"] += np.outer(h, da)
        m, c = np.append(h, 1), y // size
        e, f = soft(m @ q["c"]), soft(m @ q["o"][c])
        e[c] -= 1
        f[y - c * size] -= 1
        grad["c"] += np.outer(m, e)
        grad["o"][c] += np.outer(m, f)
        dh = dh * z + q["u"] @ da + (q["c"] @ e + q["o"][c] @ f)[:-1]
    return grad


@pytest.mark.parametrize("hidden", [5, 6])
def test_gradients_of_several_streams_are_those_of_plain_loops(monkeypatch, hidden):
    """One window of three streams of documents; a stream that has ended adds nothing."""
    p = gru.init(30, hidden, 5)
    r = np.random.default_rng(4)
    docs = [np.append(r.integers(1, 30, n), 0).astype(np.int32) for n in (31, 0, 4, 20, 12, 2, 17)]
    ends = np.cumsum([len(d) for d in docs])
    runs = np.array([0, *ends[[1, 4, 6]]])
    monkeypatch.setattr(gru, "WINDOW", 64)
    monkeypatch.setattr(gru, "streams", lambda ends, most: (runs[[1, 0, 2]], runs[[2, 1, 3]]))
    memory = {k: np.zeros_like(v) for k, v in p.items()}
    gru.Model({k: v.copy() for k, v in p.items()}, 0, 3).train(np.concatenate(docs), ends, memory, rate=0.0)
    want = [plain_window(d, p, 0) for d in docs]
    for name in p:
        assert np.allclose(np.sqrt(memory[name]), np.abs(sum(g[name] for g in want)) / 3, atol=2e-5, rtol=2e-4), name
