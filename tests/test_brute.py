"""Whole-table results of queries without SQL, recomputed in plain Python."""

import math
import re
import zlib

import numpy as np
import pytest

from filinglake.operators import dom
from filinglake.plans import catalogue
from filinglake.session import table

SF = "/root/testdata/sf0.001"
Q = catalogue.QUERIES


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = sorted(table(spark, SF, "embeddings").collect(), key=lambda r: r.vec_id)
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), np.array([r.label for r in rows], float)


def crc_draw(low, high, *key):
    return low + zlib.crc32(":".join(map(str, key)).encode()) % (high - low + 1)


@pytest.mark.parametrize("name,high,per_chunk,cap,least", [("chunk_spans", 1024, False, None, 3), ("chunk_spans_capped", 4096, True, 8190, 1)])
def test_chunks_of_every_document(spark, texts, name, high, per_chunk, cap, least):
    want = set()
    for i, t in texts.items():
        ends = sorted({len("\n".join(t.split("\n")[: k + 1]).split()) for k in range(t.count("\n") + 1)} - {0})
        n, at, out = len(t.split()), 0, []
        while at < n:
            goal = at + crc_draw(128, high, 0, i, len(out) if per_chunk else 0)
            if goal >= n:
                end = n
            else:
                before = [e for e in ends if at < e < goal]
                behind = [e for e in ends if e >= goal]
                end = goal
                if before and behind:
                    end = before[-1] if goal - before[-1] <= behind[0] - goal else behind[0]
                elif before or behind:
                    end = before[-1] if before else behind[0]
                end = max(at + 1, end)
            end = min(end, at + cap) if cap else end
            if n - end < 16 and (not cap or n - at <= cap):
                end = n
            out.append((i, len(out), at, end))
            at = end
        want |= set(out) if len(out) >= least else set()
    assert {(r.doc_id, r.chunk_idx, r.doc_start, r.doc_end) for r in Q[name](spark, SF).collect()} == want and want


def test_blobs_of_the_corpus(spark, texts):
    used, got, at = [0] * 5, [[] for _ in range(5)], 0
    for i, t in sorted(texts.items()):
        k = next((k % 5 for k in range(at, at + 5) if used[k % 5] < 20_000), None)
        if k is None:
            break
        used[k] += len(t.encode())
        got[k].append(t)
        at = k + 1
    want = {(k, len("\n\n".join(g).encode()), len(g)) for k, g in enumerate(got) if g}
    assert {(r.blob, r.n_bytes, r.n_articles) for r in Q["blob_fill"](spark, SF).collect()} == want


def test_density_baseline(spark, texts):
    for r in Q["density_baseline"](spark, SF).collect():
        cut = [t.encode()[: r.n] for t in texts.values() if len(t.encode()) >= r.n]
        ratios = [len(zlib.compress(c, 6)) / r.n for c in cut]
        assert r.n_texts == len(cut) and r.ratio == pytest.approx(sum(ratios) / len(ratios))


def test_windows_of_tokens(spark, texts):
    rows = Q["random_token_windows"](spark, SF).collect()
    long = [i for i, t in texts.items() if len(re.split(r"\s+", t)) >= 64]
    assert len(rows) == min(100, len(long)) and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert r.window.split(" ") == re.split(r"\s+", texts[r.doc_id])[r.start - 1 : r.start + 63]


def test_examples_and_their_lengths(spark, texts):
    rows = Q["text_examples"](spark, SF).collect()
    want = 0
    for t in texts.values():
        want += 3 * (len(t) > 1000)
    assert 0 < len(rows) <= want
    for r in rows:
        assert r.text in texts[r.id] and 500 <= len(r.text) <= 4000 and 2 <= len(r.sub_texts) <= 4 and all(s == s.strip() and s in r.text for s in r.sub_texts)
    lengths = {(r.id, r.draw): r.lengths for r in Q["regrouped_lengths"](spark, SF).collect()}
    assert lengths == {(r.id, r.draw): ",".join(str(len(s)) for s in r.sub_texts) for r in rows}


def test_spectrum_and_whitening(spark, vectors):
    _, x, _ = vectors
    s = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = sorted(Q["pca_spectrum"](spark, SF).collect(), key=lambda r: r.k)
    assert np.allclose([r.eigenvalue for r in got], s) and np.allclose([r.cumulative for r in got], s.cumsum() / s.sum())
    p = s[s > 0] / s.sum()
    assert got[0].entropy_dim == pytest.approx(math.exp(-(p * np.log(p)).sum()))
    need = {r.share: r.components for r in Q["components_needed"](spark, SF).collect()}
    assert need == {t: int(np.argmax(s.cumsum() / s.sum() >= t)) + 1 for t in (0.5, 0.9, 0.95, 0.99)}
    w, v = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-5))) @ v.T
    white = sorted(Q["zca"](spark, SF).collect(), key=lambda r: r.vec_id)
    assert np.allclose([r.white for r in white], want, atol=1e-6)


def test_ridge_by_the_normal_equations(spark, vectors):
    ids, x, y = vectors
    one = np.hstack([x, np.ones((len(x), 1))])
    a, b = one[ids % 5 != 0], y[ids % 5 != 0]
    solved = np.linalg.lstsq(np.vstack([a, np.eye(a.shape[1])[:-1]]), np.concatenate([b, np.zeros(a.shape[1] - 1)]), rcond=None)[0]
    all_in = np.linalg.solve(a.T @ a + np.eye(a.shape[1]), a.T @ b)
    got = {r.vec_id: r.predicted for r in Q["ridge"](spark, SF).collect()}
    preds = [dict(zip(ids[ids % 5 == 0].tolist(), (one[ids % 5 == 0] @ w).tolist())) for w in (solved, all_in)]
    assert any(all(abs(got[i] - p[i]) < 1e-4 for i in p) and got.keys() == p.keys() for p in preds)
    sweep = Q["ridge_pca_sweep"](spark, SF).collect()
    assert {r.alpha for r in sweep} == {0.0, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0} and all(math.isfinite(r.mse) for r in sweep)
    big = {r.alpha: r.mse for r in sweep if r.dims == x.shape[1]}
    t = one[ids % 5 == 0]
    plain = np.linalg.lstsq(a, b, rcond=None)[0]
    assert big[0.0] == pytest.approx(np.mean((t @ plain - y[ids % 5 == 0]) ** 2), rel=0.05)
    mae = next(r.mae for r in sweep if r.dims == x.shape[1] and r.alpha == 0.0)
    assert mae == pytest.approx(np.mean(np.abs(t @ plain - y[ids % 5 == 0])), rel=0.05)


def test_tags_keep_all_but_numbers(spark, texts):
    lead = "In 2017, 1,234.50 of (532) | 12 | **5.8 %** and 98765; "
    for kind in ("all", "ocr", "filing"):
        for r in Q[f"tag_numbers_{kind}"](spark, SF).collect():
            raw = lead + texts[r.doc_id]
            assert r.n_tags == r.text.count("<number>") == r.text.count("</number>") > 0
            digits = lambda s: re.sub(r"[^a-zA-Z]", "", s)
            assert digits(r.text.replace("<number>", "").replace("</number>", "")) == digits(raw)
            values = {float(v) for v in re.findall(r"<number>([^<]*)</number>", r.text)}
            assert {1234.5, 98765.0} <= values and (2017.0 in values) == (kind == "all") and (-532.0 in values) == (kind == "filing")


def test_tables_of_orders(spark):
    orders = {r.o_orderkey: r for r in table(spark, SF, "orders").collect()}
    cells = {}
    for r in Q["table_grid"](spark, SF).collect():
        cells.setdefault(r.o_orderkey, {})[(r.row, r.col)] = r.content
    for k, o in orders.items():
        c = cells[k]
        assert c[(0, 0)] == "Total" and c[(0, 2)] == "$" and c[(1, 0)] == str(k) and c[(1, 1)] == f"$ ({o.o_custkey}" and c[(2, 1)] == repr(o.o_totalprice)
    for r in Q["table_repair"](spark, SF).collect():
        assert str(r.o_orderkey) in r.html and r.html.count("<table") == 1


def test_page_figures_by_patterns(spark):
    pages = {r.page_id: r.html or "" for r in table(spark, SF, "pages").collect()}
    md = {r.page_id: r.markdown for r in Q["html_markdown"](spark, SF).collect()}
    clean = {r.page_id: r.html for r in Q["sanitize_html"](spark, SF).collect()}
    plain = {r.page_id: r.text for r in Q["filing_text"](spark, SF).collect()}
    for r in Q["dom_stats"](spark, SF).collect():
        h = pages[r.page_id]
        opened = re.findall(r"<([a-z][a-z0-9]*)\b", re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", h))
        assert r.document_byte_size == len(h.encode()) and r.total_link_count == opened.count("a") and r.image_count == opened.count("img") and r.heading_count == sum(bool(re.fullmatch("h[1-6]", t)) for t in opened)
        assert r.list_element_count == sum(t in ("ul", "ol", "li") for t in opened)
        for s in (clean[r.page_id], plain[r.page_id], md[r.page_id]):
            assert "<script" not in s and "<style" not in s
        content = dom.parse(h).content()
        assert all(w in content for w in re.findall(r"\w{5,}", plain[r.page_id]))


def test_numbers_of_tokenised_documents(spark, texts):
    for r in Q["tokenised_numbers"](spark, SF).collect():
        assert r.n_numbers == 2 + len(re.findall(r"(?s)<number>.*?</number>", texts[r.id] or ""))


def test_random_pairs_are_those_of_the_hash(spark, vectors):
    ids, x, _ = vectors
    r = Q["cosine_random_pairs"](spark, SF).first()
    share = 1 - 1 / len(ids)
    assert abs(r.n - 50_000 * share) < 5 * math.sqrt(50_000 * share / len(ids)) + 50
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    off = c[~np.eye(len(u), dtype=bool)]
    for k, (a, b) in enumerate([(-1.0, 0.0), (0.0, 0.5), (0.5, 0.7)]):
        p = ((off >= a) & (off < b)).mean()
        assert abs(r[f"bin{k}"] / r.n - p) < 0.02


def test_figures_of_domains_are_those_of_their_pages(spark):
    from pyspark.sql import functions as F

    from filinglake.functions import urls

    pages = Q["dom_stats"](spark, SF).join(table(spark, SF, "pages").select("page_id", urls.domain(F.col("url")).alias("domain")), "page_id").collect()
    groups = {}
    for p in pages:
        groups.setdefault(p.domain, []).append(p)
    rows = Q["dom_stats_by_domain"](spark, SF).collect()
    assert {r.domain for r in rows} == set(groups)
    for r in rows:
        g = sorted(groups[r.domain], key=lambda p: p.page_id)
        assert r.n_pages == len(g) and r.heading_distribution == {h: sum(p.heading_distribution[h] for p in g) for h in g[0].heading_distribution}
        for n, kind in dom.STAT_FIELDS:
            v = [p[n] for p in g]
            some = [x for x in v if x is not None]
            if n in dom.RATIOS:
                above, below = dom.RATIOS[n]
                d = sum(p[below] for p in g)
                assert r[n] == pytest.approx(sum(p[x] for x in above for p in g) / d if d else 0.0, abs=1e-4), n
            elif n in dom.WEIGHTED:
                w = [(p[n], p[dom.WEIGHTED[n]]) for p in g if p[n] is not None]
                d = sum(b for _, b in w)
                assert r[n] is None if not d else r[n] == pytest.approx(sum(a * b for a, b in w) / d, abs=1e-4), n
            elif n in dom.MAXIMA:
                assert r[n] == max(some, default=None), n
            elif kind == "b":
                assert r[n] == any(some), n
            elif kind == "s":
                assert r[n] == (some[0] if some else None), n
            elif kind == "d":
                assert r[n] is None if not some else r[n] == pytest.approx(sum(some) / len(some), abs=1e-4), n
            elif n != "heading_distribution":
                assert r[n] == (sum(some) if some else None), n
