import re

from filinglake.plans import catalogue, corpus
from filinglake.session import table

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect() if r.text is not None}


def test_line_boundaries_of_every_document(spark):
    want = {}
    for i, t in texts(spark).items():
        ends, p = [], -1
        for x in t.split("\n"):
            p += len(x) + 1
            ends.append(p)
        want[i] = (len(ends), ",".join(map(str, ends)))
    assert {r.doc_id: (r.n, r.bounds) for r in catalogue.QUERIES["line_boundaries"](spark, SF).collect()} == want


def test_table_depth_of_every_document(spark):
    want = {}
    for i, t in texts(spark).items():
        starts, ends, depths = 0, 0, []
        for x in t.split("\n"):
            starts += "a" in x
            depths.append(starts - ends)
            ends += "e" in x
        want[i] = (max(depths), min(depths), len(depths))
    assert {r.doc_id: (r.max_depth, r.min_depth, r.n_lines) for r in catalogue.QUERIES["table_depth"](spark, SF).collect()} == want


def test_tables_of_every_order(spark):
    keys = {r.o_orderkey for r in table(spark, SF, "orders").select("o_orderkey").collect()}
    assert {r.o_orderkey for r in catalogue.QUERIES["table_grid"](spark, SF).select("o_orderkey").collect()} == keys
    assert {r.o_orderkey for r in catalogue.QUERIES["table_repair"](spark, SF).select("o_orderkey").collect()} == keys


def test_fetch_status_counts_every_event(spark):
    want = {}
    for e in table(spark, SF, "events").collect():
        ok, n = want.get(e.user_id, (0, 0))
        want[e.user_id] = (ok + (e.event_type in ("view", "click", "signup")), n + 1)
    got = {r.domain: (r.n_ok, r.n, r.needs_fetch) for r in catalogue.QUERIES["fetch_status_rollup"](spark, SF).collect()}
    assert got == {d: (ok, n, not ok) for d, (ok, n) in want.items()}


def test_page_concat_keeps_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PIECE", 50)
    held = {}
    for r in table(spark, SF, "documents").collect():
        held.setdefault((r.source, r.doc_id // 50), []).append((r.doc_id, r.text))
    got = {(r.source, r.piece): (r.text, r.n_pages) for r in catalogue.QUERIES["page_concat"](spark, SF).collect()}
    assert got == {s: ("\n".join(f"########## http://d/{i}\n{t}" for i, t in sorted(x)), len(x)) for s, x in held.items()}


def test_word_budget_keeps_every_document_of_a_thousand_tokens(spark):
    want = {i: len(re.findall(r"\S+", t)) for i, t in texts(spark).items()}
    got = {r.doc_id: r.n_words for r in catalogue.QUERIES["word_budget_filter"](spark, SF).collect()}
    assert got == {i: n for i, n in want.items() if int(n * 1.35) >= 1000} and any(int(n * 1.35) < 4000 for n in got.values())
