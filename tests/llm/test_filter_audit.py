import itertools
import re

import pytest

from filinglake.llm import filter_audit as A
from filinglake.llm import queries as Q
from tests.compare import differences

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (5, LONG, "en"), (3, LONG, "de"), (9, LONG, None), (3, LONG, "de"), (3, LONG, "fr"), (None, LONG, "en"), (None, None, "en"), (1, "", "en"), (2, None, ""), (2, "short", "en"),
    (7, "a b " * 200, "en"), (8, "ÄÖ XYZ " + LONG, "en"), (10, "A" * 40 + " x " * 99, "en"), (11, LONG + " #", "de"), (12, "x\x0by\x0cz\xa0q\x1cr " * 30, "de"), (-4, "a b " * 200, "en"), (20, "w " * 500_000, "en"),
]
LABELS = [(3, 1, 0), (3, 0, 1), (5, 1, None), (9, None, 1), (None, 1, 1), (7, 1, 1), (99, 1, 1), (20, 0, 1)]


def plain(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    held = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        held.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shares = {}, {}
    for order in itertools.permutations("ABCDE"):
        for part in {h[0] for h in held}:
            mine = [h for h in held if h[0] == part]
            alive = list(mine)
            for step, f in enumerate(order, 1):
                gone = [h for h in alive if f in h[1]]
                alive = [h for h in alive if f not in h[1]]
                failing = sum(f in h[1] for h in mine)
                out[part, "".join(order), step] = [len(alive), len(gone), failing - len(gone), sum(h[1] == {f} for h in mine), sum(h[2] for h in gone), sum(h[3] for h in gone)]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def figures(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, lang string, `meta.mask` int, __key string").repartition(3)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_all_orders_by_plain_simulation(tables):
    assert figures(A.audit(*tables)) == plain(ROWS, LABELS)


def test_texts_of_one_fingerprint_stay_apart_and_little_memory_changes_nothing(tables, monkeypatch):
    monkeypatch.setattr(A, "fingerprint", lambda raw: 7)
    monkeypatch.setattr(A, "HELD_BYTES", 1000)
    # functions of this module travel by name; run the two halves here as tasks would
    docs = [(r.doc_id, r.text, r.lang) for r in tables[0].collect()]
    routed = [x for k in range(3) for x in A._read(iter(docs[k::3]))]
    got = sorted((r[1] is None, r[1] or 0, r[2], r[3]) for r in A._chained(iter(sorted(routed, key=lambda x: x[0]))) for _ in range(r[4]))
    monkeypatch.undo()
    want = sorted((r.doc_id is None, r.doc_id or 0, r.part, r["mask"]) for r in A.masks(tables[0]).collect() for _ in range(r.n))
    assert got == want and len(got) == len(ROWS)
    assert sorted(r.doc_id for r in A.copy_ids(tables[0]).collect()) == [2, 5, 7, 9]


def test_copies_leave_a_task_once():
    rows = [(i, LONG, "en") for i in range(1000)] + [(-1, LONG, "de")]
    sent = [v for _, v in A._read(iter(rows)) if v[0] is not None]
    assert len(sent) == 1 and sent[0][2] == {"de": 1}


def test_empty_tables(spark, tables):
    assert A.audit(tables[0].limit(0), tables[1]).count() == 0
    got = figures(A.audit(tables[0], tables[1].limit(0)))
    assert got == plain(ROWS, [])


def test_query_against_sql_and_simulation(spark):
    assert differences(Q.QUERIES["op11_filter_audit"](spark, SF), Q.ORACLES["op11_filter_audit"], SF) == ""
    small = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{small}/labels.parquet").collect()]
    assert figures(Q.QUERIES["op11_filter_audit"](spark, small)) == plain(docs, labels)
