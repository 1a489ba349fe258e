import random
import time

import pytest

from filinglake.operators import linediff, sites
from filinglake.plans import catalogue
from filinglake.session import table


def longest(a, b):
    row = [0] * (len(b) + 1)
    for s in a:
        last = 0
        for j, t in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if s == t else max(row[j], row[j - 1])
    return row[-1]


def is_subsequence(part, whole):
    it = iter(whole)
    return all(s in it for s in part)


@pytest.mark.parametrize("most", [0, 3, 400])
def test_script_length_by_dynamic_programming(monkeypatch, most):
    monkeypatch.setattr(linediff, "MOST_EDITS", most)
    monkeypatch.setattr(linediff, "OFTEN", 2)
    rng = random.Random(most)
    for _ in range(600):
        kinds = rng.choice([1, 2, 4, 30])
        a, b = ([f"l{rng.randrange(kinds)}" for _ in range(rng.randrange(40))] for _ in range(2))
        if rng.random() < 0.5:
            b = [s for s in a if rng.random() < 0.9] + b[:3]
        kept = linediff.kept_lines(a, b)
        common = [s for s, k in zip(b, kept) if k]
        assert len(common) == longest(a, b) and is_subsequence(common, a), (a, b)


def test_many_lines_take_a_second():
    rng = random.Random(1)
    a = [f"line {i % 5000}" for i in range(100_000)]
    b = list(a)
    for k in range(10):
        b[rng.randrange(len(b))] = f"new {k}"
    began = time.process_time()
    assert sorted(s for s, k in zip(b, linediff.kept_lines(a, b)) if not k) == sorted(f"new {k}" for k in range(10))
    assert time.process_time() - began < 1
    one = ["same"] * 100_000
    began = time.process_time()
    assert sum(linediff.kept_lines(one, [*one[:50_000], "x", *one[50_000:], "y"])) == 100_000
    assert time.process_time() - began < 1
    few = [[f"k{rng.randrange(4)}" for _ in range(20_000)] for _ in range(2)]
    began = time.process_time()
    assert sum(linediff.kept_lines(*few)) > 12_000
    assert time.process_time() - began < 10  # unlike texts of few kinds of lines, the worst case
    apart = [f"u{i}" for i in range(20_000)]
    moved = apart[10_000:] + apart[:10_000]
    assert sum(linediff.kept_lines(apart, moved)) == 10_000
    assert not any(linediff.kept_lines([], one)) and not any(linediff.kept_lines(["a"], ["b"] * 9))


def test_added_lines_of_every_document(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.added for r in catalogue.QUERIES["added_lines"](spark, sf).collect()}
    by = {}
    for r in table(spark, sf, "documents").collect():
        by.setdefault(r.source, []).append((r.doc_id, r.text or ""))
    n = 0
    for docs in by.values():
        before = ""
        for i, text in sorted(docs):
            new = got[i].split("\n") if got[i] else []
            lines = text.split("\n")
            if before != text:
                hidden = sum(s.startswith("++") for s in lines)
                assert is_subsequence(new, lines) and abs(len(lines) - longest(before.split("\n"), lines) - len(new)) <= hidden + (new == [])
            before, n = text, n + 1
    assert n == len(got)
    assert sites.diff_added("", "++lost\nkept") == "kept"
