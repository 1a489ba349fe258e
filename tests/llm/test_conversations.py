import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from filinglake.llm import conversations as C
from filinglake.llm import queries as Q

DONE = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = re.findall("[^\x20\x09-\x0d]", text)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Best-first search over edit strings: the first that is finished is the cheapest and, among those, the least."""
    room = [(0, "", 0, "", ())]
    best = set()
    while True:
        cost, edits, at, initials, repaired = heapq.heappop(room)
        if at == len(rows) and DONE.fullmatch(initials):
            return cost, edits, repaired
        # of equal places in the pattern only the first one met can win: its cost and then its spelling are least
        place = (at, initials[-1:])
        if place in best:
            continue
        best.add(place)
        nexts = [("I", 2, at, r[0], f"{r}:") for r in ("user", "assistant")]
        if at < len(rows):
            _, _, role, text = rows[at]
            nexts.append(("D", 3, at + 1, "", None))
            if marks[at] not in ("blank", "duplicate"):
                short = marks[at] == "truncated"
                nexts.append(("K", short, at + 1, role[:1] or "-", f"{role}:{text}"))
                nexts += [("R", 2 + short, at + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for letter, price, behind, initial, line in nexts:
            grown = initials + initial
            if re.fullmatch("s?(ua)*u?", grown):
                heapq.heappush(room, (cost + price, edits + letter, behind, grown, repaired if line is None else (*repaired, line)))


def plain(rows):
    out = {}
    hurt = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = in_order([r for r in hurt if r[0] == conv])
        marks = faults(mine)
        turns = {r[1] for r in mine} - {None}
        pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(mine, mine[1:])]
        cost, edits, lines = cheapest(mine, marks)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n_convs=150):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(n_convs)]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, t + 3, None, -t]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]), rng.choice(["Yes.", "No!", "cut", "", None, " \t", "ö?\n ", f"text {rng.random()}.", f"open {rng.random()}", "end.\xa0"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_made_conversations_by_search(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, `plan.here` int, __mark string").repartition(3)
    assert report(C.repair_report(C.damage(df), F.col("present"))) == plain(rows)


def test_every_conversation_of_the_table_by_search(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert report(Q.QUERIES["op13_turn_repair"](spark, sf)) == plain(rows)


def test_all_short_symbol_strings_by_search():
    import itertools

    classes = [("system", "s"), ("user", "u"), ("assistant", "a"), ("tool", "t")]
    marks = ["", "truncated", "blank"]
    auto = C.CostAutomaton()
    for n in range(4):
        for kinds in itertools.product(range(4), repeat=n):
            for held in itertools.product(marks, repeat=n):
                rows = [(0, i, classes[k][0], f"t{i}.") for i, k in enumerate(kinds)]
                cost, edits, _ = cheapest(rows, held)
                code = {"": C.NONE, "truncated": C.TRUNCATED, "blank": C.BLANK}
                assert auto.repair(bytes(C.symbol(k, code[m]) for k, m in zip(kinds, held))) == (cost, edits)
    assert len(auto.vectors) < 60


def test_repaired_rows_read_the_pattern(spark):
    df = spark.createDataFrame(made(5, 30), "conv_id long, turn long, role string, text string")
    rows = C.repaired(df).orderBy("conv_id", "seq").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    for held in by.values():
        assert DONE.fullmatch("".join(r.role[0] for r in held if r.edit != "D"))
    plans = report(C.repair_report(df))
    assert {c: "".join(r.edit for r in held) for c, held in by.items()} == {c: p[6] for c, p in plans.items() if p[6]}


def test_empty_table_and_one_long_conversation(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert C.repair_report(spark.createDataFrame([], schema)).count() == 0
    df = spark.range(60_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text")
    row = C.repair_report(df).collect()[0]
    want = hashlib.sha256("\n".join(f"{('user', 'assistant')[i % 2]}:t{i}." for i in range(60_000)).encode()).hexdigest()
    assert (row.cost, row.audit, row.repaired_sha256) == (0, "K" * 60_000, want)
