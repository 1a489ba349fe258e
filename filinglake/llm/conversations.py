"""Repair of the turn structure of conversations at least cost.

A conversation's role initials have to read ``(s?(ua)+)?``. Its rows are kept
(0), get another role (2) or are deleted (3); user or assistant rows without
text are inserted (2); a row cut short that stays adds 1. Blank rows and rows
seen earlier must go. Edits are spelt by their initials, K R D I; of equally
cheap repairs the one whose spelling is least in ASCII is taken.

The weighted edit automaton is determinised lazily: a state is the vector of
costs to go from the four places of the role pattern, less its least entry,
and every (state, symbol) is worked out once a worker and kept in a table. A scan of
that table from the last row to the first gives the cost; a trace back along
tight arcs, from the first row to the last, takes the least letter that
costs no more.

Nothing holds a conversation's texts: the plan reads faults alone and keeps a
few bytes a row, and the texts meet their plan as a sorted stream. Rows go
by turn, nulls first, then by role and MD5 of the text. A null role or text is
one space; null ids are one conversation; repeated rows after the first are
duplicates; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1  # costs
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
START, SYSTEM, USER, ASSISTANT = range(4)  # places in the role pattern
PUT = (USER, USER, ASSISTANT, USER)  # the place after the one role that may be put in
TAKES = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})  # by initial; the last is any other
ENDS = (0, 2 * INSERT, INSERT, 0)  # cost from each place to an end of the pattern
CLOSING = ("", "II", "I", "")
NAMES = {USER: "user", ASSISTANT: "assistant"}
MUST_GO = 0
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def symbol(initial: int, fault: int) -> int:
    """What of a row matters for its repair: that it must go, or its initial and whether it is cut short."""
    return MUST_GO if fault in (BLANK, DUPLICATE) else 1 + 2 * initial + (fault == TRUNCATED)


class CostAutomaton:
    """The determinised automaton as far as it was needed so far."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.tight: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.last, _ = self._state(ENDS)

    def _state(self, costs) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    def _uses(self, after: tuple, sym: int, place: int) -> list[tuple[str, int, int]]:
        """Ways to use up a row at a place: (letter, cost to go, next place), letters ascending."""
        out = [("D", DELETE + after[place], place)]
        if sym != MUST_GO:
            initial, short = divmod(sym - 1, 2)
            if place in TAKES[initial]:
                out.append(("K", KEEP + short * CUT_SHORT + after[TAKES[initial][place]], TAKES[initial][place]))
            out.append(("R", REROLE + short * CUT_SHORT + after[PUT[place]], PUT[place]))
        return out

    def _costs(self, after: tuple, sym: int) -> list[int]:
        costs = [min(c for _, c, _ in self._uses(after, sym, p)) for p in range(4)]
        for _ in range(3):  # insertions in front of the row; a fourth would come round to a place passed before
            costs = [min(costs[p], INSERT + costs[PUT[p]]) for p in range(4)]
        return costs

    def step(self, state: int, sym: int) -> tuple[int, int]:
        """(state before the row, cost split off)."""
        found = self.table.get((state, sym))
        if found is None:
            found = self.table[state, sym] = self._state(self._costs(self.vectors[state], sym))
        return found

    def arcs(self, state: int, sym: int, place: int) -> tuple[str, int]:
        """Least tight letters from a place up to the one that uses the row, and the place behind it."""
        key = (state, sym, place)
        found = self.tight.get(key)
        if found is None:
            after = self.vectors[state]
            costs, letters = self._costs(after, sym), ""
            while True:
                ways = [w for w in self._uses(after, sym, place) if w[1] == costs[place]]
                if INSERT + costs[PUT[place]] == costs[place]:
                    ways.append(("I", costs[place], -1))
                letter, _, behind = min(ways)
                letters += letter
                if behind >= 0:
                    break
                place = PUT[place]
            found = self.tight[key] = (letters, behind)
        return found

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """(least cost, edits) of one conversation."""
        state, cost = self.last, 0
        states = array("H", [0]) * len(symbols)  # the state behind each row
        for i in range(len(symbols) - 1, -1, -1):
            states[i] = state
            state, off = self.step(state, symbols[i])
            cost += off
        cost += self.vectors[state][START]
        place, out = START, []
        for s, sym in zip(states, symbols):
            letters, place = self.arcs(s, sym, place)
            out.append(letters)
        return cost, "".join(out) + CLOSING[place]


_automaton = CostAutomaton()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: a twentieth each dropped (present false), emptied, stripped of ``.!?``, repeated, given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(h == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), (h != 0).alias("present"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _rows(conversations: DataFrame, present: Column | None) -> DataFrame:
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), here.alias("here"))
    return out.withColumn("mark", F.md5("text"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]


def repair_plan(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """A row a conversation: faults, gaps between turns, illegal neighbours, least cost and edits.

    Rows that are not ``present`` only name their conversation. The texts do not move; duplicates are told by role and MD5.
    """
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = _rows(conversations, present).select(
        "conv_id", "turn", "role", "mark", "here", (F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1).alias("initial"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("short")
    )
    seen = Window.partitionBy("conv_id", "here", "role", "mark").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(F.col("blank"), BLANK).when(F.row_number().over(seen) > 1, DUPLICATE).when(F.col("short"), TRUNCATED).otherwise(NONE)
    initial = F.when((F.col("role") == "") | (F.col("initial") < 0), len(INITIALS)).otherwise(F.col("initial"))
    judged = rows.repartition("conv_id").withColumn("fault", fault).select("conv_id", "turn", "role", "mark", "here", initial.alias("initial"), "fault")
    ready = judged.sortWithinPartitions("conv_id", *_order()).select("conv_id", "turn", "here", F.col("initial").cast("int"), F.col("fault").cast("int"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        legal = {(0, 1), (1, 2), (2, 1)}
        out: list[tuple] = []
        now, open_ = None, False

        def close() -> None:
            cost, edits = _automaton.repair(bytes(symbols))
            out.append((now, high - low + 1 - n_turns if n_turns else 0, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, edits))

        for batch in batches:
            for conv, turn, here, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if not open_ or conv != now:
                    if open_:
                        close()
                    now, open_ = conv, True
                    symbols, faults, illegal, before, low, high, n_turns = bytearray(), [0] * 4, 0, None, None, None, 0
                if not here:
                    continue
                symbols.append(symbol(initial, fault))
                faults[fault] += 1
                illegal += before is not None and (before, initial) not in legal
                before = initial
                if turn is not None and turn != high:
                    low, high, n_turns = turn if low is None else low, turn, n_turns + 1
            if len(out) >= 4096:
                yield _batch(out, PLAN_ARROW)
                out = []
        if open_:
            close()
        if out:
            yield _batch(out, PLAN_ARROW)

    return ready.mapInArrow(plan, PLAN)


PLAN_ARROW = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _streamed(conversations: DataFrame, present: Column | None) -> DataFrame:
    """Every conversation's plan followed by its rows in order, as a stream sorted inside partitions."""
    names = [f.split()[0] for f in PLAN.split(", ")]
    figures = F.struct(*names[1:])
    plans = repair_plan(conversations, present).select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("text"), figures.alias("plan"))
    rows = _rows(conversations, present).filter("here").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "mark", "text", F.lit(None).cast(plans.schema["plan"].dataType).alias("plan"))
    return plans.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order()).select("conv_id", "turn", "role", "text", "plan")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, plan or None, edit, turn, role, text): one a plan, one an edit in order; deleted rows keep their own role and text."""
    conv, edits, at, place = None, "", 0, START

    def put() -> Iterator[tuple]:
        nonlocal at, place
        while edits[at : at + 1] == "I":
            at, place = at + 1, PUT[place]
            yield conv, None, "I", None, NAMES[place], ""

    for batch in batches:
        for new, turn, role, text, plan in zip(*(c.to_pylist() for c in batch.columns)):
            if plan is not None:
                yield from put()
                conv, edits, at, place = new, plan["audit"], 0, START
                yield conv, plan, None, None, None, None
                continue
            yield from put()
            letter, at = edits[at], at + 1
            if letter == "K":
                place = TAKES[INITIALS.index(role[0])][place]
            elif letter == "R":
                place = PUT[place]
                role = NAMES[place]
            yield conv, None, letter, turn, role, text
    yield from put()


def repaired(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """Every conversation's rows after repair, with the edit that each had: conv_id, seq, edit (K, R, I; D rows are shown as they were), turn, role, text."""
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seq = [], 0
        for conv, plan, edit, turn, role, text in _edits(batches):
            if plan is not None:
                seq = 0
                continue
            out.append((conv, seq, edit, turn, role, text))
            seq += 1
            if len(out) == 2048:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return _streamed(conversations, present).mapInArrow(emit, "conv_id long, seq long, edit string, turn long, role string, text string")


def repair_report(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """The plan of every conversation and the SHA-256 of its repaired ``role:text`` lines, hashed as they stream past."""
    schema = pa.schema([*PLAN_ARROW, ("repaired_sha256", pa.string())])
    names = PLAN_ARROW.names[1:]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, digest, first = None, None, True
        for conv, plan, edit, _, role, text in _edits(batches):
            if plan is not None:
                if held is not None:
                    out.append((*held, digest.hexdigest()))
                    if len(out) == 2048:
                        yield _batch(out, schema)
                        out = []
                held, digest, first = (conv, *(plan[n] for n in names)), hashlib.sha256(), True
            elif edit != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if held is not None:
            out.append((*held, digest.hexdigest()))
        if out:
            yield _batch(out, schema)

    return _streamed(conversations, present).mapInArrow(emit, PLAN + ", repaired_sha256 string")
