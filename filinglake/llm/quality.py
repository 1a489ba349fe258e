"""Quality rules as a short-circuit cascade, in SQL expressions only.

Every rule has a cost and a rejection rate, both measured on a bounded sample
(about ``SAMPLE_ROWS`` rows, thinned by hash); rules then run in order of
rejections per second, each only on what the earlier ones let pass, as one
CASE. A rule's seconds are those of a job over the sample, the least of
``RUNS`` after one that compiles it, less those of a job without a rule. The
order changes the run time alone: a document is kept if no rule rejects it.

A text is cut into words once, and all rules share them. Words are runs of
anything but the six ASCII white-space characters. Repeats are found by
sorting the 64-bit hashes of a text's 8-word windows, so a text of any length
costs n log n. Null texts have no words; empty tables give empty results;
repeated rows are judged alike; columns of the input that bear the name of a
result column are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglake.llm._shared import by_name, by_position

WINDOW = 8
SAMPLE_ROWS = 1000
RUNS = 2
SPACE = r"[ \t\n\x0B\f\r]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once; ``body`` may use it often without computing it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_symbols(text: Column) -> Column:
    t = rest = F.coalesce(text, F.lit(""))
    for c in SYMBOLS:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(t) - F.octet_length(rest)).cast("long")  # each is one byte


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.rlike(r"[^ \t\n\x0B\f\r]"))


def n_dup_lines(lines: Column) -> Column:
    """Lines equal to an earlier one, compared by 64-bit hash."""
    return let(F.transform(lines, lambda s: F.xxhash64(s)), lambda h: (F.size(h) - F.size(F.array_distinct(h))).cast("long"))


def n_repeat_words(w: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the text, the first one included."""

    def repeated(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.filter(F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda p: p.isNotNull())

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(ordered, lambda s: let(F.sort_array(marked(s)), covered))

    none = F.lit(0).cast("long")
    # each word is hashed once; a window is the hash of its words' hashes
    single = F.transform(w, lambda x: F.xxhash64(x))
    windows = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - WINDOW), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) <= WINDOW, none).otherwise(
        let(let(single, windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(repeated(h)))
    )


class Figures:
    """What rules look at: the text, its words (bound once) and figures, computed where a rule asks or given."""

    def __init__(self, text: Column, words: Column, **given: Column):
        self.text, self.words, self.given = text, words, given
        self.n_words = F.size(words)

    def __getattr__(self, name: str) -> Column:
        if name in self.given:
            return self.given[name]
        if name == "word_chars":
            return F.length(F.array_join(self.words, ""))
        if name == "n_symbols":
            return n_symbols(self.text)
        if name == "n_repeat_words":
            return n_repeat_words(self.words)
        raise AttributeError(name)


@dataclass(frozen=True)
class Rule:
    """``reject`` maps the figures to a boolean: true drops the document; it must not be null."""

    name: str
    reject: Callable[[Figures], Column]


def too_short(f: Figures) -> Column:
    return f.n_words < 20


def too_repetitive(f: Figures) -> Column:
    return f.n_repeat_words * 100 > f.n_words * 30


def too_many_symbols(f: Figures) -> Column:
    return f.n_symbols * 10 > f.n_words


def too_many_dup_lines(f: Figures) -> Column:
    return let(worded_lines(f.text), lambda s: n_dup_lines(s) * 2 > F.size(s))


def mostly_capitals(f: Figures) -> Column:
    """Over half the words with a letter are in capitals."""
    lettered = lambda x: F.lower(x) != F.upper(x)
    capitals = F.size(F.filter(f.words, lambda x: (x == F.upper(x)) & (F.length(x) > 1) & lettered(x)))
    return let(capitals, lambda n: F.when(n == 0, False).otherwise(n * 2 > F.size(F.filter(f.words, lettered))))


def odd_word_length(f: Figures) -> Column:
    """Mean word length outside 2 to 15 characters."""
    return (f.n_words > 0) & ~f.word_chars.between(f.n_words * 2, f.n_words * 15)


BASE_RULES = (Rule("too_short", too_short), Rule("too_repetitive", too_repetitive))
RULES = (
    Rule("too_many_symbols", too_many_symbols),
    Rule("too_many_dup_lines", too_many_dup_lines),
    Rule("mostly_capitals", mostly_capitals),
    Rule("odd_word_length", odd_word_length),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Seconds and rejection rate of each rule on a bounded sample, thinned by hash before any row moves."""
    text = F.col(text_col)
    every = max(1, docs.count() // sample_rows)
    sample = docs.select(text.alias("__t")).filter(F.pmod(F.xxhash64("__t"), F.lit(every)) == 0).limit(sample_rows)
    sample = sample.select("__t", words(F.col("__t")).alias("__w")).cache()
    try:
        n = sample.count()

        def timed(reject: Column) -> tuple[float, int]:
            job, least, hit = sample.agg(F.sum(F.when(reject, 1).otherwise(0))), float("inf"), 0
            for _ in range(RUNS + 1):  # the first run compiles
                began = time.perf_counter()
                hit = job.first()[0] or 0
                least = min(least, time.perf_counter() - began)
            return least, hit

        bare, _ = timed(F.size("__w") < 0)
        out = []
        for rule in rules:
            seconds, hit = timed(rule.reject(Figures(F.col("__t"), F.col("__w"))))
            out.append({"rule": rule, "seconds": max(seconds - bare, 1e-3), "rate": hit / max(n, 1)})
    finally:
        sample.unpersist()
    return out


def ordered(measured: list[dict]) -> tuple[Rule, ...]:
    """Most rejections per second first; ties by less cost, then by name."""
    return tuple(m["rule"] for m in sorted(measured, key=lambda m: (-m["rate"] / m["seconds"], m["seconds"], m["rule"].name)))


def passes(figures: Figures, rules: tuple[Rule, ...]) -> Column:
    """True if no rule rejects; later rules are not evaluated once one has."""
    out = None
    for rule in rules:
        out = F.when(rule.reject(figures), False) if out is None else out.when(rule.reject(figures), False)
    return F.lit(True) if out is None else out.otherwise(True)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass every rule, in their own columns."""
    text = F.col(text_col)
    order = ordered(measure(docs, rules, text_col))
    return docs.filter(let(words(text), lambda w: passes(Figures(text, w), order)))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Input rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept; input columns of these names are replaced."""
    given, (docs, at) = docs, by_position(docs)
    text_col = at(text_col)
    text = F.col(text_col)
    order = ordered(measure(docs, rules, text_col))

    def figures(w: Column) -> Column:
        base = F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            n_symbols(text).alias("n_symbols"),
            n_dup_lines(worded_lines(text)).alias("n_dup_lines"),
            n_repeat_words(w).alias("n_repeat_words"),
        )

        def judged(b: Column) -> Column:
            failed = (b["n_words"] < 20) | (b["n_repeat_words"] * 100 > b["n_words"] * 30)
            known = Figures(text, w, word_chars=b["word_chars"], n_symbols=b["n_symbols"], n_repeat_words=b["n_repeat_words"])
            return F.struct(*[b[n].alias(n) for n in names], failed.alias("base_failed"), F.when(failed, False).otherwise(passes(known, order)).alias("kept"))

        return let(base, judged)

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    made = (*names, "base_failed", "kept")
    return docs.withColumn("__base", let(words(text), figures)).select(*by_name(given, made), *[F.col("__base")[n].alias(n) for n in made])
