"""Token counts by section: whole texts are encoded once and tokens are attributed by their spans.

Every token has a byte span in its text. Sections are spans too: the lines of
the text, or those of a column of (name, start, end) character spans. The two
lists meet in an interval join inside the row. A token that lies in one
section counts there; one that crosses a boundary is allocated by ``rule``:

- ``first``: to the section of its first byte,
- ``largest``: to the section that holds most of its bytes, the earlier on a tie,
- ``split``: to each section in proportion to the bytes in it.

Tokens outside all given sections are reported under section null. Null and
empty texts have one empty section 0 with no tokens. Repeated rows each give
their own rows; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filinglake.llm import _bpe

RULES = ("first", "largest", "split")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long"


def line_spans(raw: bytes) -> np.ndarray:
    """(start, end) byte spans of lines, each with its newline."""
    cuts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    if len(cuts) and cuts[-1] == len(raw):
        cuts = cuts[:-1]
    starts = np.concatenate([[0], cuts])
    return np.stack([starts, np.concatenate([starts[1:], [len(raw)]])], axis=1)


def attribute(token_ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens and boundary-crossing tokens of each sorted, disjoint span, and the tokens outside all of them."""
    counts, crossing = np.zeros(len(spans)), np.zeros(len(spans), np.int64)
    if not len(token_ends):
        return counts, crossing, 0.0
    a = np.concatenate([[0], token_ends[:-1]])
    b = token_ends
    first = np.searchsorted(spans[:, 1], a, "right")  # first span that ends behind the token's start
    last = np.searchsorted(spans[:, 0], b, "left") - 1  # last span that starts before the token's end
    inside = (first == last) & (first < len(spans))
    whole = inside.copy()
    whole[inside] = (spans[first[inside], 0] <= a[inside]) & (spans[first[inside], 1] >= b[inside])
    counts += np.bincount(first[whole], minlength=len(spans))
    outside = float(np.count_nonzero(first > last))
    for t in np.flatnonzero(~whole & (first <= last)):
        parts = range(first[t], last[t] + 1)
        held = [min(b[t], spans[s, 1]) - max(a[t], spans[s, 0]) for s in parts]
        crossing[parts.start : parts.stop] += 1
        if rule == "split":
            for s, h in zip(parts, held):
                counts[s] += h / (b[t] - a[t])
            outside += 1 - sum(held) / (b[t] - a[t])
        elif rule == "largest":
            counts[parts[int(np.argmax(held))]] += 1
        elif spans[parts[0], 0] <= a[t]:
            counts[parts[0]] += 1
        else:
            outside += 1
    return counts, crossing, outside


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """One row a section: doc_id, section, start and end (bytes), n_tokens, n_crossing.

    ``spans_col``: sorted, disjoint array<struct<start,end>> in characters; the lines of the text if not given.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    tokenizer = tokenizer or _bpe.default_tokenizer()
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _bpe.encoder(tokenizer)
        for batch in batches:
            held: list[list[np.ndarray]] = [[] for _ in names]
            nulls: list[np.ndarray] = []
            rows = 0
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                text = batch.column(1)[k].as_py() or ""
                raw = text.encode()
                if spans_col is None:
                    spans = line_spans(raw)
                else:
                    given = batch.column(2)[k].as_py() or []
                    at = np.array([[s["start"], s["end"]] for s in given], np.int64).reshape(-1, 2)
                    if len(raw) != len(text):
                        heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                        at = np.concatenate([heads, [len(raw)]])[np.clip(at, 0, len(heads))]
                    spans = np.clip(at, 0, len(raw))
                counts, crossing, outside = attribute(enc.ends(enc.encode(text)), spans, rule)
                section = np.arange(len(spans))
                if outside:
                    section = np.append(section, -1)
                    spans = np.vstack([spans, [[-1, -1]]])
                    counts, crossing = np.append(counts, outside), np.append(crossing, 0)
                n = len(section)
                nulls.append(np.full(n, doc_id is None))
                for column, v in zip(held, (np.full(n, doc_id or 0), section, spans[:, 0], spans[:, 1], counts, crossing)):
                    column.append(v)
                rows += n
                if rows > 50_000:
                    yield _batch(held, nulls)
                    held, nulls, rows = [[] for _ in names], [], 0
            if rows:
                yield _batch(held, nulls)

    def _batch(held, nulls) -> pa.RecordBatch:
        ids, section, start, end, counts, crossing = (np.concatenate(c) for c in held)
        out = section < 0
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=np.concatenate(nulls)), pa.array(section, pa.int32(), mask=out), pa.array(start, pa.int64(), mask=out), pa.array(end, pa.int64(), mask=out), pa.array(counts, pa.float64()), pa.array(crossing, pa.int64())], names
        )

    picked = [F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")]
    if spans_col:
        picked.append(F.col(spans_col).alias("_spans"))
    return docs.select(*picked).mapInArrow(count, SCHEMA)
