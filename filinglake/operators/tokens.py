"""Chunks of token arrays, and texts put together again from tokens with what a model predicted for masked ones.

Arrays begin with an opening and end with a closing mark; positions count the tokens between them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglake.functions import numbers
from filinglake.operators import corpus
from filinglake.operators.examples import CLS, HELD, NEW_LINE, SEP, TABLE_END, TABLE_START, Vocabulary


def boundaries(content: np.ndarray, line_ends: Iterable[int] = (NEW_LINE,), tables: bool = True) -> np.ndarray:
    """Places behind line ends; with ``tables``, only behind those outside table marks (starts so far less the ends before)."""
    ends_line = np.isin(content, list(line_ends))
    if tables:
        starts, ends = content == TABLE_START, content == TABLE_END
        ends_line &= np.cumsum(starts) - (np.cumsum(ends) - ends) <= 0
    return np.flatnonzero(ends_line) + 1


def boundaries_of(ids: Column, line_ends: Iterable[int] = (NEW_LINE,), tables: bool = True) -> Column:
    """The boundaries of wrapped token arrays."""
    line_ends = tuple(line_ends)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: boundaries(np.asarray(x)[1:-1], line_ends, tables).astype("int32"), na_action="ignore")

    return run(ids)


def chunk(tokenised: DataFrame, low: int = 128, high: int = 1024, cap: int | None = 8190, tail: int = 16, seed: int = 0, per_chunk: bool = True, min_chunks: int = 1, line_ends: Iterable[int] = (NEW_LINE,), tables: bool = True) -> DataFrame:
    """Rows of ``id, input_ids, is_number_mask, number_values`` cut into chunks, each wrapped in its own marks.

    A chunk aims at a length drawn between ``low`` and ``high`` by hash of (seed, id, chunk), or once a document; it ends
    at the nearest boundary, takes a rest shorter than ``tail`` with it, and has ``cap`` tokens at most. The chunks of a document
    put together are its tokens. Documents of fewer than ``min_chunks`` go.
    """
    line_ends = tuple(line_ends)
    kind = tokenised.schema["id"].dataType
    out_type = T.StructType(
        [T.StructField("id", kind)] + [T.StructField(n, T.IntegerType()) for n in ("chunk_idx", "doc_start", "doc_end")]
        + [T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("is_number_mask", T.ArrayType(T.BooleanType())), T.StructField("number_values", T.ArrayType(T.FloatType())), T.StructField("seq_length", T.IntegerType())]
    )

    arrow = (*[pa.int32()] * 3, pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.float32()), pa.int32())

    def flat(array: pa.ListArray, row: int) -> np.ndarray:
        start, end = array.offsets[row].as_py(), array.offsets[row + 1].as_py()
        return array.values.slice(start, end - start).to_numpy(zero_copy_only=False)[1:-1]

    def wrap(content: np.ndarray, spans: list[tuple[int, int]], opening, closing) -> list[np.ndarray]:
        ends = np.array([opening, closing], content.dtype)
        return [np.concatenate([ends[:1], content[a:b], ends[1:]]) for a, b in spans]

    def made(out: list[list], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (kind, *arrow))], names=out_type.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, out, held = [batch.column(k) for k in (1, 2, 3)], [[] for _ in out_type.names], 0
            for row, doc in enumerate(batch.column(0).to_pylist()):
                content = flat(arrays[0], row)
                size = lambda k, doc=doc: low + zlib.crc32(f"{seed}:{doc}:{k if per_chunk else 0}".encode()) % (high - low + 1)
                spans = corpus.chunk_spans(len(content), boundaries(content, line_ends, tables).tolist(), size, tail, cap)
                if not spans or len(spans) < min_chunks:
                    continue
                wrapped = [wrap(flat(a, row), spans, *marks) for a, marks in zip(arrays, ((CLS, SEP), (False, False), (0.0, 0.0)))]
                for column, new in zip(out, ([doc] * len(spans), range(len(spans)), *zip(*spans), *wrapped, map(len, wrapped[0]))):
                    column.extend(new)
                held += len(content)
                if held >= HELD:  # what is made leaves before there is a whole batch of it
                    yield made(out, batch.column(0).type)
                    out, held = [[] for _ in out_type.names], 0
            yield made(out, batch.column(0).type)

    return tokenised.select("id", F.col("input_ids").cast("array<int>"), F.col("is_number_mask"), F.col("number_values").cast("array<float>")).mapInArrow(run, out_type)


IGNORED = -100  # label of a token that is not to be predicted
SENTINEL = 13.0  # value of a masked number


def mask(rows: DataFrame, row: str, mask_id: int, vocabulary: int, low: float = 0.15, high: float = 0.15, seed: int = 0, special: tuple[int, ...] = (CLS, SEP)) -> DataFrame:
    """``rows`` (input_ids, is_number_mask, number_values) with masked_ids, masked_values, labels and label_values, as arrays alike in length.

    Each row's rate is drawn between ``low`` and ``high``; special tokens are never chosen. Of the chosen ones 80 % are masked (a number by the
    sentinel), 10 % replaced (a word by an id below ``vocabulary``, a number by a magnitude), 10 % kept. All draws are hashes of (seed, row, place).
    """
    drawn = lambda k, i: corpus.unit_hash(F.lit(seed + k), F.col(row), i)
    rate = F.lit(low) + (high - low) * corpus.unit_hash(F.lit(seed), F.col(row))
    action = F.transform("input_ids", lambda x, i: F.when((drawn(1, i) >= rate) | x.isin(*special), "none").when(drawn(2, i) < 0.8, "mask").when(drawn(2, i) < 0.9, "random").otherwise("keep"))
    number = lambda i: F.get("is_number_mask", i)
    does = lambda i: F.get("__action", i)
    ids = F.transform("input_ids", lambda x, i: F.when(number(i) | does(i).isin("none", "keep"), x).when(does(i) == "mask", mask_id).otherwise(F.floor(drawn(4, i) * vocabulary).cast("int")))
    values = F.transform("number_values", lambda v, i: F.when(~number(i) | does(i).isin("none", "keep"), v.cast("double")).when(does(i) == "mask", SENTINEL).otherwise(-12 + 24 * drawn(3, i)))
    labels = F.transform("input_ids", lambda x, i: F.when((does(i) == "none") | number(i), IGNORED).otherwise(x))
    wanted = F.transform("number_values", lambda v, i: F.when((does(i) == "none") | ~number(i), float(IGNORED)).otherwise(v.cast("double")))
    return rows.withColumn("__action", action).withColumns({"masked_ids": ids, "masked_values": values, "labels": labels, "label_values": wanted}).drop("__action")


def pieces(ids: Column, words: Vocabulary) -> Column:
    """Texts of an array of ids, one by one, so that leading blanks stay."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        known: dict[int, str] = {}

        def piece(i: int) -> str:
            if i not in known:
                known[i] = words.piece(i)
            return known[i]

        return s.map(lambda x: [piece(int(i)) for i in x], na_action="ignore")

    return run(ids)


def with_predictions(tokens: DataFrame, predicted: DataFrame, row: str, pos: str) -> DataFrame:
    """(row, text): each row's tokens put together, with what was predicted for the masked ones.

    ``tokens`` has token, piece (its text, leading blanks and all), log (of numbers, else null), masked and special; ``predicted`` has
    row, pos, token, piece and log of masked tokens. Special tokens are left out; a masked word guessed right reads ``(**word**)``, a
    wrong one ``(~~guess~~**word**)`` behind its blanks, a masked number likewise; what has no letter or digit, and all that is not
    masked, reads as it is. A masked token without a prediction counts as guessed wrong, by nothing.
    """
    guess = predicted.select(row, pos, F.col("token").alias("guess"), F.col("piece").alias("guessed"), F.col("log").alias("guessed_log"))
    met = tokens.join(guess, [row, pos], "left")
    word, guessed = F.regexp_replace("piece", r"^\s+|\s+$", ""), F.regexp_replace(F.coalesce("guessed", F.lit("")), r"^\s+|\s+$", "")
    number = numbers.short_number(numbers.log10_decode(F.col("log")))
    other = F.coalesce(numbers.short_number(numbers.log10_decode(F.col("guessed_log"))), F.lit(""))
    wrong = F.concat(F.lit("(~~"), guessed, F.lit("~~**"), word, F.lit("**)"))
    right = F.concat(F.lit("(**"), guessed, F.lit("**)"))
    shown = (
        F.when(F.col("special"), "")
        .when(F.col("log").isNotNull(), F.when(F.col("masked"), F.concat(F.lit("(~~"), other, F.lit("~~**"), number, F.lit("**)"))).otherwise(number))
        .when(~F.col("masked") | ~F.col("piece").rlike(r"[\p{L}\p{N}]"), F.col("piece"))
        .otherwise(F.concat(F.regexp_extract("piece", r"^(\s*)", 1), F.when(F.col("guess").eqNullSafe(F.col("token")), right).otherwise(wrong)))
    )
    held = F.array_sort(F.collect_list(F.struct(pos, shown.alias("shown"))))
    return met.groupBy(row).agg(F.array_join(F.transform(held, lambda x: x["shown"]), "").alias("text"))
