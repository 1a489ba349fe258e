"""Python functions of single values over Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 128  # rows that are Python objects at a time


def each(f: Callable, kind: T.DataType, of_null: object = None) -> Callable:
    """Column function: ``f`` of the values of a row, ``of_null`` where one is null.

    A batch stays in Arrow's compact form and its results leave piece by piece; only ``ROWS`` rows and their results are Python
    objects at a time, so that a worker's memory goes by the bytes of a batch, which Spark bounds, not by the objects made of them.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    made = to_arrow_type(kind)

    def pieces(columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
        for at in range(0, max(1, len(columns[0])), ROWS):
            rows = zip(*(c.slice(at, ROWS).to_pylist() for c in columns))
            yield pa.array([of_null if None in row else f(*row) for row in rows], made)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield from pieces((column,))

    def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield from pieces(columns)

    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else more, kind)(*columns)
