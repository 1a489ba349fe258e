"""Cosines of queries with all vectors, on odd inputs and over several strips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filinglake.operators import vectors as V

SCHEMA = "id long, v array<float>"
ASKS = "id % 20 = 0"


def brute(rows):
    unit = {}
    pairs, cos = 0, []
    for i, v in rows:
        ok = v is not None and len(v) == 3 and None not in v
        x = np.array(v, np.float32).astype(float) if ok else None
        with np.errstate(invalid="ignore"):
            unit.setdefault(i, []).append(x / np.sqrt(x @ x) if ok else None)
    for i, us in unit.items():
        for j, vs in unit.items():
            if i is not None and j is not None and i % 20 == 0 and i != j:
                pairs += len(us) * len(vs)
                cos += [float(u @ v) for u in us for v in vs if u is not None and v is not None]
    return pairs, cos


@pytest.fixture(params=[1 << 16, 7])
def strips(request, monkeypatch):
    monkeypatch.setattr(V, "STRIP", request.param)
    monkeypatch.setattr(V, "TILE", (3, 5) if request.param == 7 else (512, 2048))


ROWS = [(k, [float(k % 7 - 3), float(k % 5), 1.0]) for k in range(100)] + [(20, [0.5, -1.0, 2.0]), (120, None), (121, [1.0, None, 2.0]), (140, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]


def test_histogram_counts_every_pair(spark, strips):
    for rows in (ROWS, [*ROWS, (160, [0.0, 0.0, 0.0])], ROWS[:1], []):
        pairs, cos = brute(rows)
        near = [round(c, 6) for c in cos]
        want = [sum(a <= c < b for c in near) for a, b in zip(V.COSINE_EDGES, V.COSINE_EDGES[1:])]
        assert list(V.cosine_counts(spark.createDataFrame(rows, SCHEMA), "id", "v", 3, F.expr(ASKS)).first()) == [*want, pairs]


def test_figures_of_every_pair(spark, strips):
    for rows in (ROWS, [*ROWS, (160, [0.0, 0.0, 0.0])], ROWS[:1], []):
        pairs, cos = brute(rows)
        got = V.cosine_figures(spark.createDataFrame(rows, SCHEMA), "id", "v", 3, F.expr(ASKS)).first()
        assert got.n == pairs
        if not cos:
            assert list(got)[1:] == [None] * 5
            continue
        near = sorted((round(c, 5) for c in cos), key=lambda c: (math.isnan(c), c))
        want = [np.mean(cos), np.std(cos, ddof=1), np.nanmin(cos), np.max(cos), (near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2]
        assert np.allclose([got["mean"], got["std"], got["min"], got["max"], got["median"]], want, atol=2e-5, equal_nan=True)
