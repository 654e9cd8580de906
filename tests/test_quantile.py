"""Quantiles by a sketch against sorting."""

from __future__ import annotations

import math
import random

import pytest

from headwater.functions.quantile import nearest_rank


def made(kind: str) -> list[float | None]:
    rng = random.Random(kind)
    return {
        "none": [],
        "nulls": [None, None],
        "one": [3.5],
        "ten": [float(i) for i in range(1, 11)],
        "ties": [1.0] * 700 + [2.0] * 200 + [3.0] * 100,
        "equal": [7.25] * 500,
        "many": [rng.gauss(0, 1) for _ in range(5000)],
        "skewed": [rng.paretovariate(0.3) for _ in range(3000)] + [float("inf")] * 5 + [-0.0, 0.0, None],
        "nan": [1.0, 2.0, math.nan, math.nan, 5.0, math.nan],
    }[kind]


@pytest.mark.parametrize("kind", ["none", "nulls", "one", "ten", "ties", "equal", "many", "skewed", "nan"])
@pytest.mark.parametrize("few", [10_000, 3])
def test_equals_the_sorted_place(spark, kind, few):
    rows = made(kind)
    df = spark.createDataFrame([(v,) for v in rows], "s double").repartition(5)
    held = sorted((v for v in rows if v is not None), key=lambda v: (math.isnan(v), v))
    for q in (0.0, 0.001, 0.37, 0.5, 0.9, 0.999, 1.0):
        got = nearest_rank(df, "s", q, error=0.01, few=few)
        want = held[max(1, math.ceil(round(q * len(held), 9))) - 1] if held else None
        assert got == want or (want is not None and math.isnan(got) and math.isnan(want)), q
        if held and few > 3 and q in (0.37, 0.9):
            exact = df.selectExpr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY s)").first()[0]
            assert got == exact or (math.isnan(got) and math.isnan(exact))
