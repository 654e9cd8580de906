"""Exact quantiles without sorting everything: a sketch bounds the value, and only what lies inside is looked at."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative rank error of the sketch, and distinct values that the driver may look at.
ERROR, FEW = 0.001, 10_000


def nearest_rank(df: DataFrame, column: str, quantile: float, error: float = ERROR, few: int = FEW) -> float | None:
    """The least value of ``column`` that ``quantile`` of its rows do not exceed, as ``percentile_disc`` has it.

    A sketch of fixed size gives two values between which it must lie; one pass counts what is below them and the
    distinct values inside. While those are too many, the inside is treated the same way. Nulls do not count, NaN is the
    largest value; without rows there is none.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    n, nan = values.agg(F.count(F.lit(1)), F.count_if(F.isnan("v"))).first()
    if not n:
        return None
    rank = max(1, math.ceil(round(quantile * n, 9)))
    if rank > n - nan:
        return math.nan
    inside = values.where(~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total, plain = n - nan, values.where(~F.isnan("v"))
    while True:
        around = rank / total
        low, high = plain.approxQuantile("v", [max(0.0, around - 2 * error), min(1.0, around + 2 * error)], error)
        within = F.col("v").between(low, high)
        below, kinds, held = inside.agg(
            F.sum(F.when(F.col("v") < low, F.col("n"))), F.count_if(within), F.sum(F.when(within, F.col("n")))
        ).first()
        rank -= below or 0
        inside, plain = inside.where(within), plain.where(within)
        if kinds <= few or held == total:
            break
        total = held
    if kinds <= few:
        for v, times in inside.orderBy("v").collect():
            rank -= times
            if rank <= 0:
                return v
    return plain.orderBy("v").offset(rank - 1).first()["v"]
