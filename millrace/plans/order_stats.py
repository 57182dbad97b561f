"""Exact order statistics of many columns at once.

``percentile`` and ``median`` gather every distinct value of a column in one task. Here a value at an exact rank is
found by narrowing: each pass counts the values of an interval in evenly spaced bins (an aggregation that reduces to at
most ``BINS`` rows per interval before the shuffle), keeps the bin that holds the wanted rank, and continues inside the
smallest and largest value seen there. Two or three passes settle most columns; passes alternate between linear and
logarithmic spacing, so widely spread values do not need many more. All columns and ranks share each pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 2048
_HUGE = 1.7e308


@dataclass
class _Interval:
    column: str
    low: float
    high: float
    before: int
    ranks: list[int] = field(default_factory=list)


def _spread(x: float, log: bool) -> float:
    x = min(max(x, -_HUGE), _HUGE)
    return math.copysign(math.log1p(abs(x)), x) if log else x / 4


def _bin(value: Column, iv: _Interval, log: bool) -> Column:
    clamped = F.least(F.greatest(value, F.lit(-_HUGE)), F.lit(_HUGE))
    scaled = F.signum(clamped) * F.log1p(F.abs(clamped)) if log else clamped / 4
    low, high = _spread(iv.low, log), _spread(iv.high, log)
    if high <= low:
        return F.when(value == F.lit(iv.low), 0).otherwise(1)
    at = F.floor((scaled - F.lit(low)) / F.lit(high - low) * F.lit(float(BINS)))
    return F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).cast("int")


def values_at_ranks(
    df: DataFrame, ranks: dict[str, list[int]], extent: dict[str, tuple[float, float]]
) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks among the non-null, non-NaN values of numeric columns, as doubles.

    ``extent`` holds each column's smallest and largest such value.
    """
    found: dict[tuple[str, int], float] = {}
    active = [_Interval(c, *extent[c], 0, sorted(set(r))) for c, r in ranks.items() if r]
    log = False
    while True:
        for iv in active:
            if iv.low == iv.high:
                found.update({(iv.column, r): iv.low for r in iv.ranks})
        active = [iv for iv in active if iv.low != iv.high]
        if not active:
            return found
        active = _narrow(df, active, log)
        log = not log


def _narrow(df: DataFrame, intervals: list[_Interval], log: bool) -> list[_Interval]:
    value = {iv.column: F.col(iv.column).cast("double") for iv in intervals}
    inside = [(value[iv.column] >= iv.low) & (value[iv.column] <= iv.high) for iv in intervals]
    keep = inside[0]
    for condition in inside[1:]:
        keep = keep | condition
    entries = [
        F.struct(
            F.lit(i).alias("interval"),
            F.when(inside[i], _bin(value[iv.column], iv, log)).alias("bin"),
            value[iv.column].alias("value"),
        )
        for i, iv in enumerate(intervals)
    ]
    histogram = (
        df.select(*dict.fromkeys(iv.column for iv in intervals))
        .filter(keep)
        .select(F.inline(F.array(*entries)))
        .filter(F.col("bin").isNotNull())
        .groupBy("interval", "bin")
        .agg(F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    below = Window.partitionBy("interval").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # <= BINS rows
    wanted = F.array(*[F.array(*[F.lit(r - iv.before).cast("long") for r in iv.ranks]) for iv in intervals])
    hits = (
        histogram.withColumn("before", F.coalesce(F.sum("rows").over(below), F.lit(0)))
        .withColumn(
            "hit",
            F.filter(
                F.get(wanted, F.col("interval")),
                lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("rows")),
            ),
        )
        .filter(F.size("hit") > 0)
        .select("interval", "before", "low", "high", "hit")
        .collect()  # at most one row per wanted rank
    )
    return [
        _Interval(
            intervals[h["interval"]].column,
            h["low"],
            h["high"],
            intervals[h["interval"]].before + h["before"],
            [r + intervals[h["interval"]].before for r in h["hit"]],
        )
        for h in hits
    ]


def nearest_rank(count: int, p: float) -> int:
    """Rank of a quantile with nearest interpolation, halves away from zero."""
    return math.floor((count - 1) * p + 0.5)


def quartiles_and_median(
    df: DataFrame, counts: dict[str, int], extent: dict[str, tuple[float, float]]
) -> dict[str, tuple[float, float, float]]:
    """(q1, median, q3) per column: nearest quartiles, and the median as the mean of the two middle values."""
    ranks = {
        c: [nearest_rank(n, 0.25), (n - 1) // 2, n // 2, nearest_rank(n, 0.75)] for c, n in counts.items() if n > 0
    }
    at = values_at_ranks(df, ranks, extent)
    result = {}
    for c, (q1, m1, m2, q3) in ranks.items():
        low, high = at[c, m1], at[c, m2]
        median = low if m1 == m2 else low + (high - low) / 2 if math.isinf(low + high) else (low + high) / 2
        result[c] = (at[c, q1], median, at[c, q3])
    return result


def medians(
    df: DataFrame, counts: dict[str, int], extent: dict[str, tuple[float, float]]
) -> dict[str, float]:
    ranks = {c: [(n - 1) // 2, n // 2] for c, n in counts.items() if n > 0}
    at = values_at_ranks(df, ranks, extent)
    return {c: at[c, r[0]] if r[0] == r[1] else (at[c, r[0]] + at[c, r[1]]) / 2 for c, r in ranks.items()}
