"""Reduction of series to one row per user and day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statistics per metric family, by substring of the column name.
FAMILY_STATS = {
    "beats per minute": ("mean", "std", "min", "max"),
    "rmssd": ("mean", "std", "min", "max"),
    "low_frequency": ("mean", "std"),
    "high_frequency": ("mean", "std"),
    "respiratory": ("mean", "std"),
    "breathing": ("mean", "std"),
    "spo2": ("mean", "std", "min"),
    "steps": ("total",),
    "active_minutes": ("total",),
}

_STATS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    # the sum of no values is 0
    "total": lambda c: F.coalesce(F.sum(c), F.lit(0)),
}


def plan_statistics(
    columns: Sequence[str], families: Mapping[str, Sequence[str]] = FAMILY_STATS
) -> dict[str, tuple[str, ...]]:
    """Statistics of each column: those of the first family whose substring it contains."""
    plan = {}
    for c in columns:
        for word, stats in families.items():
            if word in c.lower() and "standard_deviation" not in c.lower():
                plan[c] = tuple(stats)
                break
    return plan


def daily_stats(
    df: DataFrame, keys: Sequence[str], plan: Mapping[str, Sequence[str]]
) -> DataFrame:
    """``<column>_<statistic>`` per key, in one aggregation."""
    aggs = [_STATS[s](F.col(c)).alias(f"{c}_{s}") for c, stats in plan.items() for s in stats]
    return df.groupBy(*keys).agg(*aggs)


def daily_total(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return daily_stats(df, keys, {c: ("total",) for c in cols})


def daily_counter(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Last reading of a cumulative counter."""
    return df.groupBy(*keys).agg(F.max(col).alias(out))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Row ratio; a zero denominator gives NULL (the infinite value is not kept)."""
    return F.try_divide(numerator, denominator)


def ratio_stats(df: DataFrame, keys: Sequence[str], num: str, den: str, out: str) -> DataFrame:
    r = ratio(F.col(num), F.col(den))
    return df.groupBy(*keys).agg(F.avg(r).alias(f"{out}_mean"), F.stddev_samp(r).alias(f"{out}_std"))


def level_counts(
    df: DataFrame, keys: Sequence[str], col: str, levels: Sequence[str], prefix: str = "activity_level_"
) -> DataFrame:
    """One count column per level, 0 where absent.

    The levels are declared, so the counts are plain conditional aggregates in
    one pass and no job is needed to find them.
    """
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(col) == v).alias(f"{prefix}{v.lower()}_count") for v in levels]
    )
