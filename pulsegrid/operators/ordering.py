"""Sorting and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_rows(df: DataFrame, *by: str) -> DataFrame:
    """``-name`` sorts descending. NULLs go last either way."""
    order = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in by]
    return df.orderBy(*order)


def top_k(df: DataFrame, k: int, *by: str) -> DataFrame:
    """First k rows of the order; each task keeps k rows, then k are merged."""
    return sort_rows(df, *by).limit(k)


def sort_by_weekday(df: DataFrame, day_name_col: str) -> DataFrame:
    """Monday to Sunday."""
    # Weekday order.
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    return df.orderBy(F.array_position(F.array(*[F.lit(d) for d in days]), F.col(day_name_col)))


def sort_by_abs(df: DataFrame, col: str, *ties: str) -> DataFrame:
    return df.orderBy(F.abs(col).desc(), *ties)


def best_row(df: DataFrame, metric: str, ties: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Row with the largest metric (per key); smallest tie columns win."""
    ordering = F.struct((-F.col(metric)).alias("__m"), *ties)
    rest = [c for c in df.columns if c not in keys]
    data = df.where(F.col(metric).isNotNull())
    return (
        data.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("__b"))
        .select(*keys, "__b.*").select(*df.columns)
    )
