"""Column selection, renaming and row filters. Column lists come from the schema, so no job runs,
except where a rule depends on the data (completeness, midnight-only columns)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import date, time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.temporal import is_midnight, seconds_of_day

# Statistic suffixes of feature columns, in the order they are tried.
STAT_SUFFIXES = ("_mean", "_std", "_min", "_max", "_median", "_count")


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; found {df.columns}")
    return df


def first_matching(columns: Sequence[str], patterns: Sequence[str]) -> str | None:
    """First column, in column order, that matches any of the patterns."""
    return next((c for c in columns if any(re.search(p, c, re.IGNORECASE) for p in patterns)), None)


def detect_column(columns: Sequence[str], names: Sequence[str], substrings: Sequence[str]) -> str | None:
    """A column by exact candidate name, else the first that contains a substring."""
    lowered = {c.lower(): c for c in reversed(columns)}
    for name in names:
        if name.lower() in lowered:
            return lowered[name.lower()]
    return next((c for c in columns if any(s in c.lower() for s in substrings)), None)


def drop_present(df: DataFrame, names: Iterable[str] = (), containing: Iterable[str] = ()) -> DataFrame:
    """Drop the listed columns that exist and all columns whose name contains a substring."""
    names, subs = set(names), [s.lower() for s in containing]
    return df.drop(*[c for c in df.columns if c in names or any(s in c.lower() for s in subs)])


def exclude_keys(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    return df.where(F.col(key).isNull() | ~F.col(key).isin(list(values)))


def drop_null_rows(df: DataFrame, subset: Sequence[str], how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(subset))


def sentinel_to_null(df: DataFrame, col: str, sentinel: float = 50.0) -> DataFrame:
    """An error code of the device becomes NULL, so that aggregates skip it."""
    return df.withColumn(col, F.nullif(F.col(col), F.lit(sentinel)))


def schedule_filter(
    df: DataFrame,
    ts: str,
    first_day: date,
    last_day: date,
    weekdays: Sequence[int],
    start: time,
    end: time,
    end_inclusive: bool = False,
) -> DataFrame:
    """Rows inside a recurring slot: date range, weekdays (Monday = 0) and time of day."""
    def seconds(t: time) -> float:
        return t.hour * 3600 + t.minute * 60 + t.second + t.microsecond / 1e6

    day, sod = F.to_date(ts), seconds_of_day(F.col(ts))
    before_end = sod <= seconds(end) if end_inclusive else sod < seconds(end)
    return df.where(
        day.between(F.lit(first_day), F.lit(last_day))
        & F.weekday(day).isin(list(weekdays))
        & (sod >= seconds(start))
        & before_end
    )


def completeness(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Percentage of non-null values per column; one aggregation for all columns."""
    row = df.agg(
        F.count("*").alias("__n"), *[F.count(F.col(c)).alias(f"__{i}") for i, c in enumerate(cols)]
    ).first()
    n = row["__n"]
    return {c: 100.0 * row[f"__{i}"] / n if n else 0.0 for i, c in enumerate(cols)}


def keep_complete(
    df: DataFrame, min_pct: float, candidates: Sequence[str] | None = None
) -> DataFrame:
    """Drop candidate columns (default all) filled in less than ``min_pct`` percent of the rows."""
    candidates = df.columns if candidates is None else list(candidates)
    pct = completeness(df, candidates)
    return df.select(*[c for c in df.columns if c not in pct or pct[c] >= min_pct])


def midnight_profile(df: DataFrame, ts: str) -> tuple[list[str], list[str]]:
    """Columns whose values all sit at 00:00:00, and the other non-empty columns."""
    cols = [c for c in df.columns if c != ts]
    at_midnight = is_midnight(F.col(ts))
    row = df.agg(
        *[F.count(F.col(c)).alias(f"__n{i}") for i, c in enumerate(cols)],
        *[F.count(F.when(at_midnight, F.col(c))).alias(f"__m{i}") for i, c in enumerate(cols)],
    ).first()
    daily = [c for i, c in enumerate(cols) if row[f"__n{i}"] and row[f"__n{i}"] == row[f"__m{i}"]]
    series = [c for i, c in enumerate(cols) if row[f"__n{i}"] and row[f"__n{i}"] != row[f"__m{i}"]]
    return daily, series


def split_daily(
    df: DataFrame, ts: str, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Split a wide series into midnight-only daily records and the time series.

    Rows with none of a side's values are left out of that side; columns with
    no value at all are left out of both.
    """
    daily, series = midnight_profile(df.drop(*keys), ts)

    def side(cols: list[str]) -> DataFrame:
        part = df.select(*keys, ts, *cols)
        return part.dropna(how="all", subset=cols) if cols else part.limit(0)

    return side(daily).where(is_midnight(F.col(ts))), side(series)


def prefix_columns(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    keep = set(keep)
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def column_roles(
    df: DataFrame, metadata: Iterable[str], target_prefix: str = "q_"
) -> dict[str, list[str]]:
    """Metadata / target / feature columns by name; other columns have no role."""
    meta = set(metadata)
    roles: dict[str, list[str]] = {"metadata": [], "target": [], "feature": []}
    for c in df.columns:
        if c in meta:
            roles["metadata"].append(c)
        elif c.startswith(target_prefix):
            roles["target"].append(c)
        elif c.endswith(STAT_SUFFIXES):
            roles["feature"].append(c)
    return roles


def numeric_features(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    drop = set(exclude)
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in drop
    ]


def group_of(name: Column, keywords: dict[str, str] | None = None) -> Column:
    """Group of a column name: first keyword it contains, else its first ``_`` token."""
    token = F.split(name, "_")[0]
    if not keywords:
        return token
    hit = F.lit(None).cast("string")
    for word, group in reversed(keywords.items()):
        hit = F.when(F.lower(name).contains(word.lower()), F.lit(group)).otherwise(hit)
    return F.coalesce(hit, token)


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Listed columns first, the rest in their order; duplicate names keep the first column."""
    wanted = [c for c in first if c in df.columns]
    order = list(dict.fromkeys([*wanted, *df.columns]))
    if len(set(df.columns)) != len(df.columns):
        unique = [c if c not in df.columns[:i] else f"__dup{i}" for i, c in enumerate(df.columns)]
        df = df.toDF(*unique)
    return df.select(*order)


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without quotes and surrounding blanks."""
    return df.toDF(*[c.replace('"', "").replace("'", "").strip() for c in df.columns])
