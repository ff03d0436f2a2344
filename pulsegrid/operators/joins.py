"""Equi-joins, lookups, consolidation and calendar spines.

No side is forced to be broadcast: Spark compares its size with
``spark.sql.autoBroadcastJoinThreshold`` (from file statistics, or from the
shuffle at run time), and splits a hot key of the larger side otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], seq: str, keep: str = "last") -> DataFrame:
    """One whole row per key: the one with the largest (or smallest) ``seq``.

    An aggregate, not a window: copies are reduced before the shuffle, so a key
    with very many copies costs no more than any other. ``seq`` must be unique
    within a key.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    reduced = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(seq)).alias("__row"))
    return reduced.select(*keys, "__row.*").select(*df.columns)


def consolidate(
    sources: Mapping[str, DataFrame], keys: Sequence[str], prefixed: bool = True
) -> DataFrame:
    """N-way full outer join of sources that are unique per key.

    All sources are stacked with their columns side by side and grouped once:
    one shuffle, where a chain of outer joins takes one per source.
    """
    stacked: DataFrame | None = None
    for name, df in sources.items():
        if prefixed:
            df = df.withColumnsRenamed({c: f"{name}_{c}" for c in df.columns if c not in keys})
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no sources")
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def left_lookup(
    df: DataFrame, other: DataFrame, on: Mapping[str, str] | Sequence[str], unknown: Mapping[str, object] | None = None
) -> DataFrame:
    """Left join on equal or differently named keys; ``unknown`` fills columns of missed rows.

    Key columns of ``other`` are not kept.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    renamed = other.withColumnsRenamed({r: f"__k_{r}" for r in pairs.values()})
    condition = [F.col(left) == F.col(f"__k_{right}") for left, right in pairs.items()]
    joined = df.join(renamed, condition, "left").drop(*[f"__k_{r}" for r in pairs.values()])
    for col, value in (unknown or {}).items():
        joined = joined.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
    return joined


def outer_by_key(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "full_outer")


def normalised_id(c: Column) -> Column:
    """Integer id of a text such as ``007``; NULL if it is none."""
    return F.trim(c.cast("string")).try_cast("bigint")


def matched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` whose normalised id exists in ``right``."""
    return _semi(left, right, left_key, right_key, "left_semi")


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return _semi(left, right, left_key, right_key, "left_anti")


def _semi(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str) -> DataFrame:
    keys = right.select(normalised_id(F.col(right_key)).alias("__id")).distinct()
    return left.join(keys, normalised_id(F.col(left_key)) == F.col("__id"), how)


def missing_dates(df: DataFrame, user: str, day: str) -> DataFrame:
    """Days between the first and last observed day of a user without any row.

    Observed days are reduced to distinct days first, so a user contributes at
    most one row per calendar day. The days of a gap are listed where its two ends
    meet, so only observed days are moved. Days of a NULL user count as not observed.
    """
    one = F.expr("interval 1 day")
    seen = df.where(F.col(day).isNotNull()).select(user, day).distinct()
    ends = seen.withColumn("__next", F.lead(day).over(Window.partitionBy(user).orderBy(day)))
    last = F.col("__next") - one
    gap = F.when(F.col("__next") > F.col(day) + one, F.sequence(F.col(day) + one, last, one))
    unknown = F.sequence(F.col(day), F.coalesce(last, day), one)
    return ends.select(user, F.explode(F.when(F.col(user).isNull(), unknown).otherwise(gap)).alias(day))


def group_mean(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """Mean per key on every row, for ``{column: output}``.

    Aggregate and join back in place of a window: the mean is combined before
    the shuffle and a hot key is not collected in one task.
    """
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(out) for c, out in cols.items()])
    return df.join(means, list(keys), "left")


def attach_per_entity(df: DataFrame, result: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return df.join(result.select(key, *cols), key, "left")
