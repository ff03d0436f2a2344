"""Completeness and coverage reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.encode import feature_name_parts
from pulsegrid.operators.columns import group_of

# Named half-open bands [low, high) of a completeness percentage.
SIX_BANDS = {
    "0-10%": (0, 10),
    "10-25%": (10, 25),
    "25-50%": (25, 50),
    "50-75%": (50, 75),
    "75-90%": (75, 90),
    "90-100%": (90, 100),
}
FIVE_BANDS = {
    "very poor": (None, 10),
    "poor": (10, 20),
    "fair": (20, 50),
    "good": (50, 80),
    "excellent": (80, None),
}
QUALITY_TIERS = {"low": (None, 60), "medium": (60, 80), "high": (80, None)}


def column_completeness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: type, non-null, null, total and percentages.

    One aggregate row over all columns, turned into long form afterwards: the
    input is read once and not multiplied by its columns.
    """
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    counts = df.agg(
        F.count("*").alias("__n"), *[F.count(F.col(c)).alias(f"__c{i}") for i, c in enumerate(cols)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"), F.col(f"__c{i}").alias("non_null"))
            for i, c in enumerate(cols)
        ]
    )
    return (
        counts.select("__n", F.explode(entries).alias("__e"))
        .select("__e.*", F.col("__n").alias("total"))
        .withColumn("null_count", F.col("total") - F.col("non_null"))
        .withColumn("completeness_pct", F.try_divide(F.col("non_null") * 100.0, F.col("total")))
        .withColumn("missing_pct", 100 - F.col("completeness_pct"))
    )


def overall_completeness(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.sum("non_null").alias("non_null"),
        F.sum("total").alias("cells"),
        F.try_divide(F.sum("non_null") * 100.0, F.sum("total")).alias("overall_pct"),
    )


def feature_completeness(
    df: DataFrame, features: Sequence[str], windows: Mapping[str, str] | None = None
) -> DataFrame:
    parts = feature_name_parts(F.col("column_name"), dict(windows or {}))
    return column_completeness(df, features).withColumns(parts)


def variable_summary(features: DataFrame) -> DataFrame:
    """Roll-up of feature completeness per base variable. Features are columns, so this is small."""
    return features.groupBy("base_variable").agg(
        F.avg("completeness_pct").alias("avg_completeness"),
        F.max("completeness_pct").alias("max_completeness"),
        F.min("completeness_pct").alias("min_completeness"),
        F.count("*").alias("statistics_count"),
        F.array_join(F.array_sort(F.collect_set("statistic")), ", ").alias("statistics_types"),
    )


def group_completeness(profile: DataFrame, keywords: Mapping[str, str] | None = None) -> DataFrame:
    """Columns per group (keyword or first name token) with their mean completeness."""
    return profile.groupBy(group_of(F.col("column_name"), dict(keywords or {})).alias("column_group")).agg(
        F.count("*").alias("columns"),
        F.sum("non_null").alias("non_null"),
        F.avg("completeness_pct").alias("avg_completeness"),
    )


def entity_completeness(df: DataFrame, user: str, cols: Sequence[str]) -> DataFrame:
    """Per column over users: totals, users with data, users checked, percentage.

    The first level counts per user with all columns side by side; only its
    result (one row per user) is turned into long form.
    """
    per_user = df.groupBy(user).agg(
        F.count("*").alias("__n"), *[F.count(F.col(c)).alias(c) for c in cols]
    )
    long = per_user.unpivot([F.col(user), F.col("__n")], [F.col(c) for c in cols], "column_name", "__v")
    return (
        long.groupBy("column_name")
        .agg(
            F.sum("__n").alias("total_values"),
            F.sum("__v").alias("non_null_values"),
            F.count_if(F.col("__v") > 0).alias("users_with_data"),
            F.count("*").alias("total_users"),
        )
        .withColumn(
            "completeness_pct",
            F.round(F.try_divide(F.col("non_null_values") * 100.0, F.col("total_values")), 2),
        )
    )


def keep_recommendation(
    report: DataFrame, min_pct: float = 10, user_fraction: float = 0.25
) -> DataFrame:
    """``remove`` below the percentage or below ``int(users * fraction)`` users, else ``keep``."""
    least = F.floor(F.col("total_users") * user_fraction)
    drop = (F.col("completeness_pct") < min_pct) | (F.col("users_with_data") < least)
    return report.withColumn("recommendation", F.when(drop, "remove").otherwise("keep"))


def band_of(pct: Column, bands: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """Name of the half-open band; NULL outside all bands."""
    out = F.lit(None).cast("string")
    for label, (low, high) in reversed(bands.items()):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (pct >= low)
        if high is not None:
            inside = inside & (pct < high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def band_counts(df: DataFrame, pct: str, bands: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows per band, with empty bands at 0."""
    row = df.agg(
        *[F.count_if(band_of(F.col(pct), {b: lim}).isNotNull()).alias(f"__{i}") for i, (b, lim) in enumerate(bands.items())]
    )
    entries = F.array(
        *[F.struct(F.lit(b).alias("band"), F.col(f"__{i}").alias("rows")) for i, b in enumerate(bands)]
    )
    return row.select(F.explode(entries).alias("__e")).select("__e.*")


def variable_presence(df: DataFrame, user: str, cols: Sequence[str]) -> DataFrame:
    """In how many users a variable has any value."""
    return entity_completeness(df, user, cols).select(
        "column_name",
        F.col("users_with_data").alias("users"),
        F.try_divide(F.col("users_with_data") * 100.0, F.col("total_users")).alias("users_pct"),
        F.col("non_null_values").alias("total_non_null"),
    )


def user_coverage(df: DataFrame, user: str, ts: str) -> DataFrame:
    days = F.count_distinct(F.to_date(ts))
    return df.where(F.col(user).isNotNull()).groupBy(user).agg(
        F.count("*").alias("rows"),
        days.alias("distinct_days"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.round(F.try_divide(F.count("*"), days), 1).alias("rows_per_day"),
    )


def extremes(df: DataFrame, user: str, cols: Sequence[str]) -> DataFrame:
    """Mean, std, min, max per column over users, with the users at the extremes (smallest id on ties)."""
    aggs = []
    for i, c in enumerate(cols):
        v, tie = F.col(c), F.col(user)
        aggs += [
            F.avg(v).alias(f"__a{i}"),
            F.stddev_samp(v).alias(f"__s{i}"),
            F.min(v).alias(f"__lo{i}"),
            F.max(v).alias(f"__hi{i}"),
            F.min_by(tie, F.when(v.isNotNull(), F.struct(v, tie))).alias(f"__ul{i}"),
            F.min_by(tie, F.when(v.isNotNull(), F.struct(-v, tie))).alias(f"__uh{i}"),
        ]
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"__a{i}").alias("mean"),
                F.col(f"__s{i}").alias("std"),
                F.col(f"__lo{i}").cast("double").alias("min"),
                F.col(f"__ul{i}").alias("user_at_min"),
                F.col(f"__hi{i}").cast("double").alias("max"),
                F.col(f"__uh{i}").alias("user_at_max"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return df.agg(*aggs).select(F.explode(entries).alias("__e")).select("__e.*")


def join_coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a matched value and their share, per column brought in by a join."""
    return column_completeness(df, cols).select(
        "column_name",
        F.col("non_null").alias("matched_rows"),
        "total",
        F.col("completeness_pct").alias("matched_pct"),
    )


def dataset_summary(df: DataFrame, ts: str, any_of: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows, span, distinct dates, and rows with any of a column set present."""
    return df.agg(
        F.count("*").alias("rows"),
        F.min(ts).alias("span_start"),
        F.max(ts).alias("span_end"),
        F.count_distinct(F.to_date(ts)).alias("unique_dates"),
        *[
            F.count_if(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()).alias(f"{label}_rows_any")
            for label, cols in any_of.items()
        ],
    )


def overview(df: DataFrame, label: str, user: str, features: Sequence[str]) -> DataFrame:
    """One row per dataset: rows, features, users, completeness mean and median, well-filled features."""
    counts = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct(user).alias("users"),
    )
    profile = column_completeness(df, features)
    summary = profile.agg(
        F.count("*").alias("features"),
        F.avg("completeness_pct").alias("avg_completeness"),
        F.median("completeness_pct").alias("median_completeness"),
        F.count_if(F.col("completeness_pct") > 80).alias("features_over_80"),
        F.count_if(F.col("completeness_pct") > 50).alias("features_over_50"),
    )
    # two single rows
    return counts.crossJoin(summary).select(F.lit(label).alias("dataset"), "*")

