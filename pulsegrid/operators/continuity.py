"""Continuity of daily observations per user: gaps, streaks, summaries.

Everything starts from distinct (user, day) rows, so the windows per user hold
at most one row per calendar day, however many raw rows a user has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.temporal import day_name
from pulsegrid.operators.joins import missing_dates


def _islands(days: DataFrame, user: str, day: str) -> DataFrame:
    """Runs of consecutive days: start, end, length."""
    w = Window.partitionBy(user).orderBy(day)
    return (
        days.withColumn("__run", F.date_sub(day, F.row_number().over(w)))
        .groupBy(user, "__run")
        .agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count("*").alias("days"))
        .drop("__run")
    )


def gaps(df: DataFrame, user: str, day: str) -> DataFrame:
    """Runs of consecutive missing days."""
    return _islands(missing_dates(df, user, day), user, day)


def longest_gaps(df: DataFrame, user: str, day: str, k: int = 10) -> DataFrame:
    """The k longest gaps of each user; earlier ones first on ties."""
    w = Window.partitionBy(user).orderBy(F.col("days").desc(), "start_day")
    return gaps(df, user, day).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def longest_streak(df: DataFrame, user: str, day: str) -> DataFrame:
    """Longest run of consecutive observed days; the first one on ties."""
    runs = _islands(df.where(F.col(day).isNotNull()).select(user, day).distinct(), user, day)
    best = F.max_by(F.struct("days", "start_day", "end_day"), F.struct("days", -F.unix_date("start_day")))
    return runs.groupBy(user).agg(best.alias("__b")).select(user, "__b.*")


def missing_by_weekday(df: DataFrame, user: str, day: str) -> DataFrame:
    return (
        missing_dates(df, user, day)
        .groupBy(F.weekday(day).alias("weekday_no"), day_name(F.col(day)).alias("weekday"))
        .agg(F.count("*").alias("missing_days"))
    )


def completion_band(pct: Column) -> Column:
    return (
        F.when(pct == 100, "PERFECT").when(pct >= 90, "EXCELLENT").when(pct >= 75, "GOOD")
        .when(pct >= 50, "FAIR").otherwise("POOR")
    )


def continuity_summary(df: DataFrame, user: str, day: str) -> DataFrame:
    """One row per user: span, observed and missing days, completion, repeated days, band."""
    per_day = df.where(F.col(day).isNotNull()).groupBy(user, day).agg(F.count("*").alias("__n"))
    total = F.datediff("end_date", "start_date") + 1
    return (
        per_day.groupBy(user)
        .agg(
            F.min(day).alias("start_date"),
            F.max(day).alias("end_date"),
            F.count("*").alias("days_with_responses"),
            F.count_if(F.col("__n") > 1).alias("days_with_multiple_responses"),
            F.max("__n").alias("max_responses_per_day"),
        )
        .withColumn("total_days", total)
        .withColumn("missing_days", F.col("total_days") - F.col("days_with_responses"))
        .withColumn("completion_rate", F.col("days_with_responses") / F.col("total_days") * 100)
        .withColumn("band", completion_band(F.col("completion_rate")))
    )
