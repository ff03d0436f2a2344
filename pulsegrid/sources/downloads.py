"""Consolidation of device exports: ``base/<user>/<download>/<folder>/<files>`` to one wide series.

One scan per file pattern covers all users and downloads; user and download are
taken from the path, so the plan does not grow with the number of users.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.joins import consolidate, keep_one
from pulsegrid.sources.files import SOURCE_PATTERNS, read_source

# Folders of an export, the sources in them, and the names of a step count column.
FOLDERS = {
    "Global Export Data": ("oxygen_variation", "heart_rate_global", "sleep_global"),
    "Heart Rate Variability": (
        "daily_hrv_summary",
        "daily_respiratory_rate",
        "hrv_details",
        "respiratory_rate_summary",
    ),
    "Oxygen Saturation (SpO2)": ("daily_spo2", "minute_spo2"),
    "Physical Activity_GoogleData": (
        "active_minutes",
        "activity_level",
        "heart_rate_activity",
        "hrv_activity",
        "spo2_activity",
        "steps",
    ),
    "Sleep Score": ("sleep_score",),
    "Stress Score": ("stress_score",),
}
STEP_NAMES = ("steps", "step_count", "value", "count")

KEYS = ["user", "download", "timestamp"]


def daily_steps(steps: DataFrame) -> DataFrame | None:
    """Step total per day, at midnight; text that is no number counts nothing."""
    col = next((c for c in steps.columns if c.lower() in STEP_NAMES), None)
    if col is None:
        return None
    day = F.to_date("timestamp").cast("timestamp_ntz")
    total = F.coalesce(F.sum(F.col(f"`{col}`").try_cast("double")), F.lit(0.0))
    return steps.groupBy("user", "download", day.alias("timestamp")).agg(total.alias("total_steps"))


def consolidate_downloads(
    spark: SparkSession, base: str, folders: Mapping[str, tuple[str, ...]] = FOLDERS
) -> DataFrame | None:
    """``user, timestamp, <source>_<column> ..., daily_total_steps``, unique per user and timestamp.

    Within a download the last row of a source wins per timestamp and the sources
    are put side by side. Between downloads one whole row is kept, that of the
    last download by name.
    """
    pattern_of = {source: pattern for pattern, source in SOURCE_PATTERNS.items()}
    sources: dict[str, DataFrame] = {}
    for folder, names in folders.items():
        for name in names:
            df = read_source(
                spark, f"{base.rstrip('/')}/*/*/{folder}", pattern_of[name], name, path_levels={"user": -4, "download": -3}
            )
            if df is None:
                continue
            df = df.where(F.col("timestamp").isNotNull())
            if name == "steps":
                steps = daily_steps(df)
                if steps is not None:
                    sources["daily"] = steps
                continue
            sources[name] = keep_one(df.drop("source"), KEYS, "row_seq").drop("row_seq")
    if not sources:
        return None
    merged = consolidate(sources, KEYS)
    return keep_one(merged, ["user", "timestamp"], "download").drop("download")
