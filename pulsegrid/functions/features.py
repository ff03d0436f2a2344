"""Row-level feature formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_deviation(x: Column, baseline: Column) -> Column:
    return F.try_divide(x - baseline, baseline + 1e-6)


def baseline_ratio(x: Column, baseline: Column) -> Column:
    return F.try_divide(x, baseline + 1)


def baseline_difference(x: Column, baseline: Column) -> Column:
    return x - baseline


def proximity(days: Column, clip_at: int | None = None, missing: int = 365) -> Column:
    """``1 / (days + 1)``; no date counts as ``missing`` days away. The window variant clips first."""
    d = F.coalesce(days, F.lit(missing))
    if clip_at is not None:
        d = F.greatest(d, F.lit(clip_at))
    return F.try_divide(F.lit(1.0), d + 1)


def interaction(a: Column, b: Column) -> Column:
    return a * b


def composites(c: dict[str, Column]) -> dict[str, Column]:
    """Composite day features.

    ``c`` gives the columns efficiency, deep, rem, duration, steps, sedentary,
    rmssd, heart_rate, wakes, spo2 and breathing.
    """
    return {
        "sleep_quality": F.try_divide(c["efficiency"] * c["deep"], c["duration"] + 1),
        "activity_intensity": F.try_divide(c["steps"], c["sedentary"] + 1),
        "autonomic_balance": F.try_divide(c["rmssd"], c["heart_rate"] + 1),
        "recovery_score": F.try_divide(c["rem"] + c["deep"], c["duration"] + 1),
        "cardio_stress": F.try_divide(c["heart_rate"], c["rmssd"] + 1),
        "sleep_fragmentation": F.try_divide(c["wakes"], c["duration"] / 60 + 1),
        "resp_efficiency": F.try_divide(c["spo2"], c["breathing"] + 1),
    }
