"""Column transforms whose parameters are fitted on data: statistics first, then row expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.quantile import column_quantiles


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness (G1) over non-null values; NULL below three values or without spread."""
    n = F.count(c)
    spread = F.stddev_pop(c)
    # third moment by hand: skewness() of a constant column is NaN
    return F.when(
        (n > 2) & (spread > 0),
        F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.nullif(n - F.lit(2), F.lit(0)),
    )


def skew_profile(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Skewness and minimum of each column."""
    row = df.agg(
        *[sample_skewness(F.col(c)).alias(f"__s{i}") for i, c in enumerate(cols)],
        *[F.min(c).alias(f"__m{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: (row[f"__s{i}"], row[f"__m{i}"]) for i, c in enumerate(cols)}


def add_log_columns(
    df: DataFrame, cols: Sequence[str], exclude: Sequence[str] = (), min_skew: float = 1.0
) -> DataFrame:
    """``<c>_log = log1p(c)`` for skewed columns without negative values."""
    cols = [c for c in cols if c not in set(exclude)]
    profile = skew_profile(df, cols)
    chosen = [
        c for c, (skew, low) in profile.items()
        if skew is not None and abs(skew) > min_skew and low is not None and low >= 0
    ]
    return df.withColumns({f"{c}_log": F.log1p(c) for c in chosen})


def impute_median(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """NULL becomes the exact median of ``fit_on`` (default: the same rows)."""
    q = column_quantiles(df if fit_on is None else fit_on, cols, {"m": 0.5})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(q[c]["m"])) for c in cols})


def winsorise(df: DataFrame, cols: Sequence[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    q = column_quantiles(df, cols, {"lo": low, "hi": high})
    # least/greatest skip NULL, so a missing value is kept missing explicitly
    return df.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(q[c]["lo"])), F.lit(q[c]["hi"])))
            for c in cols
        }
    )


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column."""
    row = df.agg(
        *[F.avg(c).alias(f"__a{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"__s{i}") for i, c in enumerate(cols)],
    ).first()
    return {c: (row[f"__a{i}"], row[f"__s{i}"]) for i, c in enumerate(cols)}


def zscore(
    df: DataFrame, cols: Sequence[str], suffix: str = "_z", fit_on: DataFrame | None = None
) -> DataFrame:
    """Standard score with the population standard deviation; a constant column gives 0."""
    fitted = moments(df if fit_on is None else fit_on, cols)
    out = {}
    for c, (mean, std) in fitted.items():
        z = (F.col(c) - F.lit(mean)) / F.lit(std) if std else F.when(F.col(c).isNotNull(), F.lit(0.0))
        out[f"{c}{suffix}"] = z
    return df.withColumns(out)


def tercile_cuts(df: DataFrame, col: str, low: float = 1 / 3, high: float = 2 / 3) -> tuple[float, float]:
    q = column_quantiles(df, [col], {"lo": low, "hi": high})[col]
    if q["lo"] is None or q["lo"] == q["hi"]:
        raise ValueError(f"{col}: cut points {q['lo']} and {q['hi']} do not separate three classes")
    return q["lo"], q["hi"]


def three_classes(c: Column, cuts: tuple[float, float]) -> Column:
    """0 up to the lower cut, 1 up to the upper cut, 2 above."""
    return F.when(c <= cuts[0], 0).when(c <= cuts[1], 1).when(c > cuts[1], 2)


def binary_drop_middle(df: DataFrame, col: str, label: str, cuts: tuple[float, float], strict: bool) -> DataFrame:
    """Low / high rows only.

    ``strict=True`` drops rows on a cut. ``strict=False`` keeps them, and labels
    1 only what is above the upper cut, so a row equal to it gets 0.
    """
    c = F.col(col)
    keep = (c < cuts[0]) | (c > cuts[1]) if strict else (c <= cuts[0]) | (c >= cuts[1])
    return df.where(keep).withColumn(label, (c > cuts[1]).cast("int"))


def binary_at_median(df: DataFrame, col: str, label: str) -> DataFrame:
    m = column_quantiles(df, [col], {"m": 0.5})[col]["m"]
    return df.withColumn(label, (F.col(col) >= F.lit(m)).cast("int"))
