"""Imputers, scalers, baselines and class weights that are fitted on one set of rows and applied to others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import features as fx
from pulsegrid.plans.quantile import columns_as_rows, quantile_table


def fit_statistics(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: mean, population std and exact median of the training rows."""
    row = train.agg(
        *[
            f(F.col(c).cast("double")).alias(f"{n}_{i}")
            for i, c in enumerate(cols)
            for n, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )
    stats = columns_as_rows(row, cols, ["mean", "std"], "column_name")
    return stats.join(quantile_table(train, cols, {"median": 0.5}, "column_name"), "column_name", "left")


def _by_column(stats: DataFrame) -> dict[str, dict]:
    """The table has one row per column of the schema."""
    return {row["column_name"]: row.asDict() for row in stats.collect()}


def apply_imputer(df: DataFrame, stats: DataFrame) -> DataFrame:
    fitted = _by_column(stats)
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(s["median"])) for c, s in fitted.items() if c in df.columns}
    )


def apply_scaler(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``(x - mean) / std`` with the fitted population std; a constant column gives 0."""
    fitted = _by_column(stats)
    out = {}
    for c, s in fitted.items():
        if c in df.columns:
            centred = F.col(c).cast("double") - F.lit(s["mean"])
            out[c] = centred / F.lit(s["std"]) if s["std"] else centred
    return df.withColumns(out)


def train_baselines(train: DataFrame, user: str, cols: Mapping[str, str]) -> DataFrame:
    """Mean per user over training rows, for ``{column: baseline name}``."""
    return train.groupBy(user).agg(*[F.avg(c).alias(b) for c, b in cols.items()])


def add_baselines(df: DataFrame, baselines: DataFrame, user: str, cols: Mapping[str, str]) -> DataFrame:
    """Attach baselines; a user without one gets the mean of the user baselines.

    Adds ``<column>_deviation`` and ``<column>_ratio``.
    """
    fallback = baselines.agg(*[F.avg(b).alias(b) for b in cols.values()]).first()
    joined = df.join(baselines, user, "left").withColumns(
        {b: F.coalesce(b, F.lit(fallback[b])) for b in cols.values()}
    )
    derived = {}
    for c, b in cols.items():
        derived[f"{c}_deviation"] = fx.relative_deviation(F.col(c), F.col(b))
        derived[f"{c}_ratio"] = fx.baseline_ratio(F.col(c), F.col(b))
    return joined.withColumns(derived)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (classes * n_class)``, one row per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))
    totals = counts.agg(F.sum("rows").alias("__n"), F.count("*").alias("__k"))
    # one row of totals beside one row per class
    return counts.crossJoin(totals).select(
        label, "rows", (F.col("__n") / (F.col("__k") * F.col("rows"))).alias("weight")
    )


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Every row with the weight of its class; a row without a label keeps its place with a NULL weight."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(weights, label, "left")
