"""Reading of anomaly scores: threshold, explanation, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.stats import cohen_d
from pulsegrid.plans.gram import correlations
from pulsegrid.plans.quantile import column_quantiles


def flag_lowest(df: DataFrame, score: str, contamination: float = 0.1) -> DataFrame:
    """``is_anomaly`` = 1 and ``anomaly`` = -1 for scores below the contamination quantile."""
    cut = column_quantiles(df, [score], {"q": contamination})[score]["q"]
    low = (F.col(score) < F.lit(cut)).cast("int")
    return df.withColumns({"is_anomaly": low, "anomaly": 1 - 2 * low})


def score_importance(df: DataFrame, score: str, features: Sequence[str], k: int = 20) -> DataFrame:
    """Absolute correlation of each feature with the score, top k."""
    pairs = correlations(df, [score], features)
    return (
        pairs.select(F.col("var_b").alias("feature"), F.abs("r").alias("importance"))
        .orderBy(F.col("importance").desc_nulls_last(), "feature")
        .limit(k)
    )


def anomaly_summary(df: DataFrame, targets: Sequence[str], flag: str, by: Sequence[str]) -> DataFrame:
    """Rows, anomalies, share, target means of both sides and their effect size, per dataset."""
    normal, anomaly = F.col(flag) == 0, F.col(flag) == 1
    aggs = [
        F.count("*").alias("n"),
        F.count_if(anomaly).alias("anomalies"),
        F.try_divide(F.count_if(anomaly) * 100.0, F.count("*")).alias("anomaly_pct"),
    ]
    for t in targets:
        aggs += [
            F.avg(F.when(normal, F.col(t))).alias(f"{t}_normal"),
            F.avg(F.when(anomaly, F.col(t))).alias(f"{t}_anomaly"),
            cohen_d(F.col(t), normal, anomaly).alias(f"{t}_d"),
        ]
    return df.groupBy(*by).agg(*aggs)
