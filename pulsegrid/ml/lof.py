"""Local outlier factor and k-distances on exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.ml.anomaly import flag_lowest
from pulsegrid.operators.sets import union_all
from pulsegrid.plans.knn import fold_points, nearest, weighted_neighbours
from pulsegrid.plans.quantile import column_quantiles
from pulsegrid.session import freeze


def _scores(points: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``(uid, score)`` with score = -LOF, from the neighbour table of at least k neighbours."""
    # read for the distances, the densities and their means
    near = freeze(weighted_neighbours(points, found, k))
    k_distance = near.groupBy("uid").agg(F.max("dist").alias("kd"))
    reach = near.join(k_distance.select(F.col("uid").alias("v"), "kd"), "v").withColumn(
        "reach", F.greatest("kd", "dist")
    )
    density = reach.groupBy("uid").agg(
        (1.0 / (F.sum(F.col("reach") * F.col("w")) / F.sum("w") + 1e-10)).alias("lrd")
    )
    around = near.join(density.select(F.col("uid").alias("v"), F.col("lrd").alias("lrd_v")), "v")
    mean = around.groupBy("uid").agg((F.sum(F.col("lrd_v") * F.col("w")) / F.sum("w")).alias("mean_lrd"))
    return mean.join(density, "uid").select("uid", (-F.col("mean_lrd") / F.col("lrd")).alias("score"))


def _points(df: DataFrame, row_id: str, features: Sequence[str]) -> DataFrame:
    """The points of the rows that have all features."""
    return freeze(fold_points(df.dropna(subset=list(features)), row_id, features))


def _attach(df: DataFrame, features: Sequence[str], points: DataFrame, values: DataFrame) -> DataFrame:
    """Values per point back to all rows at the point; a row without a point has NULL."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    named = points.select("uid", "x").join(values, "uid").drop("uid").withColumnRenamed("x", "__x")
    return df.withColumn("__x", x).join(named, "__x", "left").drop("__x")


def local_outlier_factor(
    df: DataFrame, row_id: str, features: Sequence[str], k: int = 20, contamination: float = 0.1
) -> DataFrame:
    """Adds ``score`` (-LOF), ``is_anomaly`` and ``anomaly``. Features are expected scaled.

    A row with a NULL or NaN feature takes no part and has NULL in all three.
    """
    points = _points(df, row_id, features)
    scores = freeze(_scores(points, nearest(points, k), k))
    return flag_lowest(_attach(df, features, points, scores), "score", contamination)


def lof_sweep(
    df: DataFrame, row_id: str, features: Sequence[str], ks: Sequence[int] = (5, 10, 20, 30, 50), contamination: float = 0.1
) -> DataFrame:
    """Anomalies and mean scores for several k. The neighbours are searched once, for the largest."""
    points = _points(df, row_id, features)
    found = nearest(points, max(ks))
    rows = []
    for k in ks:
        scored = freeze(_attach(df, features, points, _scores(points, found, k)).select("score"))
        flagged = flag_lowest(scored, "score", contamination)
        rows.append(
            flagged.agg(
                F.lit(k).alias("k"),
                F.sum("is_anomaly").alias("anomalies"),
                (F.avg("is_anomaly") * 100).alias("rate_pct"),
                F.avg(F.when(F.col("is_anomaly") == 0, F.col("score"))).alias("mean_normal"),
                F.avg(F.when(F.col("is_anomaly") == 1, F.col("score"))).alias("mean_anomaly"),
            )
        )
    return union_all(*rows)


def k_distances(df: DataFrame, row_id: str, features: Sequence[str], k: int) -> DataFrame:
    """Distance of each row to its k-th neighbour, the row itself being the first."""
    points = _points(df, row_id, features)
    near = weighted_neighbours(points, nearest(points, k), k, count_self=True)
    kd = freeze(near.groupBy("uid").agg(F.max("dist").alias("k_distance")))
    return _attach(df, features, points, kd)


def suggested_eps(df: DataFrame, row_id: str, features: Sequence[str], k: int, share: float = 0.90) -> float:
    """Percentile of the k-distances."""
    kd = k_distances(df, row_id, features, k).select("k_distance")
    return column_quantiles(kd, ["k_distance"], {"q": share})["k_distance"]["q"]
