"""Principal components of standardised features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.transforms import zscore
from pulsegrid.ml.classify import VECTOR, assemble


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector of population z-scores. They have mean 0, which the projection relies on."""
    z = zscore(df, features, "__z")
    return assemble(z, [f"{c}__z" for c in features]).drop(*[f"{c}__z" for c in features])


def fit_pca(df: DataFrame, k: int):
    return PCA(k=k, inputCol=VECTOR, outputCol="__pca").fit(df)


def components_for(df: DataFrame, features: Sequence[str], share: float = 0.80) -> tuple[object, int, DataFrame]:
    """Model with all components, the least number that reaches the variance share, and the
    variance table (one row per component)."""
    model = fit_pca(df, len(features))
    rows, total, needed = [], 0.0, None
    for i, v in enumerate(model.explainedVariance.toArray(), 1):
        total += float(v)
        if needed is None and total >= share:
            needed = i
        rows.append((i, float(v), total, needed is None or needed == i))
    table = df.sparkSession.createDataFrame(rows, "component int, variance_share double, cumulative double, kept boolean")
    return model, needed or len(features), table


def project(model, df: DataFrame, k: int, prefix: str = "pc") -> DataFrame:
    """The first k coordinates as columns ``pc1..pck``; their signs are free."""
    coordinates = vector_to_array("__pca")
    out = model.transform(df).withColumn("__c", coordinates)
    return out.withColumns({f"{prefix}{i + 1}": F.col("__c")[i] for i in range(k)}).drop("__pca", "__c")
