"""Classifiers on Spark ML with class probabilities, soft voting, comparison and importances."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.ml.metrics import confusion_matrix, regression_metrics, summary_metrics
from pulsegrid.operators.sets import union_all

# Model settings of the three experiment families.
WINDOW = {
    "forest": {"numTrees": 200, "maxDepth": 8, "minInstancesPerNode": 3},
    "boosted": {"maxIter": 150, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8},
    "logistic": {"C": 1.0, "maxIter": 1000},
}
REGULARISED = {
    "forest": {"numTrees": 50, "maxDepth": 3, "minInstancesPerNode": 10},
    "boosted": {"maxIter": 50, "maxDepth": 2, "stepSize": 0.03, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7"},
    "logistic": {"C": 0.5, "maxIter": 1000},
}
BINARY = {
    "forest": {"numTrees": 100, "maxDepth": 10},
    "boosted": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1},
    "logistic": {"C": 1.0, "maxIter": 1000},
}
SEED = 42
# Rows that one task keeps for the trees; a partition with more of them is cut.
TREE_ROWS = 250_000
VECTOR, PROB, PRED = "__features", "prob", "prediction"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error").transform(df)


@dataclass
class Fitted:
    """A fitted classifier: ``score`` adds ``prob`` (array by class) and ``prediction``."""

    name: str
    score: Callable[[DataFrame], DataFrame]
    models: list = field(default_factory=list)


def _argmax(prob: Column) -> Column:
    # first class with the largest probability
    return (F.array_position(prob, F.array_max(prob)) - 1).cast("int")


def _spark_score(model, probability: bool = True) -> Callable[[DataFrame], DataFrame]:
    raw = [c for c in ("rawPrediction", "probability") if model.hasParam(f"{c}Col")]

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        if probability:
            prob = vector_to_array("probability")
            out = out.withColumn(PROB, prob).withColumn(PRED, _argmax(F.col(PROB)))
        else:
            out = out.withColumn(PRED, F.col(PRED).cast("int"))
        return out.drop(*raw)

    return score


def fit_logistic(train: DataFrame, label: str, weight: str | None = None, C: float = 1.0, maxIter: int = 1000) -> Fitted:
    """L2 logistic regression. ``C`` is the inverse penalty on the summed loss, so the penalty on
    Spark's mean loss is ``1 / (C n)``."""
    lr = LogisticRegression(
        featuresCol=VECTOR, labelCol=label, maxIter=maxIter, regParam=1.0 / (C * train.count()), standardization=False
    )
    if weight:
        lr = lr.setWeightCol(weight)
    model = lr.fit(train)
    return Fitted("logistic", _spark_score(model), [model])


def _spread(train: DataFrame, rows: int | None = None, waves_of: int = 1) -> DataFrame:
    """``train`` in even partitions if one of them holds more than ``rows``: what a task should keep while trees grow.

    Their number is a multiple of ``waves_of``.
    """
    limit = TREE_ROWS if rows is None else rows
    sizes = train.groupBy(F.spark_partition_id().alias("__p")).count()
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    return train.repartition(-(-total // (limit * waves_of)) * waves_of) if (largest or 0) > limit else train


def fit_forest(train: DataFrame, label: str, weight: str | None = None, **params) -> Fitted:
    rf = RandomForestClassifier(featuresCol=VECTOR, labelCol=label, seed=SEED, featureSubsetStrategy="sqrt", **params)
    if weight:
        rf = rf.setWeightCol(weight)
    model = rf.fit(_spread(train))
    return Fitted("forest", _spark_score(model), [model])


def fit_boosted(train: DataFrame, label: str, classes: int = 2, weight: str | None = None, **params) -> Fitted:
    """Gradient-boosted trees. Spark's are binary: for more classes one model per class is fitted
    and their probabilities are normalised."""
    train = _spread(train)
    targets = [1] if classes == 2 else list(range(classes))
    models = []
    for k in targets:
        gbt = GBTClassifier(featuresCol=VECTOR, labelCol="__is", seed=SEED, **params)
        if weight:
            gbt = gbt.setWeightCol(weight)
        models.append(gbt.fit(train.withColumn("__is", (F.col(label) == k).cast("double"))))

    def score(df: DataFrame) -> DataFrame:
        for i, model in enumerate(models):
            scored = model.transform(df).withColumn(f"__p{i}", vector_to_array("probability")[1])
            df = scored.drop("rawPrediction", "probability", "prediction")
        if classes == 2:
            prob = F.array(1 - F.col("__p0"), F.col("__p0"))
        else:
            total = sum((F.col(f"__p{i}") for i in range(1, classes)), F.col("__p0"))
            prob = F.array(*[F.coalesce(F.try_divide(f"__p{i}", total), F.lit(1.0 / classes)) for i in range(classes)])
        out = df.withColumn(PROB, prob).withColumn(PRED, _argmax(F.col(PROB)))
        return out.drop(*[f"__p{i}" for i in range(len(models))])

    return Fitted("boosted", score, models)


def fit_linear_margin(train: DataFrame, label: str, classes: int = 2, regParam: float = 0.01, maxIter: int = 100) -> Fitted:
    """Linear support vector classifier, one-vs-rest for more than two classes. It has no probabilities."""
    svc = LinearSVC(featuresCol=VECTOR, labelCol=label, regParam=regParam, maxIter=maxIter)
    if classes > 2:
        svc = OneVsRest(classifier=svc, featuresCol=VECTOR, labelCol=label)
    model = svc.fit(train)
    return Fitted("linear_margin", _spark_score(model, probability=False), [model])


def fit_naive_bayes(train: DataFrame, label: str) -> Fitted:
    model = NaiveBayes(featuresCol=VECTOR, labelCol=label, modelType="gaussian").fit(train)
    return Fitted("naive_bayes", _spark_score(model), [model])


def soft_voting(members: Sequence[Fitted]) -> Fitted:
    """Mean of the members' probabilities, largest wins."""

    def score(df: DataFrame) -> DataFrame:
        for i, member in enumerate(members):
            df = member.score(df).withColumnRenamed(PROB, f"__v{i}").drop(PRED)
        columns = [F.col(f"__v{i}") for i in range(len(members))]
        total = columns[0]
        for c in columns[1:]:
            total = F.zip_with(total, c, lambda a, b: a + b)
        mean = F.transform(total, lambda x: x / len(members))
        out = df.withColumn(PROB, mean).withColumn(PRED, _argmax(F.col(PROB)))
        return out.drop(*[f"__v{i}" for i in range(len(members))])

    return Fitted("voting", score, [m for x in members for m in x.models])


def compare(
    scored: Mapping[str, DataFrame], label: str, labels: Sequence[int], by: Sequence[str] = ("split",)
) -> DataFrame:
    """Summary metrics per model and split, best test F1 first."""
    rows = union_all(
        *[df.select(*by, label, PRED).withColumn("model", F.lit(name)) for name, df in scored.items()]
    )
    keys = ["model", *by]
    return summary_metrics(confusion_matrix(rows, label, PRED, labels, keys), keys)


def importances(model, features: Sequence[str], k: int = 10) -> DataFrame:
    """Top k feature importances of a tree model (one number per feature)."""
    pairs = [(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())]
    df = SparkSession.active().createDataFrame(pairs, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(k)


# Settings of the boosted regression.
REGRESSION = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}


def fit_boosted_regression(train: DataFrame, target: str, **params) -> tuple[object, Callable[[DataFrame], DataFrame]]:
    """Boosted regression trees; the second value scores a table."""
    model = GBTRegressor(featuresCol=VECTOR, labelCol=target, seed=SEED, **(REGRESSION | params)).fit(_spread(train))
    return model, lambda df: model.transform(df)


def regression_report(scored: DataFrame, target: str, by: Sequence[str] = ("split",)) -> DataFrame:
    return regression_metrics(scored, target, PRED, by)
