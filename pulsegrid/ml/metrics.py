"""Classification and regression metrics from tables of (label, prediction, probabilities)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import neighbours, running_sums
from pulsegrid.session import freeze


def _literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, labels: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Counts and row shares over the full grid of classes."""
    # one grid of classes per split or model
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(_literals(labels)).alias("label")).select(
        *by, "label", F.explode(_literals(labels)).alias("prediction")
    )
    counts = df.groupBy(*by, F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(
        F.count("*").alias("n")
    )
    full = grid.join(counts, [*by, "label", "prediction"], "left").withColumn("rows", F.coalesce("n", F.lit(0)))
    # windows over classes x classes cells
    row_total = F.sum("rows").over(Window.partitionBy(*by, "label"))
    return full.select(
        *by, "label", "prediction", "rows", F.coalesce(F.try_divide("rows", row_total), F.lit(0.0)).alias("row_share")
    )


def class_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, 0 where undefined. Recall is the accuracy per class."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0)
    per_label = confusion.groupBy(*by, "label").agg(F.sum("rows").alias("support"), F.sum(hit).alias("tp"))
    per_pred = confusion.groupBy(*by, F.col("prediction").alias("label")).agg(F.sum("rows").alias("predicted"))
    zero = F.lit(0.0)
    joined = per_label.join(per_pred, [*by, "label"])
    precision = F.coalesce(F.try_divide("tp", "predicted"), zero)
    recall = F.coalesce(F.try_divide("tp", "support"), zero)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)
    return joined.select(*by, "label", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def summary_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro / weighted precision, recall and F1. Classes without true and predicted
    rows are left out of the averages."""
    per_class = class_metrics(confusion, by)
    either = confusion.select(*by, "rows", F.explode(F.array("label", "prediction")).alias("label"))
    used = either.groupBy(*by, "label").agg(F.sum("rows").alias("seen"))
    data = per_class.join(used.where("seen > 0").drop("seen"), [*by, "label"])
    aggs: list[Column] = [
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy")
    ]
    for m in ("precision", "recall", "f1"):
        aggs.append(F.avg(m).alias(f"{m}_macro"))
        aggs.append(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"{m}_weighted"))
    return data.groupBy(*by).agg(*aggs)


def one_vs_rest(df: DataFrame, label: str, scores: Mapping[int, str]) -> DataFrame:
    """Long form (class, positive, score): one row per input row and class."""
    entries = F.array(
        *[
            F.struct(
                F.lit(k).alias("class"),
                (F.col(label) == k).cast("int").alias("positive"),
                F.col(c).cast("double").alias("score"),
            )
            for k, c in scores.items()
        ]
    )
    return df.select(F.explode(entries).alias("__e")).select("__e.*")


def roc_curve_points(long: DataFrame, keys: Sequence[str] = ("class",)) -> DataFrame:
    """ROC points per key, one per distinct score from high to low.

    Rows are reduced to counts per score first, and written, as they are read
    several times. Running totals over sorted ranges keep a class of any size
    out of a single task.
    """
    keys = list(keys)
    counts = long.groupBy(*keys, "score").agg(
        F.sum("positive").alias("pos"), (F.count("*") - F.sum("positive")).alias("neg")
    )
    counts = freeze(counts)
    cum = running_sums(counts, keys, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # one row per class, or a single row
    joined = cum.join(totals, keys) if keys else cum.crossJoin(totals)
    return joined.select(
        *keys,
        "score",
        F.try_divide("fp", "N").alias("fpr"),
        F.try_divide("tp", "P").alias("tpr"),
        "pos",
        "neg",
        "tp",
        "fp",
        "P",
        "N",
    )


def auc_from_points(points: DataFrame, keys: Sequence[str] = ("class",)) -> DataFrame:
    """Area under the curve: every positive beats the negatives that score lower, and half of its ties."""
    below = F.col("N") - F.col("fp")
    won = F.col("pos") * (below + F.col("neg") / 2)
    return points.groupBy(*keys).agg(
        F.try_divide(F.sum(won), F.max("P") * F.max("N").cast("double")).alias("auc"), F.max("P").alias("positives")
    )


def roc_auc(df: DataFrame, label: str, scores: Mapping[int, str]) -> DataFrame:
    """Rows (average, auc): each class, ``macro``, ``weighted`` and ``micro``."""
    long = one_vs_rest(df, label, scores)
    per_class = auc_from_points(roc_curve_points(long))
    micro = auc_from_points(roc_curve_points(long, []), [])
    named = per_class.select(F.concat(F.lit("class "), F.col("class")).alias("average"), "auc")
    averages = per_class.agg(
        F.avg("auc").alias("macro"),
        F.try_divide(F.sum(F.col("auc") * F.col("positives")), F.sum("positives")).alias("weighted"),
    ).unpivot([], ["macro", "weighted"], "average", "auc")
    return named.unionByName(averages).unionByName(micro.select(F.lit("micro").alias("average"), "auc"))


def binary_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return auc_from_points(roc_curve_points(one_vs_rest(df, label, {1: score}))).select("auc")


def roc_table(df: DataFrame, label: str, scores: Mapping[int, str]) -> DataFrame:
    """ROC curves (curve, fpr, tpr) per class and ``micro``; the origin is included."""
    long = one_vs_rest(df, label, scores)
    each = roc_curve_points(long).select(F.col("class").cast("string").alias("curve"), "fpr", "tpr")
    micro = roc_curve_points(long, []).select(F.lit("micro").alias("curve"), "fpr", "tpr")
    both = each.unionByName(micro)
    origin = both.select("curve").distinct().select("curve", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return both.unionByName(origin)


def macro_roc(df: DataFrame, label: str, scores: Mapping[int, str]) -> DataFrame:
    """Mean curve: at every false positive rate of any class the mean of the linearly interpolated
    true positive rates. At a vertical step the upper end counts.

    One row per rate carries the ends of the steps of all classes, so that a single
    pass in order of the rates finds the points around each of them for every class.
    """
    long = one_vs_rest(df, label, scores)
    origin = long.select("class").distinct().select("class", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = roc_curve_points(long).select("class", "fpr", "tpr").unionByName(origin)
    fpr, classes = F.col("fpr"), range(len(scores))
    ends = []
    for i, k in enumerate(scores):
        own = F.when(F.col("class") == k, F.col("tpr"))
        ends += [F.min(own).alias(f"lo{i}"), F.max(own).alias(f"hi{i}")]
    # every class needs a value at every rate of any class; a rate that is no number has none
    line = points.groupBy("fpr").agg(*ends).select(
        "fpr", *[F.when(F.col(f"hi{i}").isNotNull() & fpr.isNotNull(), F.struct("fpr", f"lo{i}", f"hi{i}")).alias(f"known{i}") for i in classes]
    )
    near = neighbours(freeze(line), [], [fpr], {f"known{i}": (f"before{i}", f"after{i}") for i in classes})

    def value(i: int) -> Column:
        before, after, hi = F.col(f"before{i}"), F.col(f"after{i}"), F.col(f"before{i}")[f"hi{i}"]
        slope = F.try_divide(after[f"lo{i}"] - hi, after["fpr"] - before["fpr"])
        return F.when(before["fpr"] == fpr, hi).otherwise(hi + slope * (fpr - before["fpr"]))

    values = [value(i) for i in classes]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return near.select("fpr", F.try_divide(total, sum((v.isNotNull().cast("int") for v in values), F.lit(0))).alias("tpr"))


def regression_metrics(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE and R²."""
    err = F.col(truth) - F.col(prediction)
    mse = F.avg(err * err)
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(truth))).alias("r2"),
    )


# Upper limits of the gap between training and test accuracy, their names (the last one
# is for larger gaps), and whether a gap on the limit still belongs to the lower band.
GAP_BANDS = {
    "three_class": ((0.05, 0.15), ("Minimal", "Acceptable", "Significant"), False),
    "binary": ((0.05, 0.10), ("Good", "Moderate", "Possible overfitting"), True),
    "sequence": ((0.10, 0.15), ("Excellent", "Good", "Moderate overfitting"), True),
}


def gap_band(gap: Column, variant: str = "three_class") -> Column:
    limits, names, closed = GAP_BANDS[variant]
    out = F.lit(names[-1])
    for limit, name in reversed(list(zip(limits, names))):
        out = F.when(gap <= limit if closed else gap < limit, F.lit(name)).otherwise(out)
    return F.when(gap.isNotNull(), out)


def generalisation_gap(
    metrics: DataFrame, keys: Sequence[str], metric: str = "accuracy", variant: str = "three_class"
) -> DataFrame:
    """Train minus test value of a metric per model, with its band."""

    def of(split: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(metric)))

    both = metrics.groupBy(*keys).agg(of("train").alias("train"), of("test").alias("test"))
    gap = F.col("train") - F.col("test")
    return both.withColumns({"gap": gap, "band": gap_band(gap, variant)})
