"""A margin classifier with a radial kernel: random Fourier features, a linear margin on them, Platt probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.ml.classify import PRED, PROB, SEED, VECTOR, Fitted, _argmax, _spread
from pulsegrid.ml.kmeans import as_array
from pulsegrid.session import freeze

MAPPED, MARGIN = "__mapped", "__margin"
# Mapped values that one task holds; a partition with more rows than that takes is cut.
TASK_VALUES = 16_000_000


@dataclass
class FourierMap:
    """``sqrt(2 / D) cos(w x + b)`` for D directions ``w``; products of two maps estimate ``exp(-gamma |x - y|^2)``."""

    directions: np.ndarray
    offsets: np.ndarray

    @classmethod
    def drawn(cls, width: int, gamma: float, components: int = 256, seed: int = SEED) -> FourierMap:
        """Directions of the kernel with that ``gamma``; the same for the same seed."""
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0.0, np.sqrt(2.0 * gamma), (components, width)), rng.uniform(0.0, 2.0 * np.pi, components))

    def __call__(self, x: Column) -> Column:
        """The map of an array column, in Arrow batches."""
        w, b = self.directions, self.offsets
        scale = np.sqrt(2.0 / len(b))

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def mapped(v: pa.Array) -> pa.Array:
            rows = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            z = scale * np.cos(rows @ w.T + b)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(b), pa.int32()), pa.array(z.ravel()))

        return mapped(x)


def scale_gamma(df: DataFrame, vector: str = VECTOR) -> float:
    """``1 / (features x variance of all their values)``, the usual width where none is given."""
    x = as_array(df, vector)
    row = df.select(F.size(x).alias("d"), F.explode(x).alias("v")).agg(F.max("d").alias("d"), F.var_pop("v").alias("var")).first()
    return 1.0 / (row["d"] * row["var"]) if row["var"] else 1.0


def platt(df: DataFrame, margin: str, positive: Column, rounds: int = 50) -> tuple[float, float]:
    """``(a, b)`` of the probability ``1 / (1 + exp(a margin + b))`` with the least log loss, by Newton steps.

    Each step is five sums over the rows. Targets are drawn in by the counts, so that
    separable rows keep finite numbers.
    """
    sides = df.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).first()
    high, low = (sides["p"] + 1.0) / (sides["p"] + 2.0), 1.0 / (sides["n"] + 2.0)
    a, b = 0.0, float(np.log((sides["n"] + 1.0) / (sides["p"] + 1.0)))
    f, t = F.col(margin), F.when(positive, high).otherwise(low)

    def at(a: float, b: float):
        z = f * a + b
        # the loss without overflow on either side
        loss = F.when(z >= 0, t * z + F.log1p(F.exp(-z))).otherwise((t - 1) * z + F.log1p(F.exp(z)))
        p = F.when(z >= 0, F.exp(-z) / (1 + F.exp(-z))).otherwise(1 / (1 + F.exp(z)))
        q = p * (1 - p)
        return df.agg(*[F.sum(c).alias(n) for n, c in (("l", loss), ("h11", f * f * q), ("h22", q), ("h21", f * q), ("g1", f * (t - p)), ("g2", t - p))]).first()

    now = at(a, b)
    for _ in range(rounds):
        if now["l"] is None or max(abs(now["g1"]), abs(now["g2"])) < 1e-7 * (sides["p"] + sides["n"]):
            break
        h11, h22, h21 = now["h11"] + 1e-12, now["h22"] + 1e-12, now["h21"]
        det = h11 * h22 - h21 * h21
        da, db = -(h22 * now["g1"] - h21 * now["g2"]) / det, -(h11 * now["g2"] - h21 * now["g1"]) / det
        step, better = 1.0, None
        while step >= 1e-10:
            tried = at(a + step * da, b + step * db)
            if tried["l"] < now["l"] + 1e-4 * step * (now["g1"] * da + now["g2"] * db):
                better = tried
                break
            step /= 2
        if better is None:
            break
        a, b, now = a + step * da, b + step * db, better
    return a, b


def fit_kernel_margin(
    train: DataFrame,
    label: str,
    classes: int = 2,
    components: int = 256,
    gamma: float | None = None,
    regParam: float = 1e-3,
    maxIter: int = 100,
    seed: int = SEED,
) -> Fitted:
    """A support vector classifier with (nearly) a radial kernel and probabilities, one against the rest per class.

    The training rows are written once, as they are; the map, many times as wide, is drawn
    anew for each read, which costs less than to write and read it. A row is small and its
    map is not, so rows are dealt to even partitions by the size of the map. With
    ``components`` directions a kernel value is met to about ``1 / sqrt(components)``.
    """
    even = {"rows": max(1, TASK_VALUES // components), "waves_of": train.sparkSession.sparkContext.defaultParallelism}
    width = train.select(F.size(as_array(train, VECTOR)).alias("d")).first()["d"]
    features = FourierMap.drawn(width, gamma if gamma is not None else scale_gamma(train), components, seed)
    rows = _spread(freeze(train.select(F.col(label).cast("int").alias("__y"), as_array(train, VECTOR).alias("__x"))), **even)
    rows = rows.select("__y", array_to_vector(features(F.col("__x"))).alias(MAPPED))
    models, slopes = [], []
    for k in [1] if classes == 2 else range(classes):
        is_k = F.col("__y") == k
        svc = LinearSVC(featuresCol=MAPPED, labelCol="__is", rawPredictionCol="__raw", predictionCol="__pred", regParam=regParam, maxIter=maxIter)
        model = svc.fit(rows.withColumn("__is", is_k.cast("double")))
        margins = freeze(model.transform(rows).select(vector_to_array("__raw")[1].alias(MARGIN), is_k.alias("__is")))
        models.append(model)
        slopes.append(platt(margins, MARGIN, F.col("__is")))

    def score(df: DataFrame) -> DataFrame:
        df = _spread(df, **even)
        out = df.withColumn(MAPPED, array_to_vector(features(as_array(df, VECTOR))))
        for i, (model, (a, b)) in enumerate(zip(models, slopes)):
            out = model.transform(out).withColumn(f"__p{i}", 1 / (1 + F.exp(vector_to_array("__raw")[1] * a + b))).drop("__raw", "__pred")
        if classes == 2:
            prob = F.array(1 - F.col("__p0"), F.col("__p0"))
        else:
            total = sum((F.col(f"__p{i}") for i in range(1, classes)), F.col("__p0"))
            prob = F.array(*[F.coalesce(F.try_divide(f"__p{i}", total), F.lit(1.0 / classes)) for i in range(classes)])
        out = out.withColumn(PROB, prob).withColumn(PRED, _argmax(F.col(PROB)))
        return out.drop(MAPPED, *[f"__p{i}" for i in range(len(models))])

    return Fitted("kernel_margin", score, models)
