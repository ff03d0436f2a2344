"""Isolation forest: trees grow in parallel on small samples, all rows are scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.ml.anomaly import flag_lowest
from pulsegrid.plans.sample import bottom_k
from pulsegrid.session import freeze

SEED = 42
# the children of node i are 2 i + 1 and 2 i + 2; a leaf has feature -1
NODE_SCHEMA = "tree int, node int, feature int, threshold double, length double, rows int"


def average_path(n):
    """Mean path length of an unsuccessful search in a binary tree of n values."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    harmonic = np.log(big - 1.0) + np.euler_gamma
    return np.where(n > 2, 2.0 * harmonic - 2.0 * (big - 1.0) / big, np.where(n == 2, 1.0, 0.0))


def tree_samples(df: DataFrame, row_id: str, features: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """``(tree, id, x)`` with ``sample`` rows per tree, or all rows if there are fewer, in one read of the table."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(F.xxhash64(F.lit(seed), F.col(row_id)).alias("h"), F.col(row_id).alias("id"), x.alias("x"))
    return bottom_k(rows, "h", ["id", "x"], trees, sample).withColumnRenamed("draw", "tree")


def _grow(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One tree from its sample (at most a few hundred rows)."""
    pdf = pdf.sort_values("id")
    tree, x = int(pdf["tree"].iloc[0]), np.stack(pdf["x"].to_numpy())
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(0), part.max(0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append((tree, node, -1, 0.0, depth + float(average_path(len(rows))), len(rows)))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        go_left = part[:, f] <= cut
        nodes.append((tree, node, f, cut, 0.0, 0))
        todo += [(2 * node + 1, rows[go_left], depth + 1), (2 * node + 2, rows[~go_left], depth + 1)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "length", "rows"])


def _full_tree(nodes: pd.DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and thresholds of a complete tree and the path length at each of its bottom leaves.

    A leaf above the bottom sends everything to the left, and its length stands
    at the bottom leaf that is reached this way.
    """
    inner = (1 << depth) - 1
    feature, threshold = np.zeros(inner, dtype=np.int32), np.full(inner, np.inf)
    length = np.zeros(1 << depth)
    for node, f, cut, path in nodes[["node", "feature", "threshold", "length"]].itertuples(index=False):
        if f >= 0:
            feature[node], threshold[node] = f, cut
        else:
            while node < inner:
                node = 2 * node + 1
            length[node - inner] = path
    return feature, threshold, length


def fit_forest(
    df: DataFrame, row_id: str, features: Sequence[str], trees: int = 100, sample: int = 256, seed: int = SEED
) -> dict:
    """The forest as arrays: fewer than ``4 * sample`` nodes per tree, whatever the size of the table."""
    drawn = tree_samples(df, row_id, features, trees, sample, seed)
    nodes = drawn.groupBy("tree").applyInPandas(lambda pdf: _grow(pdf, seed), NODE_SCHEMA).toPandas()
    # all trees have samples of one size, which the sizes of their leaves add up to
    used = int(nodes.loc[nodes["tree"] == 0, "rows"].sum())
    depth = int(np.ceil(np.log2(max(used, 2))))
    return {
        "trees": [_full_tree(g, depth) for _, g in nodes.groupby("tree")],
        "depth": depth,
        "norm": float(average_path(used)) or 1.0,
        "features": list(features),
    }


def score_column(df: DataFrame, forest: dict) -> Column:
    """Score per row, lower is more anomalous: ``-2 ** (-mean path / expected path)``."""
    held = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = held.value
        for columns in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            flat, first = x.ravel(), np.arange(len(x)) * x.shape[1]
            total = np.zeros(len(x))
            for feature, threshold, length in model["trees"]:
                node = np.zeros(len(x), dtype=np.int64)
                for _ in range(model["depth"]):
                    value = flat.take(first + feature.take(node))
                    node = 2 * node + 1 + (value > threshold.take(node))
                total += length.take(node - len(feature))
            yield pd.Series(-np.power(2.0, -(total / len(model["trees"])) / model["norm"]))

    return score(*[F.col(c).cast("double") for c in forest["features"]])


def isolation_forest(
    df: DataFrame,
    row_id: str,
    features: Sequence[str],
    contamination: float = 0.1,
    trees: int = 100,
    sample: int = 256,
    seed: int = SEED,
) -> DataFrame:
    """Adds ``score``, ``is_anomaly`` and ``anomaly``. Features are expected complete (see ``impute_median``)."""
    forest = fit_forest(df, row_id, features, trees, sample, seed)
    # the threshold and the result both read the scores, so they are written once
    scored = freeze(df.withColumn("score", score_column(df, forest)))
    return flag_lowest(scored, "score", contamination)
