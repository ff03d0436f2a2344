"""Exact train / validation / test splits without collecting a class or the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.plans.ordered import matched, position


def _assign(rank: Column, n: Column, train: float, val: float) -> Column:
    """``int(train n)`` rows, then ``int(val n)`` rows, then the rest (rank counts from 1).

    A fraction as a double can fall just below the whole number it stands for,
    as it does in the usual floating-point product; the same product is used.
    """
    n_train, n_val = F.floor(n * F.lit(train)), F.floor(n * F.lit(val))
    return F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")


def chronological_split(
    df: DataFrame, order: Sequence[str], train: float = 0.70, val: float = 0.15
) -> DataFrame:
    """Adds ``split`` by global time order. ``order`` needs a unique last column.

    The global rank comes from sorted ranges and their sizes, not from one
    sorted partition.
    """
    n = df.count()
    ranked = position(df, [], [F.col(c) for c in order], "__rank")
    return ranked.withColumn("split", _assign(F.col("__rank"), F.lit(n), train, val)).drop("__rank")


def random_split(
    df: DataFrame,
    row_id: str,
    stratify: str | None = None,
    train: float = 0.70,
    val: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Adds ``split`` at random (in the order of a hash of seed and id) with exact sizes, per class of ``stratify`` if given; rows without a class are a class of their own."""
    keys = [stratify] if stratify else []
    shuffled = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"))))
    ranked = position(shuffled, keys, [F.col("__h"), F.col(row_id)], "__rank")
    if stratify:
        sizes = df.groupBy(stratify).agg(F.count("*").alias("__n"))
        ranked = matched(ranked, sizes, [stratify])
        n = F.col("__n")
    else:
        n = F.lit(df.count())
    return ranked.withColumn("split", _assign(F.col("__rank"), n, train, val)).drop("__h", "__rank", "__n")
