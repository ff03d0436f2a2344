"""Unions and key-set operations."""

from __future__ import annotations

from collections.abc import Mapping

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack tables with different columns; a missing column is NULL, duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_labelled(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    return union_all(*[df.withColumn(label, F.lit(name)) for name, df in frames.items()])


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def split_overlap(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split, with the splits."""
    return (
        df.groupBy(key)
        .agg(F.array_sort(F.collect_set(split)).alias("splits"))
        .where(F.size("splits") > 1)
        .select(key, F.array_join("splits", ",").alias("splits"))
    )
