"""Result sinks and stored statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    max_rows_per_file: int = 5_000_000,
) -> str:
    """Write a result, one directory per category or split.

    Rows are not gathered per category first: every task writes its own file for
    each category it meets, and a large category is spread over many tasks.
    """
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # the default layout of a naive timestamp stops at milliseconds
        micro = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        writer = writer.options(header=True, timestampNTZFormat=micro)
    writer.format(fmt).save(path)
    return path


def save_statistics(df: DataFrame, path: str) -> str:
    """A table of fitted statistics (imputer, scaler, baselines). It has one row per column or entity."""
    df.write.mode("overwrite").parquet(path)
    return path


def load_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path
