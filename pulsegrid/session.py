"""Session set-up, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest number of rows of one key that a single task is trusted with. Operators
# that need a whole key in one place measure the largest key against it and use
# a splitting plan beyond it.
MAX_GROUP_ROWS = "spark.pulsegrid.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000


def build_session(master: str | None = None, app: str = "pulsegrid", **conf: str) -> SparkSession:
    """A session with the settings the operators count on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_GROUP_ROWS, str(DEFAULT_MAX_GROUP_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as named in ``spark.checkpoint.dir``.

    Where that is unset, a folder in the session's warehouse is taken, which a
    cluster shares as well. No machine-local temporary folder is ever used.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pulsegrid-scratch"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pulsegrid-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, below one folder per application."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote for itself. Results that still read from it are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freeze(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    Besides iterative jobs this is needed wherever one result is read twice and
    both reads must agree on row placement. A written table, unlike a
    checkpoint, is read by column and has a known size for join planning.
    """
    path = scratch_path(df.sparkSession, "frozen")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
