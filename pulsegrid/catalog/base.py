"""Registry of the runnable queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
# Added before rounding on both sides, so that a value half-way between two
# digits does not depend on how an engine rounds it.
NUDGE = 2.5e-8


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)``; its floating-point columns are rounded for comparison."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.select(
        *[F.round(F.col(f"`{c}`") + F.lit(NUDGE), digits).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]
    )


def r(expr: str, digits: int = DIGITS) -> str:
    """The same rounding in check SQL; adding 0 turns a negative zero into zero."""
    return f"(round({expr} + {NUDGE}, {digits}) + 0.0)"


def half_up(expr: str, digits: int) -> str:
    """Rounding that is part of an operator: half up on the decimal form of the number."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select("event_id", "user_id", F.col("ts").alias("response_ts"), F.col("value").alias("target"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type <> 'purchase'")
    return e.select(
        F.col("event_id").alias("sample_id"),
        "user_id",
        "ts",
        F.col("value").alias("pulse"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("oxygen"),
    )


RESPONSES = (
    "responses AS (SELECT event_id, user_id, ts AS response_ts, value AS target, "
    "CAST(CASE WHEN hour(ts) < 2 THEN ts - INTERVAL 1 DAY ELSE ts END AS DATE) AS assigned "
    "FROM events WHERE event_type = 'purchase')"
)
SAMPLES = (
    "samples AS (SELECT event_id AS sample_id, user_id, ts, value AS pulse, "
    "CASE WHEN event_type = 'view' THEN value END AS oxygen "
    "FROM events WHERE event_type <> 'purchase')"
)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse wide columns named like window features, plus one target."""
    v = F.col("value")
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        "event_id",
        "user_id",
        "ts",
        F.to_date("ts").alias("date"),
        F.when(kind.isin("click", "view"), v).alias("hr_mean"),
        F.when(kind == "view", v).alias("hr_std"),
        F.when(kind == "signup", v).alias("steps_count"),
        F.when(v > 180, v).alias("spo2_min"),
        F.when(kind != "error", v).alias("sleep_max"),
        v.alias("q_stress"),
    )


WIDE = (
    "wide AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS date, "
    "CASE WHEN event_type IN ('click', 'view') THEN value END AS hr_mean, "
    "CASE WHEN event_type = 'view' THEN value END AS hr_std, "
    "CASE WHEN event_type = 'signup' THEN value END AS steps_count, "
    "CASE WHEN value > 180 THEN value END AS spo2_min, "
    "CASE WHEN event_type <> 'error' THEN value END AS sleep_max, "
    "value AS q_stress FROM events)"
)
WIDE_FEATURES = ["hr_mean", "hr_std", "steps_count", "spo2_min", "sleep_max"]


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer and date: sparse days over seven years."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"))


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of type purchase by user and day."""
    e = events(spark, sf_dir).where("event_type = 'purchase'")
    return e.select("event_id", "user_id", F.to_date("ts").alias("day"))


EVENT_DAYS = (
    "event_days AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day "
    "FROM events WHERE event_type = 'purchase')"
)


def calendar(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """SELECT * FROM VALUES
        (0, 0, date '2024-01-03', date '2024-01-05', 'early'), (1, 0, date '2024-01-15', date '2024-01-17', 'mid'),
        (2, 1, date '2024-01-08', date '2024-01-09', 'second'), (3, 1, date '2024-01-20', date '2024-01-24', 'late')
        AS calendar(seq, `group`, start, end, name)"""
    )


CALENDAR = (
    "calendar(seq, grp, s, e, name) AS (VALUES "
    "(0, 0, DATE '2024-01-03', DATE '2024-01-05', 'early'), (1, 0, DATE '2024-01-15', DATE '2024-01-17', 'mid'), "
    "(2, 1, DATE '2024-01-08', DATE '2024-01-09', 'second'), (3, 1, DATE '2024-01-20', DATE '2024-01-24', 'late'))"
)
HOLIDAY = ("2024-01-10", "2024-01-12")


def calendar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a calendar group; users divisible by three beyond the first two groups have none."""
    return events(spark, sf_dir).select(
        "event_id", "user_id", (F.col("user_id") % 3).cast("int").alias("grp"), F.to_date("ts").alias("day")
    )


CALENDAR_ROWS = (
    "rows AS (SELECT event_id, user_id, CAST(user_id % 3 AS INTEGER) AS grp, CAST(ts AS DATE) AS day FROM events)"
)
