"""The splitting plans for hot keys give the same results as the plain ones."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import sequences, split
from pulsegrid.operators.asof import nearest_asof
from pulsegrid.operators.calendar import MAX_ENTRIES, calendar_facts
from pulsegrid.operators import calendar as cal
from pulsegrid.operators.joins import keep_one
from pulsegrid.operators.stats import robust_summary
from pulsegrid.ml.fitted import with_class_weights
from pulsegrid.plans import ordered
from pulsegrid.plans.quantile import exact_quantiles
from pulsegrid.plans.skew import salted_join


def hot_frame(spark, n=120):
    """One key holds most rows, one has a single row; some values are missing."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        key = "hot" if i % 10 else ("one" if i == 0 else f"k{i % 3}")
        value = None if rng.random() < 0.4 else float(rng.randint(0, 9))
        rows.append((i, key, rng.randint(0, 40), value))
    return spark.createDataFrame(rows, "id int, key string, t int, v double")


def both(spark, build):
    from pulsegrid.session import MAX_GROUP_ROWS

    spark.conf.unset(MAX_GROUP_ROWS)
    plain = sorted(map(tuple, build().collect()), key=repr)
    spark.conf.set(MAX_GROUP_ROWS, "5")
    try:
        split_rows = sorted(map(tuple, build().collect()), key=repr)
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)
    return plain, split_rows


ORDER = ["t", "id"]
CASES = {
    "lags": lambda df: sequences.lags(df, ["key"], ORDER, "v", [1, 2]),
    "rolling": lambda df: sequences.rolling(df, ["key"], ORDER, "v", 3),
    "difference": lambda df: sequences.first_difference(df, ["key"], ORDER, {"v": "dv"}),
    "position": lambda df: sequences.sequence_position(df, ["key"], ORDER),
    "fill": lambda df: sequences.fill_missing(df, ["key"], ORDER, ["v"]),
    "sequences": lambda df: sequences.sliding_sequences(df, ["key"], ORDER, ["v", "id"], "v", 3),
    "quantiles": lambda df: exact_quantiles(df, ["key"], "v", {"a": 0.1, "m": 0.5, "z": 0.97}),
    "split": lambda df: split.random_split(df, "id", "key"),
    "spacing": lambda df: sequences.median_spacing(df.withColumn("at", F.timestamp_seconds("t").cast("timestamp_ntz")), ["key"], "at", "id"),
    "asof": lambda df: nearest_asof(
        df.withColumn("at", F.timestamp_seconds("t").cast("timestamp_ntz")),
        df.where("id % 3 = 0").withColumn("at", F.timestamp_seconds(F.col("t") + 2).cast("timestamp_ntz")),
        "at", "id", ["v"], 30, ["key"], drop_incomplete=False,
    ),
    "sums": lambda df: ordered.running_sums(df, ["key"], [F.col("t").desc(), F.col("id")], {"s": F.col("v")}),
}


@pytest.mark.parametrize("hot", ["hot", None])
@pytest.mark.parametrize("case", sorted(CASES))
def test_split_plan_equals_plain_plan(spark, case, hot):
    """Also where the hot key is NULL, and with a key that has no value at all."""
    df = hot_frame(spark).withColumn("key", F.when(F.col("key") != "hot", F.col("key")).otherwise(F.lit(hot)))
    df = df.withColumn("v", F.when(F.col("key") == "k1", None).otherwise(F.col("v")))
    plain, split_rows = both(spark, lambda: CASES[case](df))
    assert plain == split_rows
    assert plain


def test_running_sum_over_whole_table(spark):
    df = hot_frame(spark)
    got = {r["id"]: r["__rn"] for r in ordered.position(df, [], [F.col("t"), F.col("id")]).collect()}
    want = sorted((r["t"], r["id"]) for r in df.collect())
    assert got == {i: n for n, (_, i) in enumerate(want, 1)}


def test_salted_join_keeps_every_pair(spark):
    facts = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    other = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (999, "d")], "k bigint, name string")
    for how in ("inner", "left"):
        plain, salted = both(spark, lambda how=how: salted_join(facts, other, ["k"], ["id"], how).select("id", "k", "name"))
        assert plain == salted


def test_quantiles_equal_numpy(spark, small_groups):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": np.round(rng.normal(size=500), 1)})
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"a": 0.05, "b": 1 / 3, "c": 0.5, "d": 1.0}).toPandas()
    for _, row in got.iterrows():
        v = pdf.loc[pdf.g == row["g"], "v"]
        assert np.allclose(row[["a", "b", "c", "d"]].astype(float), np.quantile(v, [0.05, 1 / 3, 0.5, 1.0]))


def test_large_calendar_equals_small_one(spark, monkeypatch):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-02-10')) as d").select(
        "d", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("g")
    )
    entries = spark.sql(
        """select * from values (0, 1, date'2024-01-05', date'2024-01-08', 'a'), (1, 1, date'2024-01-07', date'2024-01-12', 'b'),
        (2, 1, date'2024-01-30', date'2024-02-01', 'c'), (3, 2, date'2024-01-10', date'2024-01-10', 'd'),
        (4, 1, date'2024-01-20', date'2024-01-18', 'ends before it starts'), (5, null, date'2024-01-20', date'2024-01-21', 'no group')
        as t(seq, `group`, start, end, name)"""
    )
    assert MAX_ENTRIES > 4
    names = ["d", "g", "cal_in", "cal_next", "cal_prev", "cal_known"]
    for inclusive in (False, True):
        folded = calendar_facts(days, entries, "g", "d", inclusive).select(*names).collect()
        monkeypatch.setattr(cal, "MAX_ENTRIES", 2)
        by_day = calendar_facts(days, entries, "g", "d", inclusive).select(*names).collect()
        monkeypatch.setattr(cal, "MAX_ENTRIES", 10_000)
        assert sorted(map(repr, folded)) == sorted(map(repr, by_day))


def test_keep_one_is_an_aggregate_not_a_window(spark):
    plan = keep_one(hot_frame(spark), ["key"], "id")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_empty_values(spark, small_groups):
    df = spark.createDataFrame([("a", None), ("a", None)], "g string, v double")
    assert exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect() == []
    assert math.isnan(float("nan"))


def test_column_without_values_stays(spark):
    df = hot_frame(spark).select("v", F.lit(None).cast("double").alias("nothing"))
    plain, split_rows = both(spark, lambda: robust_summary(df, ["v", "nothing"]))
    assert plain == split_rows and len(plain) == 2


def test_rows_without_a_label_stay(spark):
    df = hot_frame(spark).withColumn("label", F.when(F.col("id") % 2 == 0, F.col("id") % 3))
    plain, split_rows = both(spark, lambda: split.random_split(df, "id", "label"))
    assert plain == split_rows and len(plain) == 120
    assert with_class_weights(df, "label").where("weight is null").count() == 60
