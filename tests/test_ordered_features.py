"""Features made together equal those made one by one, from one sort."""

import math

import pytest
from pyspark.sql import functions as F
from test_skew import ORDER, hot_frame

from pulsegrid.operators import sequences as seq
from pulsegrid.operators.ordered_features import OrderedFeatures
from pulsegrid.plans import ordered
from pulsegrid.session import MAX_GROUP_ROWS


def together(df, keys):
    made = OrderedFeatures(df, keys, ORDER).lags("v", [1, 4]).differences({"v": "dv"}).rolling("v", 3).sequences(["v", "id"], 3)
    return made.position()


def one_by_one(df, keys):
    out = seq.lags(df, keys, ORDER, "v", [1, 4])
    out = seq.first_difference(out, keys, ORDER, {"v": "dv"})
    out = seq.rolling(out, keys, ORDER, "v", 3)
    out = seq.sequence_position(out, keys, ORDER)
    filled = seq.fill_missing(df, keys, ORDER, ["v"]).select("id", F.col("v").alias("full"))
    whole = seq.sliding_sequences(df, keys, ORDER, ["v", "id"], "v", 3).select("id", "sequence")
    return out.join(filled, "id").join(whole, "id", "left")


def as_rows(df):
    cols = ["id", "key", "t", "v", "v_lag1", "v_lag4", "dv", "v_rolling_mean", "v_rolling_std", "seq_position", "sequence", "full"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("partitions", [2, 40])
def test_equal_to_single_features(spark, keys, partitions):
    """With 40 ranges for 120 rows a context reaches over several ranges."""
    df = hot_frame(spark).withColumn("key", F.when(F.col("key") != "k2", F.col("key")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = as_rows(one_by_one(df, keys))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        for limit in ("5", None):
            spark.conf.set(MAX_GROUP_ROWS, limit) if limit else spark.conf.unset(MAX_GROUP_ROWS)
            got = as_rows(together(df, keys).filled({"v": "full"}).table())
            assert len(got) == len(want) == 120
            for g, w in zip(got, want):
                for a, b in zip(g, w):
                    assert a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (g, w)
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plan_of(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning"), text.count("Sort ["), text.count("Exchange rangepartitioning")


def test_five_features_cost_one_sort(spark, tmp_path, monkeypatch):
    hot_frame(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert plan_of(together(df, ["key"]).table()) == (1, 1, 0)
    written = []
    inner = ordered.range_chunks
    monkeypatch.setattr(ordered, "range_chunks", lambda *a: written.append(1) or inner(*a))
    spark.conf.set(MAX_GROUP_ROWS, "5")
    try:
        exchanges, sorts, ranged = plan_of(together(df, ["key"]).table())
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)
    assert (len(written), exchanges, sorts, ranged) == (1, 1, 1, 0)


def test_empty_table_and_replaced_columns(spark):
    df = hot_frame(spark)
    assert together(df.limit(0), ["key"]).filled({"v": "full"}).table().count() == 0
    out = OrderedFeatures(df, ["key"], ORDER).filled({"v": "v"}).position("t").table()
    assert out.columns == ["id", "key", "t", "v"] and out.where("v is null").count() == 0
