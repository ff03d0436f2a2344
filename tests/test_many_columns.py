"""Correlations of very many columns: tiles against numpy, one read of the table, no expression per pair."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import stats
from pulsegrid.plans import gram


def plain(x, y):
    """Two-pass Pearson over common rows; None without spread."""
    both = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[both], y[both]
    if len(x) < 2 or (x == x[0]).all() or (y == y[0]).all():
        return None
    x, y = x - x.mean(), y - y.mean()
    return float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))


@pytest.fixture(scope="module")
def wide(spark):
    draw = np.random.default_rng(1)
    n, p = 900, 500
    base = draw.normal(size=(n, 20))
    x = base @ draw.normal(size=(20, p)) + draw.normal(size=(n, p)) * draw.uniform(0.1, 3, p)
    x = x * 10.0 ** draw.integers(-3, 4, p) + 10.0 ** draw.integers(0, 7, p)
    x[draw.random((n, p)) < 0.15] = np.nan
    x[:, 7] = 0.1
    x[:, 8] = np.nan
    x[: n // 2, 9] = np.nan
    x[n // 2 :, 10] = np.nan
    x[: n // 2, 11] = 1e9 / 3  # constant wherever column 10 has values
    cols = [f"v{i}" for i in range(p)]
    return x, cols, spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(7)


def test_matrix_of_500_columns(wide):
    x, cols, df = wide
    scans = stats.correlation_matrix(df, cols)
    plan = scans._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 200_000 and plan.count("corr(") == plan.count("regr_") == 0
    got = {(r["var_a"], r["var_b"]): r["r"] for r in scans.collect()}
    assert len(got) == 500 * 500
    draw = np.random.default_rng(2)
    pairs = [tuple(p) for p in draw.integers(0, 500, (3000, 2))] + [(a, b) for a in range(6, 14) for b in (0, 7, 8, 9, 10, 11, 64, 499)]
    for a, b in pairs:
        want, r = plain(x[:, a], x[:, b]), got[cols[a], cols[b]]
        assert (r is None) == (want is None), (a, b)
        if r is not None:
            # column 11 lies ten orders of magnitude above itself in the other half of the rows
            assert r == pytest.approx(1.0 if a == b else want, abs=1e-5 if 11 in (a, b) else 1e-9), (a, b)
        assert r == got[cols[b], cols[a]]


def test_tiles_are_handed_on_where_they_do_not_fit(wide, monkeypatch):
    x, cols, df = wide
    monkeypatch.setattr(gram, "TILE_BYTES", 0)
    monkeypatch.setattr(gram, "ROWS", 50)
    some = cols[:70]
    got = {(r["var_a"], r["var_b"]): r["r"] for r in stats.correlation_matrix(df, some).collect()}
    for a in range(0, 70, 3):
        for b in range(70):
            want = plain(x[:, a], x[:, b])
            assert got[some[a], some[b]] == (want if want is None else pytest.approx(want, abs=1e-5 if 11 in (a, b) else 1e-9))


@pytest.mark.parametrize("few", [0, 40])
def test_targets_and_odd_columns(spark, monkeypatch, few):
    """Alike from one aggregate row and from tiles."""
    monkeypatch.setattr(gram, "FEW_PAIRS", few)
    rows = [(1.0, 2.0, None, float("nan"), 5), (2.0, 4.1, 1.0, 1.0, 5), (3.0, 5.9, 2.0, 2.5, 5), (4.0, 8.2, 2.5, 2.0, 5)]
    df = spark.createDataFrame(rows, "`a.b` double, t double, n double, w double, same int")
    got = {(r["var_a"], r["var_b"]): r["r"] for r in gram.correlations(df, ["t"], ["a.b", "n", "w", "same", "t"]).collect()}
    x = {c: np.array([np.nan if r[i] is None else r[i] for r in rows], float) for i, c in enumerate(df.columns)}
    for c in df.columns:
        want = plain(x["t"], x[c])
        assert got["t", c] == (want if want is None else pytest.approx(want))
    top = stats.target_correlations(df, ["a.b", "n", "same", "t"], ["t"], 2).collect()
    assert [r["variable"] for r in top][0] == "a.b" and all(r["variable"] != "same" for r in top)
    assert stats.correlation_matrix(df.limit(0), ["t", "n"]).where("r is not null").count() == 0
    assert gram.correlations(df.select(F.col("t"), F.lit(float("inf")).alias("i")), ["t"], ["i"]).first()["r"] is None
