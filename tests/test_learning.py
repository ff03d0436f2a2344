"""Clustering and anomaly jobs against brute force; invariants of the models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.ml import classify, cluster, dbscan, iforest, lof, reduce
from pulsegrid.plans import knn
from pulsegrid.plans.components import connected_components


def points(seed=0, n=300, copies=40):
    """Two dense groups, a thin bridge, scattered rows, and many copies of one point."""
    rng = np.random.default_rng(seed)
    parts = [
        rng.normal([0, 0], 0.3, (n // 3, 2)),
        rng.normal([3, 3], 0.2, (n // 3, 2)),
        np.column_stack([np.linspace(0, 1.5, 12), np.linspace(0, -1.5, 12)]),
        rng.uniform(-4, 6, (n // 6, 2)),
        np.repeat([[5.0, -3.0]], copies, axis=0),
    ]
    x = np.round(np.vstack(parts), 3)
    order = rng.permutation(len(x))
    return pd.DataFrame({"id": np.arange(len(x)), "a": x[order, 0], "b": x[order, 1]})


def brute_dbscan(x, eps, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    current = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = current
        while stack:
            p = stack.pop()
            for q in np.flatnonzero(near[p]):
                if core[p] and label[q] < 0:
                    label[q] = current
                    if core[q]:
                        stack.append(q)
        current += 1
    return label


@pytest.mark.parametrize("eps,min_samples", [(0.25, 5), (0.6, 4), (0.1, 3)])
def test_dbscan_equals_brute_force(spark, eps, min_samples):
    pdf = points()
    df = spark.createDataFrame(pdf)
    got = dbscan.dbscan(df, "id", ["a", "b"], eps, min_samples).toPandas().sort_values("id")["cluster"].to_numpy()
    assert (got == brute_dbscan(pdf[["a", "b"]].to_numpy(), eps, min_samples)).all()
    assert len(set(got)) > 2


def test_dbscan_per_group_in_three_dimensions(spark, small_groups):
    rng = np.random.default_rng(5)
    frames = []
    for g in range(2):
        x = np.round(np.vstack([rng.normal(0, 0.4, (60, 3)), rng.normal(2, 0.3, (40, 3)), rng.uniform(-3, 4, (20, 3))]), 2)
        frames.append(pd.DataFrame(x, columns=list("abc")).assign(g=g))
    pdf = pd.concat(frames, ignore_index=True).rename_axis("id").reset_index()
    got = dbscan.dbscan(spark.createDataFrame(pdf), "id", ["a", "b", "c"], 0.5, 5, by=["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        mine = got[got.g == g].sort_values("id")["cluster"].to_numpy()
        assert (mine == brute_dbscan(part[["a", "b", "c"]].to_numpy(), 0.5, 5)).all()


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    edges = spark.createDataFrame(path + star, "u bigint, v bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(100, 161), *range(500, 560), 900]], "id bigint")
    got = {r["id"]: r["root"] for r in connected_components(nodes, edges).collect()}
    assert got == {i: (100 if i < 200 else 500 if i < 600 else 900) for i in got}
    assert len(got) == 122


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    kd = dist[:, -1]
    lrd = 1 / (np.maximum(kd[near], dist).mean(1) + 1e-10)
    return -(lrd[near].mean(1) / lrd)


def test_lof_equals_brute_force_over_many_cells(spark, monkeypatch):
    for name, value in (("LEAF", 12), ("FAN", 5), ("STORED_BLOCK", 9), ("ASKING_BLOCK", 9)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (120, 3)), rng.normal(6, 0.2, (60, 3)), [[20.0, 20, 20]]])
    pdf = pd.DataFrame(x, columns=list("abc")).rename_axis("id").reset_index()
    out = lof.local_outlier_factor(spark.createDataFrame(pdf), "id", list("abc"), 7, 0.1).toPandas().sort_values("id")
    assert np.allclose(out["score"], brute_lof(x, 7), atol=1e-9)
    assert out["score"].idxmin() == out.index[-1]
    assert abs(out["is_anomaly"].mean() - 0.1) < 0.02


def test_copies_count_as_neighbours(spark):
    pdf = points(copies=30)
    kd = lof.k_distances(spark.createDataFrame(pdf), "id", ["a", "b"], 5).toPandas().sort_values("id")
    x = pdf[["a", "b"]].to_numpy()
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)
    assert np.allclose(kd["k_distance"], d[:, 4])
    # a sixth of the rows are copies of one point
    scored = lof.local_outlier_factor(spark.createDataFrame(pdf), "id", ["a", "b"], 10).toPandas()
    assert len(scored) == len(pdf) and scored["score"].notna().all()


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 1, (600, 3)), rng.normal(0, 1, (6, 3)) + 12])
    pdf = pd.DataFrame(x, columns=list("abc")).rename_axis("id").reset_index()
    df = spark.createDataFrame(pdf)
    out = iforest.isolation_forest(df, "id", list("abc"), 0.1, trees=40, sample=64).toPandas()
    assert set(out.nsmallest(6, "score")["id"]) == set(range(600, 606))
    assert abs(out["is_anomaly"].sum() - 61) <= 2
    again = iforest.isolation_forest(df, "id", list("abc"), 0.1, trees=40, sample=64).toPandas()
    assert np.allclose(out.sort_values("id")["score"], again.sort_values("id")["score"])


def test_tree_samples_have_exact_size(spark):
    df = spark.range(5000).withColumn("a", F.col("id") * 1.0)
    sizes = iforest.tree_samples(df, "id", ["a"], 10, 32, 1).groupBy("tree").agg(F.count_distinct("id").alias("n")).collect()
    assert len(sizes) == 10 and all(r["n"] == 32 for r in sizes)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (300, 3))
    y = np.where(x[:, 0] + 0.3 * x[:, 1] < -0.5, 0, np.where(x[:, 0] + 0.3 * x[:, 1] < 0.5, 1, 2))
    pdf = pd.DataFrame(x, columns=list("abc")).assign(label=y, binary=(y == 2).astype(int)).rename_axis("id").reset_index()
    return classify.assemble(spark.createDataFrame(pdf), list("abc")).cache()


def accuracy(out, label):
    return out.agg(F.avg((F.col(label) == F.col("prediction")).cast("int"))).first()[0]


def test_three_class_models(spark, labelled):
    fitted = [
        classify.fit_logistic(labelled, "label", C=1.0, maxIter=50),
        classify.fit_forest(labelled, "label", numTrees=10, maxDepth=5),
        classify.fit_boosted(labelled, "label", 3, maxIter=5, maxDepth=3),
        classify.fit_naive_bayes(labelled, "label"),
    ]
    for f in [*fitted, classify.soft_voting(fitted[:3])]:
        out = f.score(labelled)
        assert accuracy(out, "label") > 0.75, f.name
        assert out.where(F.abs(F.aggregate("prob", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-6).isEmpty()
    svc = classify.fit_linear_margin(labelled, "binary", 2, maxIter=10)
    assert accuracy(svc.score(labelled), "binary") > 0.85


def test_logistic_penalty_matches_the_summed_loss_form(spark, labelled):
    """Newton steps on 0.5 |w|^2 + C * sum(loss) give the same coefficients."""
    pdf = labelled.select("a", "b", "c", "binary").toPandas()
    x, y = np.column_stack([np.ones(len(pdf)), pdf[["a", "b", "c"]].to_numpy()]), pdf["binary"].to_numpy()
    w, C = np.zeros(4), 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        pen = np.diag([0, 1, 1, 1.0])
        grad, hess = C * x.T @ (p - y) + pen @ w, C * x.T @ (x * (p * (1 - p))[:, None]) + pen
        w -= np.linalg.solve(hess, grad)
    model = classify.fit_logistic(labelled, "binary", C=C, maxIter=200).models[0]
    assert np.allclose(model.coefficients.toArray(), w[1:], atol=1e-3)


def test_importances_and_regression(spark, labelled):
    forest = classify.fit_forest(labelled, "label", numTrees=10, maxDepth=4)
    top = classify.importances(forest.models[0], list("abc"), 2).collect()
    assert top[0]["feature"] == "a" and len(top) == 2
    data = labelled.withColumn("y", F.col("a") * 3 + F.col("b")).withColumn("split", F.lit("train"))
    _, score = classify.fit_boosted_regression(data, "y", maxIter=10, maxDepth=3)
    assert classify.regression_report(score(data), "y").first()["r2"] > 0.9


def test_pca_reaches_the_share(spark, labelled):
    df = reduce.standardised(labelled.drop(classify.VECTOR).withColumn("d", F.col("a") * 2 + F.col("b") * 0.01), list("abcd"))
    model, needed, table = reduce.components_for(df, list("abcd"), 0.8)
    rows = table.collect()
    assert rows[needed - 1]["cumulative"] >= 0.8 and (needed == 1 or rows[needed - 2]["cumulative"] < 0.8)
    assert [r["kept"] for r in rows] == [i < needed for i in range(4)]
    z = reduce.project(model, df, 2).select("pc1", "pc2").toPandas()
    assert abs(z["pc1"].mean()) < 1e-9 and z["pc1"].var() >= z["pc2"].var()


def test_kmeans_keeps_the_best_start(spark):
    pdf = points()
    df = reduce.standardised(spark.createDataFrame(pdf), ["a", "b"])
    best = cluster.best_kmeans(df, 3, starts=4)
    costs = [cluster.best_kmeans(df, 3, starts=1, seed=42 + i).cost for i in range(4)]
    assert best.cost <= max(costs) + 1e-9
    sweep = cluster.sweep_k(df, [2, 3]).collect()
    assert sweep[0]["inertia"] >= sweep[1]["inertia"] and all(-1 <= r["silhouette"] <= 1 for r in sweep)


def test_models_and_scratch(spark, tmp_path, labelled):
    import os

    from pyspark.ml.feature import PCAModel

    from pulsegrid import session
    from pulsegrid.sources import sinks

    model = reduce.fit_pca(labelled, 2)
    path = sinks.save_model(model, str(tmp_path / "pca"))
    again = PCAModel.load(path)
    assert np.allclose(again.pc.toArray(), model.pc.toArray())
    frozen = session.freeze(spark.range(5))
    assert frozen.count() == 5
    folder = frozen.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    assert os.path.isdir(folder)
    session.clear_scratch(spark)
    assert not os.path.exists(folder)


def test_dbscan_group_named_like_internals_and_null_groups(spark):
    """A NULL group is clustered like any other, and the caller's names do not meet internal ones."""
    rng = np.random.default_rng(4)
    rows = []
    for g, name in enumerate(["p", None, "q"]):
        for k in range(30):
            centre = 10.0 * (k % 2)
            rows.append((100 * g + k, name, *(float(v) for v in centre + rng.normal(scale=0.05, size=6))))
        rows.append((100 * g + 99, name, *[50.0] * 6))
    rows.append((999, None, None, *[1.0] * 5))
    names = ["x", "m", "uid", "number", "cell", "near"]
    df = spark.createDataFrame(rows, "id int, `rows` string, " + ", ".join(f"{n} double" for n in names))
    from pulsegrid.ml.dbscan import dbscan

    got = {r["id"]: r["cluster"] for r in dbscan(df, "id", names, 1.0, 5, by=["rows"]).collect()}
    assert got == {r[0]: -1 if r[0] % 100 == 99 else r[0] % 100 % 2 for r in rows}


def test_experiment_grid_fits_whole_models(spark, monkeypatch, tmp_path):
    from pulsegrid.catalog import q_checks
    from pulsegrid.ml import grid

    n, day = 40, pd.Timestamp("2024-01-01")
    orders = pd.DataFrame({"o_orderkey": range(n), "o_totalprice": 1000.0, "o_orderdate": day})
    lines = pd.DataFrame({"l_orderkey": [k for k in range(n) for _ in range(1 + k % 7)], "l_quantity": 3.0, "l_extendedprice": 40_000.0, "l_discount": 0.1, "l_tax": 0.02, "l_shipdate": day})
    for name, rows in (("orders", orders), ("lineitem", lines)):
        spark.createDataFrame(rows).write.parquet(str(tmp_path / f"{name}.parquet"))

    class Ended(Exception):
        pass

    asked, goes = [], []

    def record(*a, **params):
        asked.append(params)

    def run_grid(rows, path, *, models, **settings):
        goes.append((rows.count(), sorted(models)))
        if len(goes) == 2:
            for name in ("boosted", "forest_binary", "forest_window", "logistic"):
                models[name].fit(rows, "label", None, 2)
            raise Ended

    monkeypatch.setattr(grid, "run_grid", run_grid)
    for name in ("fit_boosted", "fit_forest", "fit_logistic"):
        monkeypatch.setattr(classify, name, record)
    with pytest.raises(Ended):
        q_checks.m29_grid(spark, str(tmp_path))
    assert goes == [(n, ["boosted"]), (n, ["boosted", "forest_binary", "forest_window", "logistic"])]
    assert asked == [classify.REGULARISED["boosted"], classify.BINARY["forest"], classify.WINDOW["forest"], classify.REGULARISED["logistic"]]
