"""The ball tree against all pairs, what a search looks into, silhouettes and K-means side by side."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pulsegrid.ml import classify, cluster, dbscan, iforest, kernel, kmeans, lof
from pulsegrid.plans import knn, sample
from pulsegrid.session import freeze


def clustered(n=3000, groups=25, width=6, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.uniform(-40, 40, (groups, width))
    x = centres[draw.integers(0, groups, n)] + draw.normal(0, 0.6, (n, width))
    return np.round(x, 6)


def points(spark, x, copies=()):
    rows = pd.DataFrame({f"f{i}": x[:, i] for i in range(x.shape[1])})
    rows["id"] = np.arange(len(x))
    if len(copies):
        rows = pd.concat([rows, rows.iloc[list(copies)].assign(id=np.arange(len(copies)) + len(x))])
    return spark.createDataFrame(rows), [f"f{i}" for i in range(x.shape[1])]


@pytest.fixture
def small_leaves(monkeypatch):
    """Several levels with few points."""
    monkeypatch.setattr(knn, "LEAF", 40)
    monkeypatch.setattr(knn, "FAN", 6)
    monkeypatch.setattr(knn, "STORED_BLOCK", 32)
    monkeypatch.setattr(knn, "ASKING_BLOCK", 16)


def test_nearest_equals_all_pairs_and_looks_into_few_leaves(spark, small_leaves):
    x = clustered()
    df, cols = points(spark, x)
    folded = knn.fold_points(df, "id", cols)
    found, asked = knn.search(folded, 5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in found.collect():
        got.setdefault(r["uid"], []).append((r["dist"], r["v"]))
    assert len(got) == len(x)
    for i, near in got.items():
        want = sorted((d[i, j], j) for j in np.argpartition(d[i], 12)[:12])[:5]
        assert [j for _, j in sorted(near)] == [j for _, j in want]
    tree = knn.build(folded, 5)
    leaves, depth = tree.placed.select("leaf").distinct().count(), len(tree.nodes)
    visited = asked.groupBy("uid").count().agg(F.avg("count"), F.max("count")).first()
    print(f"{leaves} leaves on {depth} levels, {visited[0]:.1f} looked into per point, {visited[1]} at most")
    assert depth >= 3 and leaves > 80 and visited[0] < leaves / 8


def test_points_without_structure_meet_in_blocks(spark, small_leaves):
    x = np.random.default_rng(6).normal(size=(900, 24))
    df, cols = points(spark, x)
    found, asked = knn.search(knn.fold_points(df, "id", cols), 7)
    # no row per point and leaf
    assert asked.count() == len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in found.collect():
        got.setdefault(r["uid"], set()).add(r["v"])
    assert got == {i: set(np.argsort(d[i], kind="stable")[:7].tolist()) for i in range(len(x))}


def test_nearest_far_from_the_origin_and_at_equal_distances():
    rng = np.random.default_rng(8)
    x = 1e6 + rng.integers(0, 6, (700, 3)).astype(float)
    ids, bound = rng.permutation(700), np.full(700, np.inf)
    row, col, dist = knn._first_k(x, x, ids, ids, bound, 5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(700):
        want = sorted((d[i, j], ids[j]) for j in range(700) if j != i)[:5]
        assert [(a, ids[b]) for a, b in zip(dist[row == i], col[row == i])] == want


def test_pairs_within_a_radius(spark, small_leaves):
    x = clustered(900, 12, 5)
    df, cols = points(spark, x)
    folded = knn.fold_points(df, "id", cols).withColumn("g", (F.col("uid") % 2).cast("string"))
    asking = folded.where("uid % 3 = 0").select("g", "uid")
    got = {(r["q"], r["uid"]) for r in knn.pairs_within(folded, 1.5, asking).collect()}
    close = ((x[:, None] - x[None]) ** 2).sum(2) <= 1.5**2
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(close)) if i % 3 == 0 and i % 2 == j % 2}


def test_points_at_one_distance_and_single_points(spark, small_leaves):
    x = np.vstack([np.eye(60) * 3, np.zeros((1, 60))])
    df, cols = points(spark, x, copies=[0] * 30)
    folded = knn.fold_points(df, "id", cols)
    near = knn.nearest(folded, 3).groupBy("uid").count().collect()
    assert len(near) == 61 and all(r["count"] >= 3 for r in near)
    assert knn.nearest(folded.limit(1), 3).count() == 0 and knn.nearest(folded.limit(0), 3).count() == 0
    assert knn.pairs_within(folded.limit(0), 1.0).count() == 0


def test_dbscan_in_many_features(spark, small_leaves):
    from test_learning import brute_dbscan

    x = np.vstack([clustered(500, 6, 7, 9), np.random.default_rng(4).uniform(-40, 40, (40, 7))])
    df, cols = points(spark, x)
    got = dbscan.dbscan(df, "id", cols, 1.6, 4).toPandas().sort_values("id")["cluster"].to_numpy()
    assert (got == brute_dbscan(x, 1.6, 4)).all() and len(set(got)) > 5

def test_dbscan_searches_share_a_tree_and_few_points_need_none(spark, small_leaves, monkeypatch):
    from test_learning import brute_dbscan

    built, build = [], knn.build
    monkeypatch.setattr(dbscan, "build", lambda *a: built.append(1) or build(*a), raising=False)
    monkeypatch.setattr(knn, "build", lambda *a: built.append(1) or build(*a))
    tight = np.round(np.random.default_rng(12).uniform(0.1, 0.3, (900, 5)), 6)
    # one full cell with a few points around it; as many points that look for others as there are
    for x, trees in ((np.vstack([tight, tight[:3] + 0.65, tight[:2] + 20]), 0), (clustered(1500, 30, 5, 4), 1)):
        built.clear()
        df, cols = points(spark, x)
        got = dbscan.dbscan(df, "id", cols, 1.6, 4).toPandas().sort_values("id")["cluster"].to_numpy()
        assert (got == brute_dbscan(x, 1.6, 4)).all() and len(set(got)) > 1
        assert len(built) == trees


def test_dbscan_of_figures_that_come_out_otherwise_each_time(spark):
    import random

    # as averages do whose rows arrive in another order
    shaken = F.udf(lambda v: v + random.uniform(0, 1e-9), "double").asNondeterministic()
    cols = [f"f{i}" for i in range(5)]
    for names in (cols[:2], cols):
        df = spark.range(60).select("id", *[shaken((F.col("id") % 3).cast("double")).alias(c) for c in names])
        got = {r["id"]: r["cluster"] for r in dbscan.dbscan(df, "id", names, 0.5, 5).collect()}
        assert got == {i: i % 3 for i in range(60)}


def test_links_leave_a_task_as_a_forest():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (300, 5)), rng.normal(30, 1, (200, 5))])
    side = pa.table({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "m": np.arange(500) // 2})
    links = dbscan._forest(side, side, 2.5).to_pylist()
    close = ((x[:, None] - x[None]) ** 2).sum(2) <= 2.5**2
    parts = [{k} for k in range(250)]
    for pairs in ([(i // 2, j // 2) for i, j in zip(*np.nonzero(close))], [(p["u"], p["v"]) for p in links]):
        own = list(range(250))
        for u, v in pairs:
            if own[u] != own[v]:
                a, b = sorted((own[u], own[v]))
                own = [a if o == b else o for o in own]
        parts.append(own)
    assert parts[-1] == parts[-2] and len(links) < 250 < close.sum()


def test_rows_without_all_features_have_no_score(spark):
    df, cols = points(spark, clustered(200, 4, 2))
    holes = df.withColumn("f0", F.when(F.col("id") % 20 != 0, F.col("f0"))).withColumn("f1", F.when(F.col("id") % 20 == 1, float("nan")).otherwise(F.col("f1")))
    got = lof.local_outlier_factor(holes, "id", cols, 5, 0.1)
    none = got.where("score is null")
    assert got.count() == 200 and none.count() == 20
    assert none.where("is_anomaly is not null or anomaly is not null").count() == 0
    whole = lof.local_outlier_factor(df.where("id % 20 > 1"), "id", cols, 5, 0.1)
    assert {(r["id"], r["score"]) for r in whole.collect()} == {(r["id"], r["score"]) for r in got.where("score is not null").collect()}


# silhouettes


def plain_silhouette(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = (k == k[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, k == c].mean() for c in set(k) if c != k[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(out)


def test_exact_silhouette_whatever_the_blocks(spark, monkeypatch):
    x = clustered(160, 5, 3)
    k = np.concatenate([np.zeros(70), np.arange(1, 31), np.repeat([100, 101, 102], 20)]).astype(int)
    df, cols = points(spark, x)
    df = df.withColumn("k", F.element_at(F.lit([int(v) for v in k]), (F.col("id") + 1).cast("int")))
    want = plain_silhouette(x, k)
    for block in (4, 37, 1024):
        monkeypatch.setattr(cluster, "PAIR_BLOCK", block)
        got = cluster.silhouette(df, "k", cols).first()
        assert (got["clusters"], got["rows"]) == (34, 160) and got["silhouette"] == pytest.approx(want, rel=1e-9)
    odd = df.withColumn("k", F.when(F.col("id") > 3, F.col("k"))).withColumn("f0", F.when(F.col("id") != 10, F.col("f0")))
    keep = (np.arange(160) > 3) & (np.arange(160) != 10)
    assert cluster.silhouette(odd, "k", cols).first()["silhouette"] == pytest.approx(plain_silhouette(x[keep], k[keep]), rel=1e-9)
    assert cluster.silhouette(df.where("k = 0"), "k", cols).first()["silhouette"] is None
    assert cluster.silhouette(df.limit(0), "k", cols).first()["rows"] == 0


# K-means


def vectors(spark, x):
    return spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["id", classify.VECTOR])


def test_all_runs_share_their_reads(spark, monkeypatch):
    x = clustered(400, 4, 3)
    df = vectors(spark, x)
    reads, sums = [], kmeans._sums
    monkeypatch.setattr(kmeans, "_sums", lambda rows, width, centres: reads.append(set(centres)) or sums(rows, width, centres))
    rows = kmeans.array_rows(df, classify.VECTOR)
    runs = {i: 2 + i % 4 for i in range(24)}
    start = kmeans.seeded(rows, runs, 1)
    assert len(reads) == 1 and all(len(start[r]) == k for r, k in runs.items())
    reads.clear()
    fits = kmeans.lloyd(rows, start)
    assert len(reads) == max(f.rounds for f in fits.values()) and len(reads[-1]) < len(runs)
    for run, fit in fits.items():
        own = ((x[:, None] - fit.centres[None]) ** 2).sum(2).argmin(1)
        for c in range(runs[run]):
            assert fit.centres[c] == pytest.approx(x[own == c].mean(0), abs=1e-6)
        assert fit.cost == pytest.approx(((x - fit.centres[own]) ** 2).sum(), rel=1e-9)
    again = kmeans.seeded(rows.repartition(5), runs, 1)
    assert all((start[r] == again[r]).all() for r in runs)


def test_best_of_many_starts_finds_the_groups(spark):
    x = clustered(600, 5, 4)
    best, rows = kmeans.fit_all(vectors(spark, x), classify.VECTOR, [5, 6], 10)
    from_centres = ((x[:, None] - best[5].centres[None]) ** 2).sum(2).min(1)
    assert np.sqrt(from_centres).max() < 6
    got = kmeans.mean_silhouettes(rows, best)
    own = ((x[:, None] - best[5].centres[None]) ** 2).sum(2).argmin(1)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i in range(len(x)):
        a = d2[i, own == own[i]].sum() / max((own == own[i]).sum() - 1, 1)
        b = min(d2[i, own == c].mean() for c in range(5) if c != own[i])
        s.append((b - a) / max(a, b))
    assert got[5] == pytest.approx(np.mean(s), rel=1e-9) and got[5] > 0.9


def test_kmeans_of_copies_and_few_rows(spark):
    x = np.array([[1.0, 1.0]] * 50 + [[2.0, 2.0]])
    best, _ = kmeans.fit_all(vectors(spark, x), classify.VECTOR, [2, 4], 3)
    assert best[2].cost == 0 and sorted(best[2].centres[:, 0]) == [1.0, 2.0] and best[4].cost == 0
    with pytest.raises(ValueError, match="no rows"):
        kmeans.fit_all(vectors(spark, x).limit(0), classify.VECTOR, [2], 1)


# samples


def test_bottom_k_is_one_read_and_exact(spark):
    df = spark.range(0, 5000, 1, 9).select("id", F.xxhash64("id").alias("h"), F.array(F.col("id").cast("double")).alias("x"))
    got = sample.bottom_k(df, "h", ["id", "x"], 20, 64).toPandas()
    assert got.groupby("draw")["id"].nunique().tolist() == [64] * 20
    assert (got["x"].str[0] == got["id"]).all()
    h = df.toPandas().set_index("id")["h"].to_numpy()
    for draw, part in got.groupby("draw"):
        want = np.argsort(sample.mixed(h, draw), kind="stable")[:64]
        assert set(part["id"]) == set(want.tolist())
    assert sample.bottom_k(df.limit(10), "h", ["id"], 3, 64).groupBy("draw").count().collect()[0]["count"] == 10
    assert sample.bottom_k(df.limit(0), "h", ["id"], 3, 64).count() == 0
    # every row is drawn about equally often
    many = sample.bottom_k(df.where("id < 100"), "h", ["id"], 400, 25).groupBy("id").count().toPandas()["count"]
    assert len(many) == 100 and many.between(60, 140).all()


def test_forest_reads_the_table_once_before_scoring(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(iforest, "bottom_k", lambda *a: calls.append(a) or sample.bottom_k(*a))
    df = spark.range(600).select("id", (F.col("id") % 17).cast("double").alias("a"), F.rand(3).alias("b"))
    forest = iforest.fit_forest(df, "id", ["a", "b"], 12, 64)
    assert len(calls) == 1 and len(forest["trees"]) == 12 and forest["depth"] == 6


# kernel


def test_kernel_margin_tells_a_ring_from_its_middle(spark):
    draw = np.random.default_rng(5)
    angle, label = draw.uniform(0, 2 * np.pi, 800), np.arange(800) % 2
    radius = np.where(label == 1, draw.uniform(2, 3, 800), draw.uniform(0, 1.4, 800))
    rows = [(int(y), Vectors.dense([r * np.cos(a), r * np.sin(a)])) for y, r, a in zip(label, radius, angle)]
    df = spark.createDataFrame(rows, ["label", classify.VECTOR])
    straight = classify.fit_linear_margin(df, "label").score(df).where("prediction = label").count()
    bent = kernel.fit_kernel_margin(df, "label").score(df)
    assert straight < 0.75 * 800 and bent.where("prediction = label").count() >= 0.95 * 800
    prob = bent.select("prob", "label").toPandas()
    assert np.allclose(prob["prob"].str[0] + prob["prob"].str[1], 1) and prob.groupby("label")["prob"].apply(lambda p: p.str[1].mean()).diff()[1] > 0.7


def test_kernel_margin_writes_no_mapped_rows_and_maps_on_even_partitions(spark, monkeypatch):
    written = []
    monkeypatch.setattr(kernel, "TASK_VALUES", 32 * 100)
    monkeypatch.setattr(kernel, "freeze", lambda df: written.append(df) or freeze(df))
    x = np.random.default_rng(8).normal(size=(1000, 2))
    rows = [(i, int(v @ v < 1.3), Vectors.dense(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "label", classify.VECTOR]).coalesce(1)
    out = kernel.fit_kernel_margin(df, "label", components=32, gamma=1.0, regParam=1e-4, maxIter=20).score(df)
    # the rows as they are (two values each) and their margins; no row of 32 values
    assert len(written) == 2 and max(len(r["__x"]) for r in written[0].select("__x").collect()) == 2
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 110
    assert out.select("id").distinct().count() == 1000 and out.where("prediction = label").count() >= 900


def test_platt_meets_a_known_logistic_curve(spark):
    draw = np.random.default_rng(6)
    f = draw.normal(0, 2, 20_000)
    y = draw.random(20_000) < 1 / (1 + np.exp(-(1.7 * f - 0.6)))
    a, b = kernel.platt(spark.createDataFrame(pd.DataFrame({"f": f, "y": y})), "f", F.col("y"))
    assert a == pytest.approx(-1.7, abs=0.08) and b == pytest.approx(0.6, abs=0.08)
    apart = spark.createDataFrame([(float(v), v > 0) for v in range(-5, 6)], "f double, y boolean")
    a, b = kernel.platt(apart, "f", F.col("y"))
    assert np.isfinite([a, b]).all() and a < 0


def test_fourier_features_estimate_the_kernel():
    draw = np.random.default_rng(7)
    made = kernel.FourierMap.drawn(3, 0.4, 20_000, 1)
    x, y = draw.normal(size=3), draw.normal(size=3)
    z = [np.sqrt(2 / 20_000) * np.cos(made.directions @ v + made.offsets) for v in (x, y)]
    assert z[0] @ z[1] == pytest.approx(np.exp(-0.4 * ((x - y) ** 2).sum()), abs=0.03)


def test_copies_meet_once_in_a_silhouette(spark):
    x = np.random.default_rng(12).normal(size=(60, 2))
    k = np.arange(60) % 3
    df, cols = points(spark, np.repeat(x, 4, axis=0))
    df = df.withColumn("k", F.element_at(F.array(*[F.lit(int(v)) for v in np.repeat(k, 4)]), (F.col("id") + 1).cast("int")))
    got = cluster.silhouette(df, "k", cols).first()
    assert got["rows"] == 240 and got["silhouette"] == pytest.approx(plain_silhouette(np.repeat(x, 4, axis=0), np.repeat(k, 4)), rel=1e-9)


def test_trees_grow_on_even_partitions(spark, monkeypatch):
    monkeypatch.setattr(classify, "TREE_ROWS", 100)
    df = spark.range(1000).coalesce(1)
    sizes = [r["count"] for r in classify._spread(df).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 110
    even = spark.range(0, 1000, 1, 10)
    assert classify._spread(even) is even
