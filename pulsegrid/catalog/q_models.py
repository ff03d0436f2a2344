"""Clustering, anomaly, classification and regression jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.base import query, r, table
from pulsegrid.functions import transforms as tf
from pulsegrid.ml import classify, cluster, dbscan, iforest, lof, reduce
from pulsegrid.ml.fitted import class_weights
from pulsegrid.operators.split import random_split
from pulsegrid.session import freeze

FEATURES = ["lines", "quantity", "price", "discount", "tax", "late"]


def order_features(spark, d):
    """One row per order: line statistics and the total price as target."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    li = table(spark, d, "lineitem").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = li.groupBy("o_orderkey").agg(
        F.count("*").cast("double").alias("lines"),
        F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
        F.avg(F.datediff("l_shipdate", "o_orderdate")).alias("late"),
    )
    return lines.join(o.drop("o_orderdate"), "o_orderkey")


def training(spark, d, classes: int = 3):
    """Features scaled with training statistics, label and split, written once for the fits that follow."""
    # a price that depends on the features, so that there is something to learn
    target = F.col("price") + F.col("o_totalprice") / 4
    # read for the cuts, the split and the scales, so the join is done once
    data = freeze(order_features(spark, d).withColumn("target", target))
    if classes == 3:
        data = data.withColumn("label", tf.three_classes(F.col("target"), tf.tercile_cuts(data, "target", 0.33, 0.67)))
    else:
        data = tf.binary_drop_middle(data, "target", "label", tf.tercile_cuts(data, "target", 0.33, 0.67), strict=True)
    # read for the scales and the result
    data = freeze(random_split(data, "o_orderkey", "label"))
    scaled = tf.zscore(data, FEATURES, "_z", fit_on=data.where("split = 'train'"))
    out = classify.assemble(scaled, [f"{c}_z" for c in FEATURES])
    return freeze(out.select("o_orderkey", "label", "split", "target", classify.VECTOR))


def _scored(fitted, data):
    out = fitted.score(data)
    keep = ["o_orderkey", "label", "split", "prediction"]
    if "prob" in out.columns:
        return out.select(*keep, F.array_max("prob").alias("confidence"))
    return out.select(*keep)


def _train(data):
    return data.where("split = 'train'")


SET = classify.REGULARISED


@query("m18_logistic")
def m18(spark, d):
    data = training(spark, d)
    weights = class_weights(_train(data), "label").select("label", "weight")
    fitted = classify.fit_logistic(_train(data).join(weights, "label"), "label", "weight", **SET["logistic"])
    return _scored(fitted, data)


@query("m19_forest")
def m19(spark, d):
    data = training(spark, d)
    return _scored(classify.fit_forest(_train(data), "label", **SET["forest"]), data)


@query("m20_boosted_trees")
def m20(spark, d):
    data = training(spark, d)
    return _scored(classify.fit_boosted(_train(data), "label", 3, **SET["boosted"]), data)


@query("m21_linear_margin")
def m21(spark, d):
    data = training(spark, d)
    return _scored(classify.fit_linear_margin(_train(data), "label", 3), data)


@query("m22_naive_bayes")
def m22(spark, d):
    data = training(spark, d)
    return _scored(classify.fit_naive_bayes(_train(data), "label"), data)


def _members(data, classes):
    train = _train(data)
    return [
        classify.fit_logistic(train, "label", **SET["logistic"]),
        classify.fit_forest(train, "label", **SET["forest"]),
        classify.fit_boosted(train, "label", classes, **SET["boosted"]),
    ]


@query("m23_soft_voting")
def m23(spark, d):
    data = training(spark, d, classes=2)
    return _scored(classify.soft_voting(_members(data, 2)), data)


@query("m29_model_comparison")
def m29(spark, d):
    data = training(spark, d, classes=2)
    members = _members(data, 2)
    fitted = [*members, classify.soft_voting(members), classify.fit_naive_bayes(_train(data), "label")]
    scored = {f.name: f.score(data) for f in fitted}
    rows = classify.compare(scored, "label", [0, 1])
    return rows.orderBy(F.col("split") != "test", F.col("f1_macro").desc(), "model")


@query("m31_boosted_regression")
def m31(spark, d):
    data = training(spark, d).withColumn("target", F.col("target") / 1000)
    _, score = classify.fit_boosted_regression(_train(data), "target")
    return classify.regression_report(score(data), "target")


@query("m32_feature_importance")
def m32(spark, d):
    data = training(spark, d)
    fitted = classify.fit_forest(_train(data), "label", **SET["forest"])
    return classify.importances(fitted.models[0], FEATURES, 10)


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("m05_pca_variance")
def m05(spark, d):
    li = reduce.standardised(table(spark, d, "lineitem").select(*LINE), LINE)
    _, needed, variance = reduce.components_for(li, LINE, 0.80)
    return variance.withColumn("needed", F.lit(needed))


@query("m06_pca_projection")
def m06(spark, d):
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    li = reduce.standardised(table(spark, d, "lineitem").select(*keys, *LINE), LINE)
    model = reduce.fit_pca(li, 2)
    return reduce.project(model, li, 2).select(*keys, "pc1", "pc2")


def profiles(spark, d):
    """One row per supplier: mean and std of its lines, scaled."""
    li = table(spark, d, "lineitem")
    p = li.groupBy("l_suppkey").agg(
        *[f(c).alias(f"{c}_{n}") for c in LINE for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    ).na.fill(0.0)
    names = [c for c in p.columns if c != "l_suppkey"]
    return reduce.standardised(p, names)


@query("m07_kmeans_profiles")
def m07(spark, d):
    p = profiles(spark, d)
    return cluster.best_kmeans(p, 3, starts=20).transform(p, classify.VECTOR).select("l_suppkey", "cluster")


@query("m08_k_sweep")
def m08(spark, d):
    return cluster.sweep_k(profiles(spark, d), range(2, 11), starts=20)


def _responses(spark, d):
    """Two positive measures per order, as the two sliders of a response."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b")
    )
    return li


def _dbscan_sql(rows: str, eps: float, min_samples: int, features: str = "ab") -> str:
    """Neighbour counts, core links and components by smallest reachable id, from all close pairs."""
    square = " + ".join(f"(a.{c} - b.{c}) ** 2" for c in features)
    return f"""WITH RECURSIVE z AS ({rows}), pair AS MATERIALIZED (SELECT a.row_id AS p, b.row_id AS q FROM z a JOIN z b ON
    a.g = b.g AND b.a BETWEEN a.a - {eps} AND a.a + {eps} AND {square} <= {eps}::DOUBLE ** 2),
    core AS MATERIALIZED (SELECT p AS id FROM pair GROUP BY p HAVING count(*) >= {min_samples}),
    link AS MATERIALIZED (SELECT p, q FROM pair WHERE p <> q AND p IN (SELECT id FROM core) AND q IN (SELECT id FROM core)),
    cc(id, comp) USING KEY (id) AS (SELECT id, id FROM core UNION (SELECT u.id, min(v.comp) FROM recurring.cc u JOIN link ON
    link.p = u.id JOIN cc v ON v.id = link.q WHERE v.comp < u.comp GROUP BY u.id)),
    num AS (SELECT comp, CAST(row_number() OVER (PARTITION BY g ORDER BY comp) - 1 AS INTEGER) AS n FROM (SELECT DISTINCT
    comp, g FROM cc JOIN z ON z.row_id = cc.comp)), lab AS (SELECT id, n FROM cc JOIN num USING (comp)),
    edge AS (SELECT p AS id, min(n) AS n FROM pair JOIN lab ON lab.id = pair.q WHERE p NOT IN (SELECT id FROM core) GROUP BY p)
    SELECT z.row_id, {{extra}}coalesce(lab.n, edge.n, -1) AS cluster FROM z LEFT JOIN lab ON lab.id = z.row_id LEFT JOIN edge ON
    edge.id = z.row_id"""


_ORDERS = """SELECT l_orderkey AS row_id, 0 AS g, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) /
    stddev_pop(b) OVER () AS b FROM (SELECT l_orderkey, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem GROUP BY 1)"""
_HOURS = """SELECT event_id AS row_id, event_type AS g, (hour(ts) - avg(hour(ts)) OVER w) / stddev_pop(hour(ts)) OVER w AS a,
    (value - avg(value) OVER w) / stddev_pop(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY event_type)"""


@query("m11_dbscan", _dbscan_sql(_ORDERS, 0.2, 5).format(extra=""))
def m11(spark, d):
    z = dbscan.zscore_by(_responses(spark, d), [], ["a", "b"])
    return dbscan.dbscan(z, "row_id", ["a_z", "b_z"], 0.2, 5).select("row_id", "cluster")


_PART = ("count(*)", "avg(l_quantity)", "avg(l_extendedprice)", "avg(l_discount)", "avg(l_tax)", "max(l_quantity)")
_PARTS = f"""SELECT row_id, 0 AS g, {", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in "abcdef")}
    FROM (SELECT l_partkey AS row_id, {", ".join(f"{e} AS {c}" for e, c in zip(_PART, "abcdef"))} FROM lineitem GROUP BY 1)"""


@query("m11_dbscan_six_features", _dbscan_sql(_PARTS, 1.3, 5, "abcdef").format(extra=""))
def m11_six(spark, d):
    """Parts by six measures of their lines."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row_id")).agg(
        *[F.expr(e).cast("double").alias(c) for e, c in zip(_PART, "abcdef")]
    )
    z = dbscan.zscore_by(rows, [], list("abcdef"))
    return dbscan.dbscan(z, "row_id", [f"{c}_z" for c in "abcdef"], 1.3, 5).select("row_id", "cluster")


@query("m11_dbscan_per_group", _dbscan_sql(_HOURS, 0.15, 5).format(extra="g AS event_type, "))
def m11_group(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("row_id"), "event_type", F.hour("ts").alias("h"), "value")
    z = dbscan.zscore_by(e, ["event_type"], ["h", "value"])
    return dbscan.dbscan(z, "row_id", ["h_z", "value_z"], 0.15, 5, by=["event_type"]).select("row_id", "event_type", "cluster")


DIMENSIONS = 64


def vectors(spark, d):
    """All coordinates of the embeddings as columns."""
    v = table(spark, d, "embeddings")
    cols = [f"x{i}" for i in range(DIMENSIONS)]
    return v.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


_PAIRS = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id
    AS v, list_distance(a.x, b.x) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id)"""


def _lof_sql(k: int, name: str = "") -> str:
    return f"""n{name} AS (SELECT q, v, dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, v) AS k FROM p)
    WHERE k <= {k}), kd{name} AS (SELECT q, max(dist) AS kd FROM n{name} GROUP BY q), lrd{name} AS (SELECT n.q, 1 /
    (avg(greatest(kd, dist)) + 1e-10) AS lrd FROM n{name} n JOIN kd{name} k ON n.v = k.q GROUP BY n.q), s{name} AS (SELECT n.q
    AS vec_id, -avg(b.lrd) / any_value(a.lrd) AS score FROM n{name} n JOIN lrd{name} a ON a.q = n.q JOIN lrd{name} b ON b.q =
    n.v GROUP BY n.q), f{name} AS (SELECT *, CAST(score < (SELECT quantile_cont(score, 0.1) FROM s{name}) AS INTEGER) AS
    is_anomaly FROM s{name})"""


@query(
    "m14_local_outlier_factor",
    f"WITH {_PAIRS}, {_lof_sql(20)} SELECT vec_id, {r('score')} AS score, is_anomaly, 1 - 2 * is_anomaly AS anomaly FROM f",
)
def m14(spark, d):
    v, cols = vectors(spark, d)
    out = lof.local_outlier_factor(v, "vec_id", cols, 20, 0.1)
    return out.select("vec_id", "score", "is_anomaly", "anomaly")


_KS = (5, 10, 20, 30, 50)


@query(
    "m14_neighbour_sweep",
    f"WITH {_PAIRS}, "
    + ", ".join(_lof_sql(k, str(k)) for k in _KS)
    + " "
    + " UNION ALL ".join(
        f"SELECT {k} AS k, CAST(sum(is_anomaly) AS BIGINT) AS anomalies, {r('avg(is_anomaly) * 100')} AS rate_pct, "
        f"{r('avg(score) FILTER (is_anomaly = 0)')} AS mean_normal, {r('avg(score) FILTER (is_anomaly = 1)')} AS mean_anomaly "
        f"FROM f{k}"
        for k in _KS
    ),
)
def m14_sweep(spark, d):
    v, cols = vectors(spark, d)
    return lof.lof_sweep(v, "vec_id", cols, _KS)


@query(
    "m12_k_distance",
    f"""WITH {_PAIRS}, k AS (SELECT q, dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist) AS k FROM p)
    WHERE k = 4) SELECT q AS vec_id, {r('dist')} AS k_distance, {r('(SELECT quantile_cont(dist, 0.9) FROM k)')} AS eps FROM k""",
)
def m12(spark, d):
    from pulsegrid.plans.quantile import column_quantiles

    v, cols = vectors(spark, d)
    kd = lof.k_distances(v, "vec_id", cols, 5).select("vec_id", "k_distance")
    eps = column_quantiles(kd, ["k_distance"], {"q": 0.9})["k_distance"]["q"]
    return kd.withColumn("eps", F.lit(eps))


@query("m15_isolation_forest")
def m15(spark, d):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    li = table(spark, d, "lineitem").withColumn("row_id", F.xxhash64(*keys, *LINE))
    scored = iforest.isolation_forest(li.select("row_id", *keys, *LINE), "row_id", LINE, 0.1)
    return scored.select("row_id", "score", "is_anomaly", "anomaly")
