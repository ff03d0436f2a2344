"""Splits, fitted statistics, metrics and cluster reports on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.base import WIDE, events, query, r, table, wide
from pulsegrid.ml import cluster, fitted, metrics
from pulsegrid.operators import split
from pulsegrid.operators.sets import union_all, union_labelled

LABELS = [0, 1, 2]
SCORES = {0: "p0", 1: "p1", 2: "p2"}


def scored(spark, d):
    """Orders with a class, three pseudo-probabilities made of the keys, and their largest."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = table(spark, d, "orders").select(
        "o_orderkey",
        (c % 3).cast("int").alias("label"),
        (((k * 7919) % 1009) / 1009 + 0.001).alias("s0"),
        (((k * 104729) % 1013) / 1013 + 0.001).alias("s1"),
        (((c * 31) % 97) / 97 + 0.001).alias("s2"),
        F.when(k % 4 == 0, "test").otherwise("train").alias("split"),
    )
    total = F.col("s0") + F.col("s1") + F.col("s2")
    probs = raw.select("o_orderkey", "label", "split", *[(F.col(f"s{i}") / total).alias(f"p{i}") for i in LABELS])
    best = F.greatest("p0", "p1", "p2")
    return probs.withColumn("prediction", F.when(F.col("p0") == best, 0).when(F.col("p1") == best, 1).otherwise(2))


SCORED = """raw AS (SELECT o_orderkey, CAST(o_custkey % 3 AS INTEGER) AS label, ((o_orderkey * 7919) % 1009) / 1009::DOUBLE +
    0.001::DOUBLE AS s0, ((o_orderkey * 104729) % 1013) / 1013::DOUBLE + 0.001::DOUBLE AS s1, ((o_custkey * 31) % 97) /
    97::DOUBLE + 0.001::DOUBLE AS s2, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM orders),
    scored AS (SELECT *, CASE WHEN p0 = greatest(p0, p1, p2) THEN 0 WHEN p1 = greatest(p0, p1, p2) THEN 1 ELSE 2 END AS
    prediction FROM (SELECT o_orderkey, label, split, s0 / (s0 + s1 + s2) AS p0, s1 / (s0 + s1 + s2) AS p1,
    s2 / (s0 + s1 + s2) AS p2 FROM raw))"""
CONFUSION = """grid AS (SELECT sp.split, a.x AS label, b.x AS prediction FROM (SELECT DISTINCT split FROM scored) sp,
    (VALUES (0), (1), (2)) a(x), (VALUES (0), (1), (2)) b(x)), conf AS (SELECT g.split, g.label, g.prediction, count(s.label)
    AS rows FROM grid g LEFT JOIN scored s ON s.split = g.split AND s.label = g.label AND s.prediction = g.prediction
    GROUP BY ALL)"""
PER_CLASS = """pc AS (SELECT split, k AS label, sum(rows) FILTER (label = k) AS support, sum(rows) FILTER (label = k AND
    prediction = k) AS tp, sum(rows) FILTER (prediction = k) AS predicted FROM conf, (VALUES (0), (1), (2)) c(k) GROUP BY
    split, k), m AS (SELECT split, label, CAST(support AS BIGINT) AS support, coalesce(tp / nullif(predicted, 0), 0) AS p,
    coalesce(tp / nullif(support, 0), 0) AS rec FROM pc), f AS (SELECT *, coalesce(2 * p * rec / nullif(p + rec, 0), 0) AS f1
    FROM m)"""
LONG = """long AS (SELECT 0 AS class, CAST(label = 0 AS INTEGER) AS positive, p0 AS score FROM scored UNION ALL SELECT 1,
    CAST(label = 1 AS INTEGER), p1 FROM scored UNION ALL SELECT 2, CAST(label = 2 AS INTEGER), p2 FROM scored)"""


def _split(spark, d):
    w = wide(spark, d).select("event_id", "user_id", "ts", "hr_mean", "sleep_max")
    return split.chronological_split(w, ["ts", "event_id"])


TRAIN = f"""{WIDE}, k AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.7::DOUBLE) AS train
    FROM wide)"""


def _random_sql(kind: str, partition: str, train: float, val: float) -> str:
    return f"""SELECT o_orderkey, o_orderstatus, CASE WHEN k <= floor(n * {train}::DOUBLE) THEN 'train' WHEN k <=
    floor(n * {train}::DOUBLE) + floor(n * {val}::DOUBLE) THEN 'val' ELSE 'test' END AS split, '{kind}' AS kind FROM (SELECT
    o_orderkey, o_orderstatus, count(*) OVER ({partition}) AS n, row_number() OVER ({partition} ORDER BY
    md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders)"""


@query(
    "m01_random_split",
    _random_sql("stratified", "PARTITION BY o_orderstatus", 0.70, 0.15) + " UNION ALL " + _random_sql("plain", "", 0.8, 0.0),
)
def m01(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    stratified = split.random_split(o, "o_orderkey", "o_orderstatus")
    plain = split.random_split(o, "o_orderkey", train=0.8, val=0.0)
    return union_labelled({"stratified": stratified, "plain": plain}, "kind")


@query(
    "m01_split_sizes",
    """WITH s AS (SELECT o_orderstatus, count(*) AS n, CAST(floor(count(*) * 0.7::DOUBLE) AS BIGINT) AS a,
    CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS b FROM orders GROUP BY 1) SELECT o_orderstatus, 'train' AS split, a AS
    rows FROM s UNION ALL SELECT o_orderstatus, 'val', b FROM s UNION ALL SELECT o_orderstatus, 'test', n - a - b FROM s""",
)
def m01_sizes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    out = split.random_split(o, "o_orderkey", "o_orderstatus")
    return out.groupBy("o_orderstatus", "split").agg(F.count("*").alias("rows"))


@query(
    "m02_train_imputer",
    f"""WITH {TRAIN} SELECT event_id, {r('coalesce(hr_mean, (SELECT median(hr_mean) FROM k WHERE train))')} AS hr_mean,
    {r('coalesce(sleep_max, (SELECT median(sleep_max) FROM k WHERE train))')} AS sleep_max FROM k""",
)
def m02(spark, d):
    data = _split(spark, d)
    fit = fitted.fit_statistics(data.where("split = 'train'"), ["hr_mean", "sleep_max"])
    return fitted.apply_imputer(data, fit).select("event_id", "hr_mean", "sleep_max")


@query(
    "m03_train_scaler",
    f"""WITH {TRAIN}, f AS (SELECT avg(hr_mean) AS m, stddev_pop(hr_mean) AS s, avg(sleep_max) AS m2, stddev_pop(sleep_max)
    AS s2 FROM k WHERE train) SELECT event_id, {r('(hr_mean - m) / s')} AS hr_mean, {r('(sleep_max - m2) / s2')} AS sleep_max
    FROM k, f""",
)
def m03(spark, d):
    data = _split(spark, d)
    fit = fitted.fit_statistics(data.where("split = 'train'"), ["hr_mean", "sleep_max"])
    return fitted.apply_scaler(data, fit).select("event_id", "hr_mean", "sleep_max")


@query(
    "m04_train_baselines",
    f"""WITH {TRAIN}, b AS (SELECT user_id, avg(sleep_max) AS b FROM k WHERE train AND user_id % 5 <> 0 GROUP BY user_id),
    j AS (SELECT event_id, sleep_max AS x, coalesce(b, (SELECT avg(b) FROM b)) AS base FROM k LEFT JOIN b USING (user_id))
    SELECT event_id, {r('base')} AS baseline, {r('(x - base) / (base + 1e-6)')} AS sleep_max_deviation,
    {r('x / (base + 1)')} AS sleep_max_ratio FROM j""",
)
def m04(spark, d):
    data = _split(spark, d)
    # every fifth user is unseen in training
    seen = data.where("split = 'train' and user_id % 5 <> 0")
    cols = {"sleep_max": "baseline"}
    out = fitted.add_baselines(data, fitted.train_baselines(seen, "user_id", cols), "user_id", cols)
    return out.select("event_id", "baseline", "sleep_max_deviation", "sleep_max_ratio")


@query(
    "m24_class_weights",
    f"""WITH c AS (SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1) SELECT o_orderstatus, rows,
    {r('(SELECT sum(rows) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * rows)')} AS weight FROM c""",
)
def m24(spark, d):
    return fitted.class_weights(table(spark, d, "orders"), "o_orderstatus")


def _conf(spark, d):
    return metrics.confusion_matrix(scored(spark, d), "label", "prediction", LABELS, ["split"])


@query(
    "m25_summary_metrics",
    f"""WITH {SCORED}, {CONFUSION}, {PER_CLASS} SELECT split, {r('sum(rec * support) / sum(support)')} AS accuracy,
    {r('avg(p)')} AS precision_macro, {r('avg(rec)')} AS recall_macro, {r('avg(f1)')} AS f1_macro,
    {r('sum(p * support) / sum(support)')} AS precision_weighted, {r('sum(rec * support) / sum(support)')} AS
    recall_weighted, {r('sum(f1 * support) / sum(support)')} AS f1_weighted FROM f GROUP BY split""",
)
def m25(spark, d):
    return metrics.summary_metrics(_conf(spark, d), ["split"])


@query(
    "m25_class_metrics",
    f"""WITH {SCORED}, {CONFUSION}, {PER_CLASS} SELECT split, label, support, {r('p')} AS precision, {r('rec')} AS recall,
    {r('f1')} AS f1 FROM f""",
)
def m25_class(spark, d):
    return metrics.class_metrics(_conf(spark, d), ["split"])


_AUC = f"""WITH {SCORED}, {LONG}, rk AS (SELECT class, positive, rank() OVER (PARTITION BY class ORDER BY score) +
    (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS k FROM long), a AS (SELECT class, sum(positive) AS P,
    (sum(k) FILTER (positive = 1) - sum(positive) * (sum(positive) + 1) / 2.0) / (sum(positive)::DOUBLE * (count(*) -
    sum(positive))) AS auc FROM rk GROUP BY class), mk AS (SELECT positive, rank() OVER (ORDER BY score) + (count(*) OVER
    (PARTITION BY score) - 1) / 2.0 AS k FROM long)"""


@query(
    "m26_roc_auc",
    f"""{_AUC} SELECT 'class ' || class AS average, {r('auc')} AS auc FROM a UNION ALL SELECT 'macro', {r('avg(auc)')} FROM a
    UNION ALL SELECT 'weighted', {r('sum(auc * P) / sum(P)')} FROM a UNION ALL SELECT 'micro', {r('''(sum(k) FILTER (positive =
    1) - sum(positive) * (sum(positive) + 1) / 2.0) / (sum(positive)::DOUBLE * (count(*) - sum(positive)))''')} FROM mk""",
)
def m26(spark, d):
    return metrics.roc_auc(scored(spark, d), "label", SCORES)


_POINTS = """pts AS (SELECT DISTINCT CAST(class AS VARCHAR) AS curve, sum(1 - positive) OVER w / sum(1 - positive) OVER
    (PARTITION BY class) AS fpr, sum(positive) OVER w / sum(positive) OVER (PARTITION BY class) AS tpr FROM long
    WINDOW w AS (PARTITION BY class ORDER BY score DESC)), mpts AS (SELECT DISTINCT 'micro' AS curve, sum(1 - positive) OVER w /
    sum(1 - positive) OVER () AS fpr, sum(positive) OVER w / sum(positive) OVER () AS tpr FROM long WINDOW w AS (ORDER BY
    score DESC))"""


@query(
    "m27_roc_curves",
    f"""WITH {SCORED}, {LONG}, {_POINTS}, b AS (SELECT * FROM pts UNION ALL SELECT * FROM mpts) SELECT curve, {r('fpr')} AS
    fpr, {r('tpr')} AS tpr FROM b UNION ALL SELECT DISTINCT curve, {r('0.0::DOUBLE')}, {r('0.0::DOUBLE')} FROM b""",
)
def m27(spark, d):
    return metrics.roc_table(scored(spark, d), "label", SCORES)


@query(
    "m27_macro_roc",
    f"""WITH {SCORED}, {LONG}, {_POINTS}, p AS (SELECT * FROM pts UNION ALL SELECT DISTINCT curve, 0.0, 0.0 FROM pts),
    e AS (SELECT curve, fpr, min(tpr) AS lo, max(tpr) AS hi FROM p GROUP BY ALL), g AS (SELECT DISTINCT fpr FROM p),
    w AS (SELECT c.curve, g.fpr FROM g, (SELECT DISTINCT curve FROM p) c),
    b AS (SELECT w.curve, w.fpr, e.fpr AS f0, e.hi AS h0 FROM w ASOF JOIN e ON w.curve = e.curve AND w.fpr >= e.fpr),
    a AS (SELECT b.*, e.fpr AS f1, e.lo AS l1 FROM b ASOF JOIN e ON b.curve = e.curve AND b.fpr <= e.fpr)
    SELECT {r('fpr')} AS fpr, {r('avg(CASE WHEN f0 = fpr THEN h0 ELSE h0 + (l1 - h0) / nullif(f1 - f0, 0) * (fpr - f0) END)')}
    AS tpr FROM a GROUP BY a.fpr""",
)
def m27_macro(spark, d):
    return metrics.macro_roc(scored(spark, d), "label", SCORES)


@query(
    "m28_confusion_matrix",
    f"""WITH {SCORED}, {CONFUSION} SELECT split, label, prediction, rows,
    {r('coalesce(rows / nullif(sum(rows) OVER (PARTITION BY split, label), 0), 0)')} AS row_share FROM conf""",
)
def m28(spark, d):
    return _conf(spark, d)


@query(
    "m30_generalisation_gap",
    f"""WITH {SCORED}, {CONFUSION}, {PER_CLASS}, acc AS (SELECT 'm' AS model, max(a) FILTER (split = 'train') AS train,
    max(a) FILTER (split = 'test') AS test FROM (SELECT split, sum(rec * support) / sum(support) AS a FROM f GROUP BY split))
    SELECT model, {r('train')} AS train, {r('test')} AS test, {r('train - test')} AS gap, CASE WHEN train - test < 0.05 THEN
    'Minimal' WHEN train - test < 0.15 THEN 'Acceptable' ELSE 'Significant' END AS band FROM acc""",
)
def m30(spark, d):
    rows = metrics.summary_metrics(_conf(spark, d), ["split"]).withColumn("model", F.lit("m"))
    return metrics.generalisation_gap(rows, ["model"])


@query(
    "m31_regression_metrics",
    f"""SELECT l_returnflag, count(*) AS rows, {r('avg((l_quantity - y) ** 2)')} AS mse,
    {r('sqrt(avg((l_quantity - y) ** 2))')} AS rmse, {r('avg(abs(l_quantity - y))')} AS mae,
    {r('1 - avg((l_quantity - y) ** 2) / var_pop(l_quantity)')} AS r2 FROM (SELECT *, l_extendedprice / 2000 AS y FROM lineitem)
    GROUP BY l_returnflag""",
)
def m31_metrics(spark, d):
    li = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 2000)
    return metrics.regression_metrics(li, "l_quantity", "y", ["l_returnflag"])


PART = "part2 AS (SELECT p_partkey, CAST(p_partkey % 4 AS INTEGER) AS k, p_size::DOUBLE AS a, p_retailprice / 10 AS b FROM part)"


def _parts(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        (F.col("p_partkey") % 4).cast("int").alias("k"),
        F.col("p_size").cast("double").alias("a"),
        (F.col("p_retailprice") / 10).alias("b"),
    )


@query(
    "m09_cluster_quality",
    f"""WITH {PART}, c AS (SELECT k, count(*) AS n, avg(a) AS ca, avg(b) AS cb FROM part2 GROUP BY k),
    g AS (SELECT avg(a) AS ga, avg(b) AS gb, count(*) AS n FROM part2),
    dd AS (SELECT k, avg(sqrt((a - ca) ** 2 + (b - cb) ** 2)) AS s, sum((a - ca) ** 2 + (b - cb) ** 2) AS w FROM part2 JOIN c
    USING (k) GROUP BY k), db AS (SELECT avg(m) AS v FROM (SELECT x.k, max((x.s + y.s) / sqrt((cx.ca - cy.ca) ** 2 +
    (cx.cb - cy.cb) ** 2)) AS m FROM dd x JOIN dd y ON x.k <> y.k JOIN c cx ON cx.k = x.k JOIN c cy ON cy.k = y.k GROUP BY x.k)),
    pr AS (SELECT x.p_partkey, x.k, y.k AS k2, sum((x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS t, count(*) AS n FROM part2 x, part2 y
    GROUP BY ALL), sil AS (SELECT p_partkey, max(CASE WHEN k = k2 THEN t / (n - 1) END) AS i, min(CASE WHEN k <> k2 THEN t / n
    END) AS o FROM pr GROUP BY p_partkey)
    SELECT CAST((SELECT count(*) FROM c) AS INTEGER) AS clusters, g.n AS rows, {r('(SELECT avg((o - i) / greatest(i, o)) FROM sil)')}
    AS silhouette, {r('(SELECT v FROM db)')} AS davies_bouldin,
    {r('''(SELECT sum(c.n * ((ca - ga) ** 2 + (cb - gb) ** 2)) FROM c) * (g.n - (SELECT count(*) FROM c)) /
    ((SELECT sum(w) FROM dd) * ((SELECT count(*) FROM c) - 1))''')} AS calinski_harabasz FROM g""",
)
def m09(spark, d):
    return cluster.cluster_quality(_parts(spark, d), "k", ["a", "b"])


@query(
    "m10_cluster_profile",
    f"""WITH {PART}, p AS (SELECT k, count(*) AS members, 'a' AS feature, avg(a) AS mean, stddev_samp(a) AS std FROM part2
    GROUP BY k UNION ALL SELECT k, count(*), 'b', avg(b), stddev_samp(b) FROM part2 GROUP BY k)
    SELECT k, members, feature, {r('mean')} AS mean, {r('std')} AS std, {r('''(mean - avg(mean) OVER (PARTITION BY feature)) /
    coalesce(nullif(stddev_samp(mean) OVER (PARTITION BY feature), 0), 1)''')} AS between_z FROM p""",
)
def m10(spark, d):
    return cluster.cluster_profile(_parts(spark, d), "k", ["a", "b"])


def _labelled(spark, d):
    label = (F.col("event_id") % 4 - 1).cast("int")
    return events(spark, d).select("event_id", "user_id", "ts", "value", label.alias("cluster"))


LABELLED = "lab AS (SELECT event_id, user_id, ts, value, CAST(event_id % 4 - 1 AS INTEGER) AS cluster FROM events)"
_VALUE = f"""{r('avg(value)')} AS value_mean, {r('stddev_samp(value)')} AS value_std, {r('min(value)')} AS value_min,
    {r('max(value)')} AS value_max"""


@query(
    "m13_cluster_shares",
    f"""WITH {LABELLED} SELECT NULL::BIGINT AS user_id, cluster, count(*) AS rows, {_VALUE},
    {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS share_pct FROM lab GROUP BY cluster UNION ALL
    SELECT user_id, cluster, count(*), {_VALUE}, {r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY user_id)')}
    FROM lab GROUP BY user_id, cluster""",
)
def m13(spark, d):
    data = _labelled(spark, d)
    return union_all(
        cluster.cluster_shares(data, "cluster", ["value"], "user_id"), cluster.cluster_shares(data, "cluster", ["value"])
    )


@query(
    "m13_highest_cluster",
    f"""WITH {LABELLED} SELECT cluster, {r('avg(value)')} AS mean FROM lab WHERE cluster >= 0 GROUP BY cluster
    ORDER BY avg(value) DESC, cluster LIMIT 1""",
)
def m13_highest(spark, d):
    return cluster.highest_cluster(_labelled(spark, d), "cluster", "value")


@query(
    "m13_label_progression",
    f"""WITH {LABELLED}, l AS (SELECT *, lag(cluster) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM lab)
    SELECT event_id, user_id, ts, cluster, previous, CAST(cluster <> previous AS INTEGER) AS changed FROM l""",
)
def m13_progression(spark, d):
    return cluster.label_progression(_labelled(spark, d), "user_id", ["ts", "event_id"], "cluster").drop("value")


@query(
    "m16_score_correlation",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'abs(corr(score, {c}))')} AS importance FROM x"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ).join(
        [
            "WITH x AS (SELECT *, l_quantity * l_discount - l_tax AS score FROM lineitem), y AS (",
            ") SELECT feature, importance FROM y ORDER BY importance DESC, feature LIMIT 3",
        ]
    ),
)
def m16(spark, d):
    from pulsegrid.ml.anomaly import score_importance

    li = table(spark, d, "lineitem").withColumn("score", F.col("l_quantity") * F.col("l_discount") - F.col("l_tax"))
    return score_importance(li, "score", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3)


def _flagged_sql(kind: str) -> str:
    return f"""SELECT '{kind}' AS dataset, count(*) AS n, count(*) FILTER (flag) AS anomalies,
    {r('count(*) FILTER (flag) * 100.0 / count(*)')} AS anomaly_pct, {r('avg(value) FILTER (NOT flag)')} AS value_normal,
    {r('avg(value) FILTER (flag)')} AS value_anomaly, {r('''(avg(value) FILTER (NOT flag) - avg(value) FILTER (flag)) /
    sqrt(((count(*) FILTER (NOT flag) - 1) * var_samp(value) FILTER (NOT flag) + (count(*) FILTER (flag) - 1) * var_samp(value)
    FILTER (flag)) / (count(*) - 2))''')} AS value_d FROM (SELECT *, user_id % 10 = 0 AS flag FROM events
    WHERE event_type = '{kind}')"""


@query("m17_anomaly_summary", " UNION ALL ".join(_flagged_sql(k) for k in ("click", "view", "error")))
def m17(spark, d):
    from pulsegrid.ml.anomaly import anomaly_summary

    e = events(spark, d).withColumn("is_anomaly", (F.col("user_id") % 10 == 0).cast("int"))
    parts = {k: e.where(F.col("event_type") == k) for k in ("click", "view", "error")}
    return anomaly_summary(union_labelled(parts, "dataset"), ["value"], "is_anomaly", ["dataset"])


