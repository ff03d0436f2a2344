"""Learning jobs whose results SQL can check: fixed points, closed forms, planted cases, rebuilt matrices."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulsegrid.catalog.base import events, query, r, table
from pulsegrid.catalog.q_metrics import PART, _parts
from pulsegrid.catalog.q_models import _PAIRS, LINE, _lof_sql, profiles, vectors
from pulsegrid.ml import anomaly, classify, cluster, grid, iforest, kernel, kmeans, lof, reduce, stages
from pulsegrid.session import freeze, scratch_path
from pulsegrid.sources import files, sinks

# K-means


def _standard_parts(spark, d):
    return reduce.standardised(_parts(spark, d), ["a", "b"])


@query(
    "m07_lloyd_from_centres",
    f"""WITH RECURSIVE {PART}, z AS MATERIALIZED (SELECT p_partkey, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a,
    (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM part2),
    step(i, c, a, b) AS (SELECT 0, row_number() OVER (ORDER BY p_partkey) - 1, a, b FROM z WHERE p_partkey <= 4 UNION ALL
    SELECT i + 1, c, avg(a), avg(b) FROM (SELECT s.i, z.p_partkey, any_value(z.a) AS a, any_value(z.b) AS b,
    arg_min(s.c, (z.a - s.a) ** 2 + (z.b - s.b) ** 2) AS c FROM step s, z WHERE s.i < 250 GROUP BY s.i, z.p_partkey) GROUP BY i, c)
    SELECT z.p_partkey, CAST(arg_min(s.c, (z.a - s.a) ** 2 + (z.b - s.b) ** 2) AS INTEGER) AS cluster
    FROM z, (SELECT * FROM step WHERE i = 250) s GROUP BY z.p_partkey""",
)
def m07_lloyd(spark, d):
    """From given centres the whole way is fixed, so the clusters must be those of SQL."""
    parts = _standard_parts(spark, d)
    start = parts.where("p_partkey <= 4").orderBy("p_partkey").select(vector_to_array(classify.VECTOR).alias("x")).collect()
    rows = kmeans.array_rows(parts, classify.VECTOR)
    fit = kmeans.lloyd(rows, {0: np.array([s["x"] for s in start])})[0]
    return fit.transform(parts, classify.VECTOR).select("p_partkey", "cluster")


def _settled(clustered, row_id):
    """1 for each row whose cluster's mean, counted anew, is the nearest of all means."""
    x = vector_to_array(classify.VECTOR)
    rows = clustered.select(row_id, "cluster", x.alias("x"))
    at = rows.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("m"))
    mean = F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    means = at.groupBy("cluster").agg(mean.alias("mean"))
    d2 = F.aggregate(F.zip_with("x", "mean", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    # a row per cluster beside each row
    met = rows.withColumnRenamed("cluster", "own").crossJoin(F.broadcast(means)).select(row_id, "own", "cluster", d2.alias("d2"))
    near = met.groupBy(row_id).agg(F.min("d2").alias("least"), F.min(F.when(F.col("cluster") == F.col("own"), F.col("d2"))).alias("mine"))
    return near.select(row_id, (F.col("mine") <= F.col("least") * (1 + 1e-9) + 1e-12).cast("int").alias("settled"))


@query("m07_kmeans_fixed_point", "SELECT DISTINCT l_suppkey, 1 AS settled FROM lineitem")
def m07_fixed_point(spark, d):
    p = profiles(spark, d)
    return _settled(cluster.best_kmeans(p, 3, starts=20).transform(p, classify.VECTOR), "l_suppkey")


@query("m08_sweep_fixed_point", "SELECT k, 0 AS unsettled, 1 AS cost_from_sums FROM (SELECT unnest(range(2, 11)) AS k)")
def m08_fixed_point(spark, d):
    """Of the best fit of every k: rows beside another mean, and whether its cost is that of sums and counts alone."""
    p = profiles(spark, d)
    fits, rows = kmeans.fit_all(p, classify.VECTOR, range(2, 11), 20)
    out = []
    for k, fit in fits.items():
        own = rows.withColumn("cluster", fit.predict(F.col("x")))
        at = own.select("cluster", F.posexplode("x").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
        cost = at.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("c"))
        settled = _settled(p.join(fit.transform(p, classify.VECTOR).select("l_suppkey", "cluster"), "l_suppkey"), "l_suppkey")
        unsettled = settled.agg(F.count_if(F.col("settled") == 0).alias("unsettled"))
        same = (F.abs(F.col("c") - fit.cost) <= 1e-9 * fit.cost + 1e-9).cast("int")
        out.append(unsettled.crossJoin(cost).select(F.lit(k).cast("bigint").alias("k"), F.col("unsettled").cast("int").alias("unsettled"), same.alias("cost_from_sums")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


@query(
    "m09_exact_silhouette",
    f"""WITH {PART}, pr AS (SELECT x.p_partkey, x.k, y.k AS k2, sum(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS t, count(*) AS n
    FROM part2 x, part2 y GROUP BY ALL), sil AS (SELECT p_partkey, max(CASE WHEN k = k2 THEN t / (n - 1) END) AS i,
    min(CASE WHEN k <> k2 THEN t / n END) AS o FROM pr GROUP BY p_partkey)
    SELECT (SELECT count(DISTINCT k) FROM part2) AS clusters, (SELECT count(*) FROM part2) AS rows,
    {r('avg((o - i) / greatest(i, o))')} AS silhouette FROM sil""",
)
def m09_exact(spark, d):
    return cluster.silhouette(_parts(spark, d), "k", ["a", "b"])


# Components


@query(
    "m05_rebuilt_correlation",
    " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, {r(f'corr({a}, {b})')} AS r FROM lineitem" for a in LINE for b in LINE),
)
def m05_rebuilt(spark, d):
    """All components with their variances give back the correlation matrix."""
    li = reduce.standardised(table(spark, d, "lineitem").select(*LINE), LINE)
    model = reduce.fit_pca(li, len(LINE))
    v, share = model.pc.toArray(), model.explainedVariance.toArray()
    matrix = v @ np.diag(share * len(LINE)) @ v.T
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(LINE) for j, b in enumerate(LINE)]
    return spark.createDataFrame(rows, "var_a string, var_b string, r double")


@query(
    "m06_projection_lengths",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, {r(' + '.join(f'((x.{c} - s.m_{c}) / s.s_{c}) ** 2' for c in LINE))} AS length2
    FROM lineitem x, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LINE)} FROM lineitem) s""",
)
def m06_lengths(spark, d):
    """A projection on all components keeps every row's length."""
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    li = reduce.standardised(table(spark, d, "lineitem").select(*keys, *LINE), LINE)
    n = len(LINE)
    out = reduce.project(reduce.fit_pca(li, n), li, n)
    return out.select(*keys, sum((F.col(f"pc{i + 1}") ** 2 for i in range(1, n)), F.col("pc1") ** 2).alias("length2"))


# Detectors


@query("m15_planted_outliers", "SELECT p_partkey, 1 AS is_anomaly FROM part WHERE p_partkey % 50 = 0")
def m15_planted(spark, d):
    """Parts moved far out in one of four directions are all among the tenth with the lowest scores."""
    far = F.col("p_partkey") % 50 == 0
    sign = F.when(F.col("p_partkey") % 100 == 0, 1.0).otherwise(-1.0)
    rows = _parts(spark, d).select(
        "p_partkey", (F.col("a") + F.when(far, sign * 400.0).otherwise(0.0)).alias("a"), (F.col("b") + F.when(far & (F.col("p_partkey") % 3 == 0), 900.0).otherwise(0.0)).alias("b")
    )
    scored = iforest.isolation_forest(rows, "p_partkey", ["a", "b"], 0.1)
    return scored.where(far).select("p_partkey", "is_anomaly")


_FOUND = f"""{_PAIRS}, {_lof_sql(20)}, e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE)
    AS x1 FROM embeddings), j AS (SELECT e.*, f.score, f.is_anomaly FROM e JOIN f USING (vec_id))"""


def _detected(spark, d):
    v, cols = vectors(spark, d)
    return lof.local_outlier_factor(v, "vec_id", cols, 20, 0.1)


@query(
    "m16_importance_of_detector",
    f"""WITH {_FOUND} SELECT feature, {r('importance')} AS importance FROM (SELECT 'x0' AS feature, abs(corr(score, x0)) AS importance
    FROM j UNION ALL SELECT 'x1', abs(corr(score, x1)) FROM j)""",
)
def m16_detector(spark, d):
    """From the detector to what its scores go with, in one query."""
    return anomaly.score_importance(_detected(spark, d), "score", ["x0", "x1"], 2)


def _side(c: str, flag: int) -> str:
    return f"{r(f'avg({c}) FILTER (is_anomaly = {flag})')}"


@query(
    "m17_summary_of_detector",
    f"""WITH {_FOUND}, g AS (SELECT label, count(*) FILTER (is_anomaly = 0) AS n1, count(*) FILTER (is_anomaly = 1) AS n2,
    var_samp(x0) FILTER (is_anomaly = 0) AS v1, var_samp(x0) FILTER (is_anomaly = 1) AS v2,
    avg(x0) FILTER (is_anomaly = 0) AS a1, avg(x0) FILTER (is_anomaly = 1) AS a2 FROM j GROUP BY label)
    SELECT label, n1 + n2 AS n, n2 AS anomalies, {r('n2 * 100.0 / (n1 + n2)')} AS anomaly_pct, {r('a1')} AS x0_normal, {r('a2')} AS x0_anomaly,
    {r('CASE WHEN n1 >= 2 AND n2 >= 2 THEN (a1 - a2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) END')} AS x0_d FROM g""",
)
def m17_detector(spark, d):
    return anomaly.anomaly_summary(_detected(spark, d), ["x0"], "is_anomaly", ["label"])


# Classifiers


def _bands(spark, d):
    """Parts with a label that a threshold on one of two features decides; every fourth one is for testing."""
    rows = _parts(spark, d).withColumn("x", (F.col("a") % 20).cast("double"))
    rows = rows.withColumn("label", (F.col("x") >= 8).cast("int")).withColumn("split", F.when(F.col("p_partkey") % 4 == 0, "test").otherwise("train"))
    return freeze(classify.assemble(rows, ["x", "b"]).select("p_partkey", "label", "split", "a", "b", "x", classify.VECTOR))


_BAND = "SELECT p_partkey, CAST(p_size % 20 >= 8 AS INTEGER) AS prediction"


@query(
    "m20_trees_find_threshold",
    " UNION ALL ".join(f"{_BAND}, '{m}' AS model FROM part" for m in ("forest", "boosted", "voting")),
)
def m20_threshold(spark, d):
    data = _bands(spark, d)
    train = data.where("split = 'train'")
    members = [
        classify.fit_forest(train, "label", **classify.WINDOW["forest"] | {"numTrees": 30}),
        classify.fit_boosted(train, "label", 2, **classify.REGULARISED["boosted"] | {"maxIter": 10, "featureSubsetStrategy": "all"}),
    ]
    fits = [*members, classify.soft_voting(members)]
    parts = [f.score(data).select("p_partkey", "prediction", F.lit(f.name).alias("model")) for f in fits]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m32_importance_of_threshold", "SELECT 'x' AS feature, CAST(count(*) > 0 AS INTEGER) AS first FROM part")
def m32_threshold(spark, d):
    fitted = classify.fit_forest(_bands(spark, d).where("split = 'train'"), "label", **classify.REGULARISED["forest"])
    top = classify.importances(fitted.models[0], ["x", "b"], 1)
    return top.select("feature", (F.col("importance") > 0.5).cast("int").alias("first"))


@query("m31_regression_on_steps", "SELECT p_partkey, CAST(CASE WHEN p_size % 20 >= 8 THEN 100 ELSE 0 END AS INTEGER) AS level FROM part")
def m31_steps(spark, d):
    """A target with two levels is met to a tenth of the step."""
    data = _bands(spark, d).withColumn("target", F.col("label") * 100.0)
    _, score = classify.fit_boosted_regression(data.where("split = 'train'"), "target", maxIter=40, featureSubsetStrategy="all")
    return score(data).select("p_partkey", (F.round(F.col("prediction") / 10) * 10).cast("int").alias("level"))


_NB = f"""{PART}, t AS (SELECT *, CASE WHEN a < 14 THEN 0 WHEN a < 33 THEN 1 ELSE 2 END AS y FROM part2), tr AS (SELECT * FROM t WHERE
    p_partkey % 4 <> 0), e AS (SELECT 1e-9 * greatest(var_pop(a), var_pop(b)) AS eps FROM tr), s AS (SELECT y, ln(count(*)) AS prior,
    avg(a) AS ma, var_pop(a) + (SELECT eps FROM e) AS va, avg(b) AS mb, var_pop(b) + (SELECT eps FROM e) AS vb FROM tr GROUP BY y)"""


@query(
    "m22_naive_bayes_closed_form",
    f"""WITH {_NB} SELECT p_partkey, CAST(arg_max(s.y, prior - 0.5 * (ln(va) + ln(vb) + (t.a - ma) ** 2 / va + (t.b - mb) ** 2 / vb))
    AS INTEGER) AS prediction FROM t, s GROUP BY p_partkey""",
)
def m22_closed(spark, d):
    rows = _parts(spark, d).withColumn("label", F.when(F.col("a") < 14, 0).when(F.col("a") < 33, 1).otherwise(2))
    rows = classify.assemble(rows, ["a", "b"])
    return classify.fit_naive_bayes(rows.where("p_partkey % 4 <> 0"), "label").score(rows).select("p_partkey", "prediction")


@query("m18_logistic_gradient", "SELECT k, feature, 1 AS vanishes FROM (SELECT unnest([0, 1, 2]) AS k), (SELECT unnest(['a', 'b', 'intercept']) AS feature)")
def m18_gradient(spark, d):
    """Where the fit ends, the gradient of the penalised loss, summed up anew from its probabilities, is nought."""
    rows = reduce.standardised(_parts(spark, d), ["a", "b"]).withColumn(
        "label", F.when(F.col("a") < 14, 0).when((F.col("a") < 33) & (F.col("p_partkey") % 5 != 0), 1).otherwise(2)
    )
    fitted = classify.fit_logistic(rows, "label", C=1.0)
    model = fitted.models[0]
    coefficients = model.coefficientMatrix.toArray()
    x = F.concat(vector_to_array(classify.VECTOR), F.array(F.lit(1.0)))
    off = [(F.col(classify.PROB)[k] - (F.col("label") == k).cast("double")) for k in range(3)]
    sums = fitted.score(rows).withColumn("__x", x).agg(*[F.avg(off[k] * F.col("__x")[i]).alias(f"g{k}_{i}") for k in range(3) for i in range(3)])
    n = F.lit(1.0 / rows.count())
    cells = F.array(*[
        F.struct(
            F.lit(k).alias("k"), F.lit(("a", "b", "intercept")[i]).alias("feature"),
            (F.abs(F.col(f"g{k}_{i}") + (n * float(coefficients[k][i]) if i < 2 else F.lit(0.0))) < 1e-4).cast("int").alias("vanishes"),
        )
        for k in range(3) for i in range(3)
    ])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


_DIRECTIONS = [[0.5, -0.02], [0.11, 0.07], [-0.3, 0.2]]
_OFFSETS = [0.1, 2.0, 4.5]


@query(
    "m21_feature_map",
    f"""WITH {PART} SELECT p_partkey, {", ".join(f"{r(f'sqrt(2.0 / 3) * cos({w[0]} * a + {w[1]} * b + {o})')} AS z{i}"
    for i, (w, o) in enumerate(zip(_DIRECTIONS, _OFFSETS)))} FROM part2""",
)
def m21_map(spark, d):
    mapped = kernel.FourierMap(np.array(_DIRECTIONS), np.array(_OFFSETS))
    z = _parts(spark, d).withColumn("z", mapped(F.array("a", "b")))
    return z.select("p_partkey", *[F.col("z")[i].alias(f"z{i}") for i in range(3)])


@query(
    "m21_kernel_margin",
    f"""WITH {PART}, z AS (SELECT (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b
    FROM part2) SELECT CAST(a * a + b * b < 1.3 AS INTEGER) AS label, count(*) AS rows, 1 AS nearly_all_right FROM z GROUP BY 1""",
)
def m21_kernel(spark, d):
    """A disc in the middle, which no line cuts off: at least 9 of 10 parts of either side are told apart."""
    data = reduce.standardised(_parts(spark, d), ["a", "b"])
    z = vector_to_array(classify.VECTOR)
    data = data.withColumn("label", (z[0] * z[0] + z[1] * z[1] < 1.3).cast("int"))
    scored = kernel.fit_kernel_margin(data, "label", 2, gamma=1.0, regParam=1e-5).score(data)
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    return scored.groupBy("label").agg(F.count("*").alias("rows"), (right >= 0.9).cast("int").alias("nearly_all_right"))


# Saved fits and sources


@query(
    "s09_persisted_pipeline",
    f"""WITH x AS (SELECT event_id, user_id, event_id % 5 <> 0 AS train, CASE WHEN event_id % 7 <> 0 THEN value END AS v,
    CASE WHEN event_id % 11 <> 0 THEN hour(ts)::DOUBLE END AS h FROM events),
    m AS (SELECT quantile_cont(v, 0.5) AS mv, quantile_cont(h, 0.5) AS mh FROM x WHERE train),
    f AS (SELECT event_id, user_id, train, coalesce(v, mv) AS v, coalesce(h, mh) AS h FROM x, m),
    b AS (SELECT user_id, avg(v) AS base FROM f WHERE train GROUP BY user_id),
    w AS (SELECT f.*, coalesce(base, (SELECT avg(base) FROM b)) AS v_baseline FROM f LEFT JOIN b USING (user_id)),
    s AS (SELECT avg(v) AS av, stddev_pop(v) AS sv, avg(h) AS ah, stddev_pop(h) AS sh FROM w WHERE train)
    SELECT event_id, {r('v_baseline')} AS v_baseline, {r('v / (v_baseline + 1)')} AS v_ratio, {r('(v - av) / sv')} AS v, {r('(h - ah) / sh')} AS h FROM w, s""",
)
def s09_pipeline(spark, d):
    """Imputer, baselines and scaler fitted as one pipeline on some rows, saved, loaded, and applied to all."""
    e = events(spark, d)
    rows = e.select(
        "event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 11 != 0, F.hour("ts").cast("double")).alias("h")
    )
    both = ["v", "h"]
    steps = [stages.MedianImputer(inputCols=both), stages.EntityBaselines(inputCols=["v"], entity="user_id"), stages.PopulationScaler(inputCols=both)]
    path = sinks.save_model(Pipeline(stages=steps).fit(rows.where("event_id % 5 <> 0")), scratch_path(spark, "s09p"))
    return PipelineModel.load(path).transform(rows).select("event_id", "v_baseline", "v_ratio", *both)


_FAULTS = {1: "5 fields of 4", 2: "3 fields of 4", 3: "unreadable value", 4: "unreadable ts, user_id", 5: "not UTF-8"}


@query(
    "s05_quarantine",
    f"""SELECT event_id, CASE event_id % 40 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _FAULTS.items())} ELSE 'good' END AS reason,
    CASE WHEN event_id % 40 NOT IN (1, 2, 3, 4, 5) THEN {r('value')} END AS value FROM events""",
)
def s05_quarantine(spark, d):
    """Lines with a field too many or too few, a word for a number, a broken time, and bytes that are no UTF-8."""
    kind = F.col("event_id") % 40
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    value, user = F.col("value").cast("string"), F.col("user_id").cast("string")
    fields = [
        F.col("event_id").cast("string"),
        F.when(kind == 4, F.concat(F.lit("99:"), time)).otherwise(time),
        F.when(kind == 4, F.concat(F.lit("no. "), user)).when(kind == 2, F.lit(None)).otherwise(user),
        F.when(kind == 3, F.concat(F.lit("about "), value)).when(kind == 5, F.concat(value, F.unhex(F.lit("FF")).cast("string"))).otherwise(value),
        F.when(kind == 1, F.lit("more")),
    ]
    # files of at most 2,000 lines below their header, byte for byte
    lines = events(spark, d).select(F.floor(F.col("event_id") / 2000).alias("part"), F.concat_ws(",", *fields).alias("line"))
    whole = F.concat_ws("\n", F.lit("event_id,ts,user_id,value"), F.collect_list("line"))
    path = scratch_path(spark, "s05q")
    lines.groupBy("part").agg(whole.alias("value")).write.partitionBy("part").text(path)
    checked = files.read_checked(spark, path, "event_id bigint, ts timestamp_ntz, user_id bigint, value double", "*.txt")
    good = checked.rows.select("event_id", F.lit("good").alias("reason"), "value")
    bad = checked.bad.select(F.split("record", ",")[0].cast("bigint").alias("event_id"), "reason", F.lit(None).cast("double").alias("value"))
    return good.unionByName(bad)


_CELLS = " CROSS JOIN ".join(
    f"(SELECT unnest({list(v)}) AS {k})"
    for k, v in {"target": ("many_lines", "dear"), "width": ("narrow", "wide"), "split": ("by_order",), "part": ("test", "train")}.items()
)


@query(
    "m29_experiment_grid",
    f"""WITH m(model) AS (VALUES ('boosted'), ('forest_window'), ('forest_binary'), ('logistic'))
    SELECT target, width, split, model, part, 1 AS beats_majority FROM {_CELLS} CROSS JOIN m""",
)
def m29_grid(spark, d):
    """Two targets and widths with models of all three settings, in two goes: the second adds the missing cells.

    Each cell must do at least as well as always naming the larger class, less two
    in a hundred; the forest with balanced weights need not, and counts if it beats a coin.
    """
    from pulsegrid.catalog.q_models import FEATURES, order_features

    rows = freeze(order_features(spark, d))
    targets = {"many_lines": (F.col("lines") >= 4).cast("int"), "dear": (F.col("price") >= 140_000).cast("int")}
    splits = {"by_order": F.when(F.pmod(F.xxhash64("o_orderkey"), F.lit(4)) == 0, "test").otherwise("train")}
    models = grid.models_of({k: classify.REGULARISED[k] for k in ("boosted", "logistic")})
    models["forest_window"] = grid.models_of(classify.WINDOW, balanced=True)["forest"]
    models["forest_binary"] = grid.models_of(classify.BINARY)["forest"]
    settings = {"targets": targets, "widths": {"narrow": ["lines", "quantity"], "wide": FEATURES}, "splits": splits}
    path = scratch_path(spark, "m29")
    grid.run_grid(rows, path, **settings, models={"boosted": models["boosted"]})
    results = grid.run_grid(rows, path, **settings, models=models)
    shares = None
    for target, label in targets.items():
        for split, part in splits.items():
            one = rows.groupBy(part.alias("part")).agg(F.avg(label).alias("p")).select(
                F.lit(target).alias("target"), F.lit(split).alias("split"), "part", (F.greatest("p", 1 - F.col("p")) - 0.02).alias("majority")
            )
            shares = one if shares is None else shares.unionByName(one)
    beats = (F.col("accuracy") >= F.when(F.col("model") == "forest_window", 0.5).otherwise(F.col("majority"))).cast("int")
    return results.join(shares, ["target", "split", "part"]).select("target", "width", "split", "model", "part", beats.alias("beats_majority"))
