"""Aggregations, quality reports and statistics on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.base import (
    EVENT_DAYS,
    RESPONSES,
    SAMPLES,
    WIDE,
    WIDE_FEATURES,
    event_days,
    events,
    half_up,
    order_days,
    query,
    r,
    responses,
    samples,
    table,
    wide,
)
from pulsegrid.catalog.q_joins import MISSING
from pulsegrid.functions import transforms as tf
from pulsegrid.functions.encode import feature_name_parts
from pulsegrid.operators import continuity, daily, quality, stats
from pulsegrid.operators.joins import left_lookup
from pulsegrid.operators.sets import union_all

TYPES = ["click", "error", "purchase", "signup", "view"]
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def daily_series(spark, d):
    """Series columns named by metric family."""
    kind, v = F.col("event_type"), F.col("value")
    return events(spark, d).select(
        "user_id",
        F.to_date("ts").alias("date"),
        F.when(kind == "click", v).alias("hrv_rmssd"),
        F.when(kind == "view", v).alias("low_frequency"),
        F.when(kind.isin("view", "error"), F.floor(v / 10)).alias("high_frequency"),
        F.when(kind == "signup", v).alias("steps"),
        "event_type",
        "value",
    )


SERIES = (
    "series AS (SELECT user_id, CAST(ts AS DATE) AS date, CASE WHEN event_type = 'click' THEN value END AS hrv_rmssd, "
    "CASE WHEN event_type = 'view' THEN value END AS low_frequency, "
    "CASE WHEN event_type IN ('view', 'error') THEN floor(value / 10) END AS high_frequency, "
    "CASE WHEN event_type = 'signup' THEN value END AS steps, event_type, value FROM events)"
)


@query(
    "g01_daily_stats",
    f"""WITH {SERIES} SELECT user_id, date, {r('avg(hrv_rmssd)')} AS hrv_rmssd_mean, {r('stddev_samp(hrv_rmssd)')} AS
    hrv_rmssd_std, {r('min(hrv_rmssd)')} AS hrv_rmssd_min, {r('max(hrv_rmssd)')} AS hrv_rmssd_max,
    {r('avg(low_frequency)')} AS low_frequency_mean, {r('stddev_samp(low_frequency)')} AS low_frequency_std,
    {r('coalesce(sum(steps), 0)')} AS steps_total FROM series GROUP BY user_id, date""",
)
def g01(spark, d):
    s = daily_series(spark, d)
    plan = daily.plan_statistics(["hrv_rmssd", "low_frequency", "steps", "value"])
    return daily.daily_stats(s, ["user_id", "date"], plan)


@query(
    "g02_daily_total",
    f"WITH {SERIES} SELECT user_id, date, {r('coalesce(sum(steps), 0)')} AS steps_total FROM series GROUP BY ALL",
)
def g02(spark, d):
    return daily.daily_total(daily_series(spark, d), ["user_id", "date"], ["steps"])


@query(
    "g04_ratio_stats",
    f"""WITH {SERIES} SELECT user_id, {r('avg(low_frequency / nullif(high_frequency, 0))')} AS lf_hf_mean,
    {r('stddev_samp(low_frequency / nullif(high_frequency, 0))')} AS lf_hf_std FROM series GROUP BY user_id""",
)
def g04(spark, d):
    return daily.ratio_stats(daily_series(spark, d), ["user_id"], "low_frequency", "high_frequency", "lf_hf")


_LEVELS = ", ".join(f"count(*) FILTER (event_type = '{t}') AS activity_level_{t}_count" for t in TYPES)


@query("g05_level_counts", f"WITH {SERIES} SELECT user_id, date, {_LEVELS} FROM series GROUP BY user_id, date")
def g05(spark, d):
    return daily.level_counts(daily_series(spark, d), ["user_id", "date"], "event_type", TYPES)


_Q = "quantile_cont({c}, 0.25)", "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75)"


def _describe(c: str) -> str:
    return (
        f"count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, "
        f"{r(f'max({c})')} AS max, {r(_Q[0].format(c=c))} AS q25, {r(_Q[1].format(c=c))} AS median, "
        f"{r(_Q[2].format(c=c))} AS q75"
    )


@query("g07_group_describe", f"SELECT isodow(ts) - 1 AS weekday, {_describe('value')} FROM events GROUP BY 1")
def g07(spark, d):
    e = events(spark, d).withColumn("weekday", F.weekday("ts").cast("bigint"))
    return stats.group_describe(e, ["weekday"], "value")


@query(
    "g08_describe",
    f"WITH {WIDE} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_describe(c)}, count(*) - count({c}) AS missing, "
        f"{r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct FROM wide"
        for c in WIDE_FEATURES
    ),
)
def g08(spark, d):
    return stats.describe(wide(spark, d), WIDE_FEATURES)


@query(
    "g09_group_means",
    f"""SELECT event_type, hour(ts) AS hour, {r('avg(value)')} AS value_mean, count(*) AS rows,
    count(DISTINCT user_id) AS users FROM events GROUP BY ALL""",
)
def g09(spark, d):
    e = events(spark, d).withColumn("hour", F.hour("ts").cast("bigint"))
    return stats.group_means(e, ["event_type", "hour"], ["value"], "user_id")


@query(
    "g10_target_summary",
    f"WITH {RESPONSES} SELECT user_id, count(*) AS responses, {half_up('avg(floor(target))', 2)} AS target_mean FROM responses GROUP BY user_id",
)
def g10(spark, d):
    # a slider holds whole numbers
    q = responses(spark, d).withColumn("target", F.floor("target"))
    return stats.target_summary(q, "user_id", ["target"])


@query(
    "g11_robust_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r(f'quantile_cont({c}, 0.05)')} AS p05, {r(f'quantile_cont({c}, 0.5)')} AS median, "
        f"{r(f'quantile_cont({c}, 0.95)')} AS p95, {r(f'max({c})')} AS max FROM lineitem"
        for c in NUM
    ),
)
def g11(spark, d):
    return stats.robust_summary(table(spark, d, "lineitem"), NUM)


@query(
    "g12_dataset_summary",
    f"""WITH {WIDE} SELECT count(*) AS rows, min(ts) AS span_start, max(ts) AS span_end, count(DISTINCT date) AS unique_dates,
    count(*) FILTER (coalesce(hr_mean, spo2_min) IS NOT NULL) AS env_rows_any,
    count(*) FILTER (steps_count IS NOT NULL) AS count_rows_any FROM wide""",
)
def g12(spark, d):
    sets = {"env": ["hr_mean", "spo2_min"], "count": ["steps_count"]}
    return quality.dataset_summary(wide(spark, d), "ts", sets)


def _profile_sql(select: str) -> str:
    cols = ", ".join(f"count({c}) AS {c}" for c in WIDE_FEATURES)
    return f"""WITH {WIDE}, u AS (UNPIVOT (SELECT {cols} FROM wide) ON COLUMNS(*) INTO NAME column_name VALUE non_null),
    n AS (SELECT count(*) AS total FROM wide), p AS (SELECT *, non_null * 100.0 / total AS pct FROM u CROSS JOIN n),
    s AS (SELECT *, regexp_replace(column_name, '_(mean|std|min|max|median|count)$', '') AS base_variable,
    regexp_extract(column_name, '_(mean|std|min|max|median|count)$', 1) AS statistic FROM p) {select}"""


@query(
    "g13_column_completeness",
    _profile_sql(
        f"""SELECT column_name, 'double' AS dtype, non_null, total, total - non_null AS null_count,
        {r('pct')} AS completeness_pct, {r('100 - pct')} AS missing_pct FROM p"""
    ),
)
def g13(spark, d):
    return quality.column_completeness(wide(spark, d), WIDE_FEATURES)


@query(
    "g13_overall_completeness",
    _profile_sql(
        f"""SELECT CAST(sum(non_null) AS BIGINT) AS non_null, CAST(sum(total) AS BIGINT) AS cells,
        {r('sum(non_null) * 100.0 / sum(total)')} AS overall_pct FROM p"""
    ),
)
def g13_overall(spark, d):
    return quality.overall_completeness(quality.column_completeness(wide(spark, d), WIDE_FEATURES))


@query(
    "g14_variable_summary",
    _profile_sql(
        f"""SELECT base_variable, {r('avg(pct)')} AS avg_completeness, {r('max(pct)')} AS max_completeness,
        {r('min(pct)')} AS min_completeness, count(*) AS statistics_count,
        string_agg(DISTINCT statistic, ', ' ORDER BY statistic) AS statistics_types FROM s GROUP BY base_variable"""
    ),
)
def g14(spark, d):
    return quality.variable_summary(quality.feature_completeness(wide(spark, d), WIDE_FEATURES))


def _entity_sql(select: str) -> str:
    counts = ", ".join(f"count({c}) AS {c}" for c in WIDE_FEATURES)
    return f"""WITH {WIDE}, pu AS (SELECT user_id, count(*) AS n, {counts} FROM wide GROUP BY user_id),
    l AS (UNPIVOT pu ON {', '.join(WIDE_FEATURES)} INTO NAME column_name VALUE v),
    e AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS total_values, CAST(sum(v) AS BIGINT) AS non_null_values,
    count(*) FILTER (v > 0) AS users_with_data, count(*) AS total_users,
    {half_up('CAST(sum(v) AS DOUBLE) * 100 / sum(n)', 2)} AS completeness_pct FROM l GROUP BY column_name) {select}"""


@query("g15_entity_completeness", _entity_sql("SELECT * FROM e"))
def g15(spark, d):
    return quality.entity_completeness(wide(spark, d), "user_id", WIDE_FEATURES)


@query(
    "g16_keep_recommendation",
    _entity_sql(
        """SELECT column_name, completeness_pct, users_with_data, CASE WHEN completeness_pct < 10 OR users_with_data <
        floor(total_users * 0.25) THEN 'remove' ELSE 'keep' END AS recommendation FROM e"""
    ),
)
def g16(spark, d):
    report = quality.entity_completeness(wide(spark, d), "user_id", WIDE_FEATURES)
    return quality.keep_recommendation(report).select(
        "column_name", "completeness_pct", "users_with_data", "recommendation"
    )


@query(
    "g17_band_counts",
    f"""WITH {WIDE}, p AS (SELECT user_id, count(hr_mean) * 100.0 / count(*) AS pct FROM wide GROUP BY user_id),
    bands(band, low, high) AS (VALUES ('0-10%', 0, 10), ('10-25%', 10, 25), ('25-50%', 25, 50), ('50-75%', 50, 75),
    ('75-90%', 75, 90), ('90-100%', 90, 100)),
    five(band, low, high) AS (VALUES ('very poor', -1, 10), ('poor', 10, 20), ('fair', 20, 50), ('good', 50, 80),
    ('excellent', 80, 101)), tiers(band, low, high) AS (VALUES ('low', -1, 60), ('medium', 60, 80), ('high', 80, 101))
    SELECT 'six' AS variant, band, count(pct) AS rows FROM bands LEFT JOIN p ON pct >= low AND pct < high GROUP BY band
    UNION ALL SELECT 'five', band, count(pct) FROM five LEFT JOIN p ON pct >= low AND pct < high GROUP BY band
    UNION ALL SELECT 'tiers', band, count(pct) FROM tiers LEFT JOIN p ON pct >= low AND pct < high GROUP BY band""",
)
def g17(spark, d):
    per_user = wide(spark, d).groupBy("user_id").agg(
        F.try_divide(F.count("hr_mean") * 100.0, F.count("*")).alias("pct")
    )
    variants = {"six": quality.SIX_BANDS, "five": quality.FIVE_BANDS, "tiers": quality.QUALITY_TIERS}
    return union_all(
        *[quality.band_counts(per_user, "pct", b).select(F.lit(v).alias("variant"), "*") for v, b in variants.items()]
    )


@query(
    "g18_variable_presence",
    _entity_sql(
        f"""SELECT column_name, users_with_data AS users, {r('users_with_data * 100.0 / total_users')} AS users_pct,
        non_null_values AS total_non_null FROM e"""
    ),
)
def g18(spark, d):
    return quality.variable_presence(wide(spark, d), "user_id", WIDE_FEATURES)


@query(
    "g19_user_coverage",
    f"""SELECT user_id, count(*) AS rows, count(DISTINCT CAST(ts AS DATE)) AS distinct_days, min(ts) AS first_ts,
    max(ts) AS last_ts, {half_up('CAST(count(*) AS DOUBLE) / count(DISTINCT CAST(ts AS DATE))', 1)} AS rows_per_day
    FROM events GROUP BY user_id""",
)
def g19(spark, d):
    return quality.user_coverage(events(spark, d), "user_id", "ts")


def _extreme(c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, "
        f"(SELECT user_id FROM pu WHERE {c} IS NOT NULL ORDER BY {c}, user_id LIMIT 1) AS user_at_min, {r(f'max({c})')} AS max, "
        f"(SELECT user_id FROM pu WHERE {c} IS NOT NULL ORDER BY {c} DESC, user_id LIMIT 1) AS user_at_max FROM pu"
    )


@query(
    "g20_extremes",
    f"""WITH {WIDE}, pu AS (SELECT user_id, count(hr_mean) AS hr_rows, max(sleep_max) AS sleep_top FROM wide GROUP BY user_id)
    {_extreme('hr_rows')} UNION ALL {_extreme('sleep_top')}""",
)
def g20(spark, d):
    per_user = wide(spark, d).groupBy("user_id").agg(
        F.count("hr_mean").alias("hr_rows"), F.max("sleep_max").alias("sleep_top")
    )
    return quality.extremes(per_user, "user_id", ["hr_rows", "sleep_top"])


@query(
    "g21_value_counts",
    """SELECT 'hour' AS kind, CAST(hour(ts) AS VARCHAR) AS bucket, count(*) AS rows FROM events GROUP BY ALL UNION ALL
    SELECT 'weekday', strftime(ts, '%A'), count(*) FROM events GROUP BY ALL UNION ALL
    SELECT 'month', strftime(ts, '%B'), count(*) FROM events GROUP BY ALL UNION ALL
    SELECT 'level', event_type, count(*) FROM events GROUP BY ALL""",
)
def g21(spark, d):
    kinds = {
        "hour": F.hour("ts").cast("string"),
        "weekday": F.date_format("ts", "EEEE"),
        "month": F.date_format("ts", "MMMM"),
        "level": F.col("event_type"),
    }
    # one scan and one shuffle for all four counts
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("bucket")) for k, c in kinds.items()])
    long = events(spark, d).select(F.explode(entries).alias("e")).select("e.*")
    return long.groupBy("kind", "bucket").agg(F.count("*").alias("rows"))


_OUT = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (abs({c} - m) > 3 * s) AS outliers, "
    f"{r(f'count(*) FILTER (abs({c} - m) > 3 * s) * 100.0 / count({c})')} AS outlier_pct FROM "
    f"(SELECT {c}, avg({c}) OVER () AS m, stddev_samp({c}) OVER () AS s FROM wide)"
    for c in ("hr_mean", "hr_std", "steps_count", "sleep_max")
)


@query("g22_sigma_outliers", f"WITH {WIDE} {_OUT}")
def g22(spark, d):
    w = wide(spark, d).withColumn("constant", F.lit(1.0))
    return stats.sigma_outliers(w, ["hr_mean", "hr_std", "steps_count", "sleep_max", "constant"])


@query(
    "g23_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, {r(f'corr({a}, {b})')} AS r FROM lineitem" for a in NUM for b in NUM
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, 'flat' AS var_b, NULL AS r UNION ALL SELECT 'flat', '{a}', NULL" for a in NUM
    )
    + " UNION ALL SELECT 'flat', 'flat', NULL",
)
def g23(spark, d):
    li = table(spark, d, "lineitem").withColumn("flat", F.lit(7.0))
    return stats.correlation_matrix(li, [*NUM, "flat"])


# Columns of very different offsets and spreads, each without a value in another seventh of the rows; one is constant, two pairs never meet.
_WIDE = {
    f"c{k}": f"CASE WHEN (l_orderkey * {k} + l_linenumber) % 7 <> 0 THEN {10**(k % 5)} + (CAST(floor(l_extendedprice) AS BIGINT) * {k} + l_partkey) % {97 + k} END"
    for k in range(1, 71)
} | {
    "c71": "CASE WHEN l_linenumber = 1 THEN 0.1 ELSE NULL END",
    "c72": "CASE WHEN l_linenumber = 2 THEN l_quantity END",
    "c73": "CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 7.3 END",
}
_BESIDE = [(f"c{a}", f"c{b}") for a, b in [(k, 1 + k * 7 % 73) for k in range(1, 74)] + [(71, k) for k in range(1, 74, 9)] + [(72, 73), (73, 72), (71, 72), (72, 72)]]


@query(
    "g23_wide_correlation",
    f"""WITH w AS MATERIALIZED (SELECT {", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _WIDE.items())} FROM lineitem)
    SELECT DISTINCT * FROM ({" UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN {r('corr(a, b)')} END AS r "
        f"FROM (SELECT {a} AS a, {b} AS b FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in _BESIDE)})""",
)
def g23_wide(spark, d):
    """The full matrix of 73 columns; the rows of a spread of pairs, which SQL can check one by one."""
    li = table(spark, d, "lineitem").select(*[F.expr(e).cast("double").alias(c) for c, e in _WIDE.items()])
    asked = spark.createDataFrame(sorted(set(_BESIDE)), "var_a string, var_b string")
    return stats.correlation_matrix(li, list(_WIDE)).join(F.broadcast(asked), ["var_a", "var_b"], "left_semi")


def _derived(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        *NUM,
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net"),
        (-F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("charge"),
    )


DERIVED = (
    "x AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * (1 - l_discount) AS net, "
    "-l_extendedprice * (1 + l_tax) AS charge FROM lineitem)"
)
_DCOLS = [*NUM, "net", "charge"]


def _pair_sql(pairs) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r FROM x" for a, b in pairs)


@query(
    "g24_strong_pairs",
    f"""WITH {DERIVED}, p AS ({_pair_sql([(a, b) for i, a in enumerate(_DCOLS) for b in _DCOLS[i + 1:]])})
    SELECT var_a, var_b, {r('r')} AS r FROM p WHERE abs(r) > 0.7""",
)
def g24(spark, d):
    return stats.strong_pairs(_derived(spark, d), _DCOLS, 0.7)


_TC = _pair_sql([(t, c) for t in ("net", "charge") for c in NUM])


@query(
    "g25_target_correlations",
    f"""WITH {DERIVED}, p AS ({_TC}), k AS (SELECT 'abs' AS kind, *, row_number() OVER (PARTITION BY var_a ORDER BY abs(r) DESC,
    var_b) AS place FROM p UNION ALL SELECT 'bottom', *, row_number() OVER (PARTITION BY var_a ORDER BY r, var_b) FROM p
    UNION ALL SELECT 'top', *, row_number() OVER (PARTITION BY var_a ORDER BY r DESC, var_b) FROM p)
    SELECT kind, var_a AS target, var_b AS variable, {r('r')} AS r, CAST(place AS INTEGER) AS place FROM k WHERE place <= 3""",
)
def g25(spark, d):
    x = _derived(spark, d)
    return union_all(
        *[
            stats.target_correlations(x, NUM, ["net", "charge"], 3, by).withColumn("kind", F.lit(by))
            for by in ("abs", "bottom", "top")
        ]
    )


@query("g26_correlation_filled", f"WITH {WIDE} SELECT {r('corr(coalesce(hr_mean, 0), coalesce(sleep_max, 0))')} AS r FROM wide")
def g26(spark, d):
    return stats.correlation_filled(wide(spark, d), "hr_mean", "sleep_max")


@query(
    "g28_linear_trend",
    f"""SELECT l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)')} AS slope,
    {r('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, count(*) AS pairs FROM lineitem GROUP BY l_returnflag""",
)
def g28(spark, d):
    return stats.linear_trend(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query(
    "g29_skewness",
    f"SELECT event_type, {r('skewness(value)')} AS skew, count(value) AS n FROM events GROUP BY event_type",
)
def g29(spark, d):
    return events(spark, d).groupBy("event_type").agg(
        tf.sample_skewness(F.col("value")).alias("skew"), F.count("value").alias("n")
    )


@query(
    "g30_cohen_d",
    f"""WITH g AS (SELECT hour(ts) AS hour, count(*) FILTER (event_type = 'click') AS n1, count(*) FILTER (event_type = 'view')
    AS n2, avg(value) FILTER (event_type = 'click') AS a1, avg(value) FILTER (event_type = 'view') AS a2,
    var_samp(value) FILTER (event_type = 'click') AS v1, var_samp(value) FILTER (event_type = 'view') AS v2
    FROM events GROUP BY 1) SELECT hour, CASE WHEN n1 >= 2 AND n2 >= 2 THEN
    {r('(a1 - a2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif(n1 + n2 - 2, 0)), 0)')} END AS d FROM g""",
)
def g30(spark, d):
    kind = F.col("event_type")
    return events(spark, d).groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(
        stats.cohen_d(F.col("value"), kind == "click", kind == "view").alias("d")
    )


@query(
    "g31_flag_rate",
    f"""SELECT user_id, count(*) FILTER (value > 100) AS flagged, count(*) AS rows,
    {r('count(*) FILTER (value > 100) * 100.0 / count(*)')} AS rate_pct FROM events GROUP BY user_id""",
)
def g31(spark, d):
    e = events(spark, d).withColumn("flag", (F.col("value") > 100).cast("int"))
    return stats.flag_rate(e, ["user_id"], "flag")


def _latency_sql() -> str:
    names = {
        "mean": "avg(l)",
        "median": "quantile_cont(l, 0.5)",
        "std": "stddev_samp(l)",
        "min": "min(l)",
        "max": "max(l)",
        "q25": "quantile_cont(l, 0.25)",
        "q75": "quantile_cont(l, 0.75)",
    }
    s = ", ".join(f"{r(e)} AS {n}_s, {r(e + ' / 60')} AS {n}_min" for n, e in names.items())
    return f"""WITH t AS (SELECT (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000.0 AS raw, abs(raw) AS l
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT count(*) AS responses, count(*) FILTER (raw < 0) AS negatives, {s} FROM t"""


@query("g32_response_latency", _latency_sql())
def g32(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return stats.response_latency(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "o_orderdate", "l_shipdate")


@query(
    "g33_join_coverage",
    f"""WITH j AS (SELECT e.event_id, c.c_acctbal, c.c_mktsegment FROM events e LEFT JOIN (SELECT * FROM customer WHERE
    c_acctbal > 0) c ON e.user_id = c.c_custkey) SELECT 'c_acctbal' AS column_name, count(c_acctbal) AS matched_rows,
    count(*) AS total, {r('count(c_acctbal) * 100.0 / count(*)')} AS matched_pct FROM j UNION ALL
    SELECT 'c_mktsegment', count(c_mktsegment), count(*), {r('count(c_mktsegment) * 100.0 / count(*)')} FROM j""",
)
def g33(spark, d):
    dim = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal", "c_mktsegment")
    joined = left_lookup(events(spark, d), dim, {"user_id": "c_custkey"})
    return quality.join_coverage(joined, ["c_acctbal", "c_mktsegment"])


@query(
    "g34_dataset_overview",
    _profile_sql(
        f"""SELECT 'all' AS dataset, (SELECT count(*) FROM wide) AS rows, (SELECT count(DISTINCT user_id) FROM wide) AS users,
        count(*) AS features, {r('avg(pct)')} AS avg_completeness, {r('median(pct)')} AS median_completeness,
        count(*) FILTER (pct > 80) AS features_over_80, count(*) FILTER (pct > 50) AS features_over_50 FROM p"""
    ),
)
def g34(spark, d):
    return quality.overview(wide(spark, d), "all", "user_id", WIDE_FEATURES)


@query(
    "g35_histogram",
    f"""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT event_type, CAST(least(floor((value -
    lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, lo, (hi - lo) / 30 AS w FROM events CROSS JOIN b)
    SELECT event_type, bin, count(*) AS rows, {r('any_value(lo + bin * w)')} AS bin_start,
    {r('any_value(lo + (bin + 1) * w)')} AS bin_end FROM h GROUP BY event_type, bin""",
)
def g35(spark, d):
    return stats.histogram(events(spark, d), "value", 30, ["event_type"])


@query(
    "g36_user_profile",
    f"""WITH {WIDE} SELECT user_id, {r('avg(hr_mean)')} AS hr_mean_mean, {r('stddev_samp(hr_mean)')} AS hr_mean_std,
    {r('avg(steps_count)')} AS steps_count_mean, {r('stddev_samp(steps_count)')} AS steps_count_std FROM wide GROUP BY user_id""",
)
def g36(spark, d):
    return stats.user_profile(wide(spark, d), "user_id", ["hr_mean", "steps_count"])


@query(
    "g37_window_to_daily",
    f"""WITH {RESPONSES}, {SAMPLES}, f AS (SELECT q.user_id, q.event_id, q.assigned, avg(s.pulse) AS pulse_mean,
    count(*) AS record_count FROM responses q JOIN samples s ON s.user_id = q.user_id AND s.ts < q.response_ts AND
    s.ts >= q.response_ts - INTERVAL 12 HOUR AND CAST(s.ts AS DATE) = q.assigned GROUP BY ALL),
    m AS (SELECT f.user_id, CAST(q.response_ts AS DATE) AS date, avg(pulse_mean) AS pulse_mean, avg(record_count) AS records
    FROM f JOIN responses q USING (event_id) GROUP BY ALL)
    SELECT q.event_id, {r('m.pulse_mean')} AS pulse_mean, {r('m.records')} AS records FROM responses q LEFT JOIN m
    ON q.user_id = m.user_id AND CAST(q.response_ts AS DATE) = m.date""",
)
def g37(spark, d):
    from pulsegrid.operators.lookback import lookback_features

    q = responses(spark, d)
    features = lookback_features(
        q, samples(spark, d), "user_id", "event_id", "response_ts", "ts", ["pulse"], {"12h": 12 * 3600}
    ).withColumn("date", F.to_date("response_ts"))
    daily_means = features.groupBy("user_id", "date").agg(
        F.avg("pulse_mean").alias("pulse_mean"), F.avg("record_count").alias("records")
    )
    joined = left_lookup(q.withColumn("date", F.to_date("response_ts")), daily_means, ["user_id", "date"])
    return joined.select("event_id", "pulse_mean", "records")


@query(
    "g38_missing_by_weekday",
    f"""WITH {MISSING} SELECT CAST(isodow(day) - 1 AS INTEGER) AS weekday_no, strftime(day, '%A') AS weekday,
    count(*) AS missing_days FROM missing GROUP BY ALL""",
)
def g38(spark, d):
    return continuity.missing_by_weekday(event_days(spark, d), "user_id", "day")


@query(
    "g39_continuity_summary",
    f"""WITH {EVENT_DAYS}, d AS (SELECT user_id, day, count(*) AS n FROM event_days GROUP BY ALL), s AS (SELECT user_id,
    min(day) AS start_date, max(day) AS end_date, count(*) AS days_with_responses, count(*) FILTER (n > 1) AS
    days_with_multiple_responses, max(n) AS max_responses_per_day, date_diff('day', min(day), max(day)) + 1 AS total_days
    FROM d GROUP BY user_id) SELECT user_id, start_date, end_date, days_with_responses, days_with_multiple_responses,
    max_responses_per_day, CAST(total_days AS INTEGER) AS total_days, total_days - days_with_responses AS missing_days,
    {r('days_with_responses / total_days * 100')} AS completion_rate,
    CASE WHEN days_with_responses = total_days THEN 'PERFECT' WHEN days_with_responses / total_days >= 0.9 THEN 'EXCELLENT'
    WHEN days_with_responses / total_days >= 0.75 THEN 'GOOD' WHEN days_with_responses / total_days >= 0.5 THEN 'FAIR'
    ELSE 'POOR' END AS band FROM s""",
)
def g39(spark, d):
    return continuity.continuity_summary(event_days(spark, d), "user_id", "day")


@query(
    "g40_user_means_range",
    f"""WITH {WIDE}, c AS (SELECT user_id, count(hr_mean) AS a, count(steps_count) AS b FROM wide GROUP BY user_id)
    SELECT 'hr_mean' AS target, {r('avg(a)')} AS mean_count, min(a) AS min_count, max(a) AS max_count FROM c UNION ALL
    SELECT 'steps_count', {r('avg(b)')}, min(b), max(b) FROM c""",
)
def g40(spark, d):
    return stats.target_count_range(wide(spark, d), "user_id", ["hr_mean", "steps_count"])


@query(
    "g40_user_means",
    f"""WITH {WIDE} SELECT user_id, {r('avg(hr_mean)')} AS hr_mean, {r('avg(sleep_max)')} AS sleep_max,
    {r('avg(q_stress)')} AS q_stress FROM wide GROUP BY user_id""",
)
def g40_means(spark, d):
    return stats.user_means(wide(spark, d), "user_id", ["hr_mean", "sleep_max", "q_stress"])


@query(
    "h28_feature_name_parts",
    """SELECT DISTINCT e.event_type || '_' || s.suffix AS column_name, CASE WHEN e.event_type = 'view' THEN '5min' ELSE 'N/A'
    END AS "window", CASE WHEN e.event_type = 'view' THEN '' ELSE e.event_type END AS base_variable,
    s.suffix AS statistic FROM events e CROSS JOIN (VALUES ('mean'), ('std'), ('median')) s(suffix)
    WHERE e.event_type <> 'view' UNION SELECT DISTINCT 'view_' || 'pulse_' || suffix, '5min', 'pulse', suffix
    FROM events CROSS JOIN (VALUES ('mean'), ('std'), ('median')) s(suffix)""",
)
def h28(spark, d):
    kinds = events(spark, d).select("event_type").distinct()
    stem = F.when(F.col("event_type") == "view", "view_pulse").otherwise(F.col("event_type"))
    suffixes = F.array(*[F.lit(s) for s in ("mean", "std", "median")])
    names = kinds.select(F.explode(suffixes).alias("s"), stem.alias("stem")).select(
        F.concat_ws("_", "stem", "s").alias("column_name")
    )
    return names.withColumns(feature_name_parts(F.col("column_name"), {"view_": "5min"}))


@query(
    "w07_gaps",
    f"""WITH {MISSING}, g AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER)
    AS run FROM missing), i AS (SELECT user_id, min(day) AS start_day, max(day) AS end_day, count(*) AS days FROM g
    GROUP BY user_id, run) SELECT user_id, start_day, end_day, days, CAST(place AS INTEGER) AS place FROM (SELECT *,
    row_number() OVER (PARTITION BY user_id ORDER BY days DESC, start_day) AS place FROM i) WHERE place <= 10""",
)
def w07(spark, d):
    return continuity.longest_gaps(event_days(spark, d), "user_id", "day")


_STREAK = """g AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run
    FROM seen), i AS (SELECT user_id, min(day) AS start_day, max(day) AS end_day, count(*) AS days FROM g GROUP BY user_id, run)
    SELECT user_id, days, start_day, end_day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days DESC,
    start_day) AS k FROM i) WHERE k = 1"""


@query("w08_longest_streak", f"WITH {EVENT_DAYS}, seen AS (SELECT DISTINCT user_id, day FROM event_days), {_STREAK}")
def w08(spark, d):
    return continuity.longest_streak(event_days(spark, d), "user_id", "day")


@query(
    "w08_longest_streak_orders",
    f"WITH seen AS (SELECT DISTINCT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day FROM orders), {_STREAK}",
)
def w08_orders(spark, d):
    return continuity.longest_streak(order_days(spark, d), "user_id", "day")
