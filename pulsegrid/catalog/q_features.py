"""Ordered features, scalar functions, transforms and nested records on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.base import CALENDAR, CALENDAR_ROWS, WIDE, calendar, calendar_rows, events, query, r, table, wide
from pulsegrid.functions import encode, features, nested, temporal
from pulsegrid.functions import transforms as tf
from pulsegrid.operators import sequences as seq
from pulsegrid.operators import split
from pulsegrid.operators.calendar import calendar_facts
from pulsegrid.operators.joins import group_mean, keep_one
from pulsegrid.operators.ordered_features import OrderedFeatures
from pulsegrid.operators.sets import union_all

ORDER = ["ts", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
W3 = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


def rows(spark, d):
    return events(spark, d).select("event_id", "user_id", "ts", "value")


@query(
    "w01_keep_last",
    f"""SELECT user_id, date, 'last' AS keep, max(event_id) AS event_id, {r('arg_max(value, event_id)')} AS value FROM
    (SELECT *, CAST(ts AS DATE) AS date FROM events) GROUP BY ALL UNION ALL SELECT user_id, date, 'first', min(event_id),
    {r('arg_min(value, event_id)')} FROM (SELECT *, CAST(ts AS DATE) AS date FROM events) GROUP BY ALL""",
)
def w01(spark, d):
    e = events(spark, d).select("user_id", F.to_date("ts").alias("date"), "event_id", "value")
    return union_all(
        *[keep_one(e, ["user_id", "date"], "event_id", k).withColumn("keep", F.lit(k)) for k in ("last", "first")]
    )


@query(
    "w02_lags",
    f"SELECT event_id, {r(f'lag(value, 1) {W}')} AS value_lag1, {r(f'lag(value, 2) {W}')} AS value_lag2 FROM events",
)
def w02(spark, d):
    return seq.lags(rows(spark, d), ["user_id"], ORDER, "value", [1, 2]).drop("user_id", "ts", "value")


@query("w03_first_difference", f"SELECT event_id, {r(f'value - lag(value) {W}')} AS value_change FROM events")
def w03(spark, d):
    out = seq.first_difference(rows(spark, d), ["user_id"], ORDER, {"value": "value_change"})
    return out.select("event_id", "value_change")


@query(
    "w04_rolling",
    f"SELECT event_id, {r(f'avg(value) {W3}')} AS value_rolling_mean, {r(f'stddev_samp(value) {W3}')} AS value_rolling_std FROM events",
)
def w04(spark, d):
    return seq.rolling(rows(spark, d), ["user_id"], ORDER, "value", 3).drop("user_id", "ts", "value")


@query("w05_sequence_position", f"SELECT event_id, row_number() {W} - 1 AS seq_position FROM events")
def w05(spark, d):
    return seq.sequence_position(rows(spark, d), ["user_id"], ORDER).select("event_id", "seq_position")


@query("w06_group_mean", f"SELECT event_id, {r('avg(value) OVER (PARTITION BY user_id)')} AS user_mean FROM events")
def w06(spark, d):
    return group_mean(rows(spark, d), ["user_id"], {"value": "user_mean"}).select("event_id", "user_mean")


@query(
    "w09_median_spacing",
    f"""WITH g AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)))
    / 1000000.0 AS gap FROM events) SELECT event_type, {r('quantile_cont(gap, 0.5)')} AS median_spacing_s FROM g
    GROUP BY event_type""",
)
def w09(spark, d):
    return seq.median_spacing(events(spark, d), ["event_type"], "ts", "event_id")


@query(
    "w10_fill",
    f"""WITH {WIDE} SELECT event_id, {r('''coalesce(last_value(hr_std IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts,
    event_id), first_value(hr_std IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND
    UNBOUNDED FOLLOWING), avg(hr_std) OVER ())''')} AS hr_std,
    {r('''coalesce(last_value(spo2_min IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts,
    event_id), first_value(spo2_min IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND
    UNBOUNDED FOLLOWING), avg(spo2_min) OVER ())''')} AS spo2_min FROM wide""",
)
def w10(spark, d):
    w = wide(spark, d).select("event_id", "user_id", "ts", "hr_std", "spo2_min")
    return seq.fill_missing(w, ["user_id"], ORDER, ["hr_std", "spo2_min"]).drop("user_id", "ts")


@query(
    "w11_sliding_sequences",
    f"""WITH l AS (SELECT user_id, ts, event_id, lag(value, 2) {W} AS v0, lag(value, 1) {W} AS v1, value AS v2,
    lag(event_id, 2) {W} AS e0, lag(event_id, 1) {W} AS e1 FROM events) SELECT user_id, ts, event_id,
    CAST([[v0, e0], [v1, e1], [v2, event_id]] AS DOUBLE[][]) AS sequence, {r('v2')} AS label FROM l WHERE e0 IS NOT NULL""",
)
def w11(spark, d):
    e = rows(spark, d).withColumn("num", F.col("event_id"))
    return seq.sliding_sequences(e, ["user_id"], ORDER, ["value", "num"], "value", 3)


@query(
    "w13_ordered_features",
    f"""SELECT event_id, {r(f'lag(value, 1) {W}')} AS value_lag1, {r(f'lag(value, 2) {W}')} AS value_lag2,
    {r(f'value - lag(value) {W}')} AS value_change, {r(f'avg(value) {W3}')} AS value_rolling_mean,
    {r(f'stddev_samp(value) {W3}')} AS value_rolling_std, CASE WHEN lag(event_id, 1) {W} IS NOT NULL THEN
    CAST([lag(value, 1) {W}, value] AS DOUBLE[]) END AS last_two, row_number() {W} - 1 AS seq_position FROM events""",
)
def w13(spark, d):
    made = OrderedFeatures(rows(spark, d), ["user_id"], ORDER).lags("value", [1, 2]).differences({"value": "value_change"})
    made = made.rolling("value", 3).sequences(["value"], 2, "last_two").position().table()
    return made.drop("user_id", "ts", "value").withColumn("last_two", F.flatten("last_two"))


@query(
    "w12_chronological_split",
    """WITH k AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events)
    SELECT event_id, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n *
    0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""",
)
def w12(spark, d):
    return split.chronological_split(rows(spark, d), ORDER).select("event_id", "split")


@query(
    "h01_epoch",
    """SELECT event_id, ts, CAST(NULL AS TIMESTAMP) AS bad FROM events""",
)
def h01(spark, d):
    e = events(spark, d)
    seconds = F.format_string("%.6f", temporal.micros(F.col("ts")) / 1_000_000)
    text = e.select("event_id", seconds.alias("s"), F.concat(F.lit("x"), seconds).alias("wrong"))
    return text.select(
        "event_id",
        temporal.epoch_to_timestamp(F.col("s")).alias("ts"),
        temporal.epoch_to_timestamp(F.col("wrong")).alias("bad"),
    )


@query(
    "h02_tolerant_parse",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN ts
    WHEN 3 THEN date_trunc('second', ts) ELSE NULL END AS parsed, date_trunc('second', ts) AS combined FROM events""",
)
def h02(spark, d):
    ts, kind = F.col("ts"), F.col("event_id") % 5
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    later = F.date_format(ts + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(kind == 0, F.concat(iso, F.lit("123Z")))  # nanoseconds and an offset
        .when(kind == 1, F.date_format("ts", "MM/dd/yy HH:mm:ss"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 3, F.concat(later, F.lit("+02:00")))
        .otherwise(F.lit("soon"))
    )
    e = events(spark, d).select(
        "event_id", text.alias("t"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm:ss").alias("clock")
    )
    return e.select(
        "event_id",
        temporal.parse_timestamp(F.col("t")).alias("parsed"),
        temporal.date_and_time(F.col("day"), F.col("clock")).alias("combined"),
    )


@query("h03_format", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS timestamp_fmt FROM events")
def h03(spark, d):
    return events(spark, d).select("event_id", temporal.format_timestamp(F.col("ts")).alias("timestamp_fmt"))


@query(
    "h04_time_parts",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, strftime(ts, '%A') AS day_name, strftime(ts, '%B') AS month_name,
    CAST(ts AS DATE) AS date, CAST(ts = date_trunc('day', ts) AS INTEGER) AS midnight,
    1 AS cut_midnight FROM events""",
)
def h04(spark, d):
    ts = F.col("ts")
    return events(spark, d).select(
        "event_id",
        F.hour("ts").alias("hour"),
        temporal.day_name(ts).alias("day_name"),
        temporal.month_name(ts).alias("month_name"),
        F.to_date("ts").alias("date"),
        temporal.is_midnight(ts).cast("int").alias("midnight"),
        temporal.is_midnight(F.date_trunc("day", ts).cast("timestamp_ntz")).cast("int").alias("cut_midnight"),
    )


@query(
    "h05_day_cutoff",
    """SELECT event_id, CASE WHEN hour(ts) < 2 THEN ts - INTERVAL 1 DAY ELSE ts END AS timestamp_for_day,
    CAST(CASE WHEN hour(ts) < 2 THEN ts - INTERVAL 1 DAY ELSE ts END AS DATE) AS date_only,
    strftime(CASE WHEN hour(ts) < 2 THEN ts - INTERVAL 1 DAY ELSE ts END, '%A') AS weekday FROM events""",
)
def h05(spark, d):
    at = temporal.assigned_timestamp(F.col("ts"))
    return events(spark, d).select(
        "event_id",
        at.alias("timestamp_for_day"),
        temporal.assigned_date(F.col("ts")).alias("date_only"),
        temporal.day_name(at).alias("weekday"),
    )


@query(
    "h06_unified_date",
    """SELECT event_id, CASE event_type WHEN 'click' THEN CAST(ts AS DATE) WHEN 'view' THEN CAST(ts AS DATE) + 1 END AS
    unified_date FROM events""",
)
def h06(spark, d):
    kind = F.col("event_type")
    e = events(spark, d).select(
        "event_id",
        F.when(kind == "click", F.to_date("ts")).cast("string").alias("a"),
        F.when(kind == "view", F.date_add(F.to_date("ts"), 1)).cast("string").alias("b"),
        F.when(kind == "error", F.lit("no date")).alias("c"),
    )
    return e.select("event_id", encode.unified_date([F.col("a"), F.col("b"), F.col("c")]).alias("unified_date"))


@query(
    "h07_fixed_encoding",
    """SELECT 'code' AS part, event_type AS value, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN
    2 END AS code, count(*) AS rows FROM events GROUP BY ALL UNION ALL SELECT 'unmapped', event_type, NULL, count(*)
    FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL""",
)
def h07(spark, d):
    codes = {"click": 0, "view": 1, "signup": 2}
    e = events(spark, d)
    coded = e.groupBy(F.col("event_type").alias("value"), encode.encode_map(F.col("event_type"), codes).alias("code"))
    left = encode.unmapped(e, "event_type", codes).withColumnRenamed("event_type", "value")
    return union_all(
        coded.agg(F.count("*").alias("rows")).withColumn("part", F.lit("code")), left.withColumn("part", F.lit("unmapped"))
    )


@query(
    "h08_label_encoding",
    """WITH f AS (SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1), m AS (SELECT event_type,
    CAST(row_number() OVER (ORDER BY first_seen) - 1 AS INTEGER) AS code FROM f)
    SELECT event_id, code AS event_type_encoded, CAST(NULL AS INTEGER) AS user_id_encoded FROM events JOIN m USING (event_type)""",
)
def h08(spark, d):
    e = events(spark, d).select("event_id", "event_type", F.concat(F.lit("u"), F.col("event_id")).alias("user_id"))
    coded = encode.label_encode(e, "event_type", "event_id")
    # more than 20 values: no codes
    return encode.label_encode(coded, "user_id", "event_id").select("event_id", "event_type_encoded", "user_id_encoded")


@query(
    "h09_log_columns",
    f"SELECT event_id, {r('ln(1 + value)')} AS value_log FROM events",
)
def h09(spark, d):
    e = events(spark, d).select("event_id", "value", (F.col("user_id") * 1.0).alias("even"), (F.col("value") - 10).alias("shifted"))
    return tf.add_log_columns(e, ["value", "even", "shifted"]).drop("value", "even", "shifted")


@query(
    "h10_median_imputation",
    f"WITH {WIDE} SELECT event_id, {r('coalesce(hr_mean, (SELECT median(hr_mean) FROM wide))')} AS hr_mean FROM wide",
)
def h10(spark, d):
    return tf.impute_median(wide(spark, d).select("event_id", "hr_mean"), ["hr_mean"])


@query(
    "h11_winsorise",
    f"""WITH {WIDE}, q AS (SELECT quantile_cont(hr_mean, 0.001) AS lo, quantile_cont(hr_mean, 0.999) AS hi FROM wide)
    SELECT event_id, CASE WHEN hr_mean IS NOT NULL THEN {r('least(greatest(hr_mean, lo), hi)')} END AS hr_mean FROM wide, q""",
)
def h11(spark, d):
    return tf.winsorise(wide(spark, d).select("event_id", "hr_mean"), ["hr_mean"])


@query(
    "h12_zscore",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {r('(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()')}
    AS l_quantity_z, 0.0::DOUBLE AS flat_z FROM lineitem""",
)
def h12(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.lit(3.0).alias("flat"))
    return tf.zscore(li, ["l_quantity", "flat"]).drop("l_quantity", "flat")


def _cuts(col: str, lo: str, hi: str, rel: str) -> str:
    return f"q AS (SELECT quantile_cont({col}, {lo}) AS lo, quantile_cont({col}, {hi}) AS hi FROM {rel})"


@query(
    "h13_three_classes",
    f"""WITH {_cuts('o_totalprice', '0.3333', '0.6667', 'orders')}, q2 AS (SELECT quantile_cont(o_totalprice, 0.33) AS lo2,
    quantile_cont(o_totalprice, 0.67) AS hi2 FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice <= lo THEN 0
    WHEN o_totalprice <= hi THEN 1 ELSE 2 END AS class_window, CASE WHEN o_totalprice <= lo2 THEN 0 WHEN o_totalprice <= hi2
    THEN 1 ELSE 2 END AS class_daily FROM orders, q, q2""",
)
def h13(spark, d):
    o, c = table(spark, d, "orders"), F.col("o_totalprice")
    return o.select(
        "o_orderkey",
        tf.three_classes(c, tf.tercile_cuts(o, "o_totalprice", 0.3333, 0.6667)).alias("class_window"),
        tf.three_classes(c, tf.tercile_cuts(o, "o_totalprice", 0.33, 0.67)).alias("class_daily"),
    )


@query(
    "h14_binary_inclusive",
    f"""WITH {_cuts('l_quantity', '0.33', '0.67', 'lineitem')} SELECT l_orderkey, l_partkey, l_linenumber,
    CAST(l_quantity > hi AS INTEGER) AS high FROM lineitem, q WHERE l_quantity <= lo OR l_quantity >= hi""",
)
def h14(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    cuts = tf.tercile_cuts(li, "l_quantity", 0.33, 0.67)
    return tf.binary_drop_middle(li, "l_quantity", "high", cuts, strict=False).drop("l_quantity")


@query(
    "h15_binary_strict",
    f"""WITH {_cuts('l_quantity', '0.33', '0.67', 'lineitem')} SELECT l_orderkey, l_partkey, l_linenumber,
    CAST(l_quantity > hi AS INTEGER) AS high FROM lineitem, q WHERE l_quantity < lo OR l_quantity > hi""",
)
def h15(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    cuts = tf.tercile_cuts(li, "l_quantity", 0.33, 0.67)
    return tf.binary_drop_middle(li, "l_quantity", "high", cuts, strict=True).drop("l_quantity")


@query(
    "h16_binary_median",
    "SELECT o_orderkey, CAST(o_totalprice >= (SELECT median(o_totalprice) FROM orders) AS INTEGER) AS high FROM orders",
)
def h16(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return tf.binary_at_median(o, "o_totalprice", "high").drop("o_totalprice")


STAGE = {"click": "deep", "view": "rem", "signup": "light", "error": "wake"}


def level_records(spark, d, python_literal: bool = False):
    """Nested stage records made of a user's events of a day.

    All non-purchase events are segments, purchases are micro-events; a segment lasts ``value`` minutes.
    A day of one user is a small group.
    """
    stage = F.create_map(*[F.lit(x) for kv in STAGE.items() for x in kv])
    e = events(spark, d).select(
        "user_id",
        F.to_date("ts").alias("day"),
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("dateTime"),
            F.try_element_at(stage, F.col("event_type")).alias("level"),
            (F.col("value") * 60).alias("seconds"),
        ).alias("seg"),
        "event_type",
        "value",
    )
    kind = F.col("event_type")
    days = e.groupBy("user_id", "day").agg(
        F.array_sort(F.collect_list(F.when(kind != "purchase", F.col("seg")))).alias("data"),
        F.array_sort(F.collect_list(F.when(kind == "purchase", F.col("seg")))).alias("shortData"),
        *[F.sum(F.when(kind == k, F.col("value"))).alias(f"m_{s}") for k, s in STAGE.items()],
        *[F.count_if(kind == k).alias(f"n_{s}") for k, s in STAGE.items()],
    )
    entries = [
        F.when(
            F.col(f"n_{s}") > 0,
            F.struct(
                F.lit(s).alias("key"),
                F.struct(
                    F.col(f"n_{s}").cast("double").alias("count"),
                    F.col(f"m_{s}").alias("minutes"),
                    F.lit(40.0).alias("thirtyDayAvgMinutes"),
                ).alias("value"),
            ),
        )
        for s in STAGE.values()
    ]
    summary = F.map_from_entries(F.array_compact(F.array(*entries)))
    text = F.to_json(F.struct(summary.alias("summary"), "data", "shortData"))
    if python_literal:
        # quotes and words of a Python literal around the same content
        text = F.concat(F.lit("{'valid': True, 'note': None, "), F.substr(F.replace(text, F.lit('"'), F.lit("'")), F.lit(2)))
    return days.select("user_id", "day", text.alias("levels"))


_SUM = ", ".join(
    f"{r(f'''sum(value) FILTER (event_type = '{k}')''')} AS {n}_minutes, "
    f"CAST(nullif(count(*) FILTER (event_type = '{k}'), 0) AS DOUBLE) AS {n}_count, "
    f"CASE WHEN count(*) FILTER (event_type = '{k}') > 0 THEN 40.0::DOUBLE END AS {n}_30day_avg, "
    f"{r(f'''nullif(sum(value) FILTER (event_type = '{k}'), 0) - 40''')} AS {n}_deviation_from_avg"
    for k, n in (("click", "deep_sleep"), ("view", "rem_sleep"), ("signup", "light_sleep"), ("error", "wake"))
)


@query("h20_stage_summary", f"SELECT user_id, CAST(ts AS DATE) AS day, {_SUM} FROM events GROUP BY ALL")
def h20(spark, d):
    rec = level_records(spark, d, python_literal=True).withColumn(
        "levels", nested.parse_levels(F.col("levels"), python_literal=True)
    )
    cols = nested.stage_summary(F.col("levels"), extra=())
    return rec.select("user_id", "day", *[c.alias(n) for n, c in cols.items()])


def _seg(k: str, s: str) -> str:
    f = f"FILTER (event_type = '{k}')"
    return (
        f"{r(f'avg(value) {f}')} AS {s}_avg_segment_duration_minutes, "
        f"CASE WHEN count(*) {f} = 1 THEN 0.0 ELSE {r(f'stddev_pop(value) {f}')} END AS {s}_segment_duration_std"
    )


def _first(k: str, s: str) -> str:
    return (
        f"{r(f'''(epoch_us(min(ts) FILTER (event_type = '{k}')) - epoch_us(min(ts))) / 60000000.0''')} "
        f"AS minutes_to_first_{s}_sleep"
    )


@query(
    "h21_segment_features",
    f"""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS INTEGER) AS sleep_stage_transitions,
    {_first('click', 'deep')}, {_first('view', 'rem')}, {', '.join(_seg(k, v) for k, v in STAGE.items())},
    CASE arg_max(event_type, ts) WHEN 'click' THEN 'deep' WHEN 'view' THEN 'rem' WHEN 'signup' THEN 'light' ELSE 'wake' END
    AS last_sleep_stage FROM events WHERE event_type <> 'purchase' GROUP BY ALL)
    SELECT d.user_id, d.day, s.* EXCLUDE (user_id, day) FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) d
    LEFT JOIN s ON s.user_id = d.user_id AND s.day = d.day""",
)
def h21(spark, d):
    rec = level_records(spark, d).withColumn("levels", nested.parse_levels(F.col("levels")))
    cols = nested.segment_features(F.col("levels"))
    return rec.select("user_id", "day", *[c.alias(n) for n, c in cols.items()])


@query(
    "h22_micro_events",
    f"""WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') AS n,
    sum(value) FILTER (event_type = 'purchase') AS v, sum(value) FILTER (event_type <> 'purchase') AS sleep,
    max(value) FILTER (event_type = 'purchase') AS top FROM events GROUP BY ALL)
    SELECT user_id, day, CAST(nullif(n, 0) AS INTEGER) AS micro_awakening_count, {r('v')} AS micro_awakening_total_minutes,
    {r('nullif(n, 0) / nullif(sleep / 60, 0)')} AS micro_awakening_per_hour,
    {r('v * 60 / nullif(n, 0)')} AS micro_awakening_avg_duration_seconds,
    {r('top * 60')} AS micro_awakening_max_duration_seconds FROM m""",
)
def h22(spark, d):
    rec = level_records(spark, d).withColumn("levels", nested.parse_levels(F.col("levels")))
    cols = nested.micro_event_features(F.col("levels"))
    return rec.select("user_id", "day", *[c.alias(n) for n, c in cols.items()])


@query(
    "h23_baseline_deviation",
    f"""WITH b AS (SELECT user_id, avg(value) AS b FROM events GROUP BY user_id) SELECT event_id,
    {r('(value - b) / (b + 1e-6)')} AS deviation, {r('value / (b + 1)')} AS ratio, {r('value - b')} AS difference
    FROM events JOIN b USING (user_id)""",
)
def h23(spark, d):
    e = group_mean(rows(spark, d), ["user_id"], {"value": "b"})
    v, b = F.col("value"), F.col("b")
    return e.select(
        "event_id",
        features.relative_deviation(v, b).alias("deviation"),
        features.baseline_ratio(v, b).alias("ratio"),
        features.baseline_difference(v, b).alias("difference"),
    )


@query(
    "h24_composites",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, {r('l_discount * l_quantity / (l_extendedprice + 1)')} AS sleep_quality,
    {r('l_extendedprice / (l_suppkey + 1)')} AS activity_intensity, {r('l_quantity / (l_partkey + 1)')} AS autonomic_balance,
    {r('(l_tax + l_quantity) / (l_extendedprice + 1)')} AS recovery_score, {r('l_partkey / (l_quantity + 1)')} AS cardio_stress,
    {r('l_linenumber / (l_extendedprice / 60 + 1)')} AS sleep_fragmentation, {r('l_suppkey / (l_tax + 1)')} AS resp_efficiency
    FROM lineitem""",
)
def h24(spark, d):
    li = table(spark, d, "lineitem")
    stand_in = {
        "efficiency": "l_discount",
        "deep": "l_quantity",
        "rem": "l_tax",
        "duration": "l_extendedprice",
        "steps": "l_extendedprice",
        "sedentary": "l_suppkey",
        "rmssd": "l_quantity",
        "heart_rate": "l_partkey",
        "wakes": "l_linenumber",
        "spo2": "l_suppkey",
        "breathing": "l_tax",
    }
    cols = features.composites({k: F.col(c) for k, c in stand_in.items()})
    return li.select("l_orderkey", "l_partkey", "l_linenumber", *[c.alias(n) for n, c in cols.items()])


@query(
    "h25_proximity",
    f"""WITH {CALENDAR}, {CALENDAR_ROWS}, f AS (SELECT event_id, (SELECT min(s) FROM calendar c WHERE c.grp = rows.grp AND
    s > day) - day AS n FROM rows) SELECT event_id, {r('1.0 / (coalesce(n, 365) + 1)')} AS proximity,
    {r('1.0 / (greatest(coalesce(n, 365), 1) + 1)')} AS clipped FROM f""",
)
def h25(spark, d):
    facts = calendar_facts(calendar_rows(spark, d), calendar(spark), "grp", "day")
    n = F.col("cal_next")
    return facts.select("event_id", features.proximity(n).alias("proximity"), features.proximity(n, clip_at=1).alias("clipped"))


@query("h26_interaction", f"SELECT event_id, {r('value * user_id')} AS value_x_user FROM events")
def h26(spark, d):
    return events(spark, d).select("event_id", features.interaction(F.col("value"), F.col("user_id")).alias("value_x_user"))


@query(
    "h27_numeric_coercion",
    f"SELECT event_id, CASE WHEN event_type <> 'error' THEN {r('value')} END AS value FROM events",
)
def h27(spark, d):
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return events(spark, d).select("event_id", encode.to_number(text).alias("value"))
