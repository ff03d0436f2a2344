"""Joins, set operations and ordering on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.base import (
    CALENDAR,
    CALENDAR_ROWS,
    EVENT_DAYS,
    HOLIDAY,
    RESPONSES,
    SAMPLES,
    calendar,
    calendar_rows,
    event_days,
    events,
    order_days,
    query,
    r,
    responses,
    samples,
    table,
)
from pulsegrid.operators import asof, lookback, ordering, sets, stats
from pulsegrid.operators import calendar as cal
from pulsegrid.operators import joins as J

HOURS = {"6h": 6 * 3600, "12h": 12 * 3600, "24h": 24 * 3600}
TYPES = ["click", "error", "purchase", "signup", "view"]


def hour_sources(spark, d):
    """One source per event type, unique per user and hour (the last event wins)."""
    e = events(spark, d).select(
        "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_id", "value", "event_type"
    )
    return {
        t: J.keep_one(e.where(F.col("event_type") == t).drop("event_type"), ["user_id", "hour"], "event_id")
        for t in TYPES
    }


_LAST = ", ".join(
    f"{r(f'''max(value) FILTER (event_type = '{t}')''')} AS {t}_value" for t in TYPES
)


@query(
    "j01_consolidate",
    f"""WITH e AS (SELECT user_id, date_trunc('hour', ts) AS hour, event_type, arg_max(value, event_id) AS value
    FROM events GROUP BY ALL) SELECT user_id, hour, {_LAST} FROM e GROUP BY user_id, hour""",
)
def j01(spark, d):
    sources = {t: df.drop("event_id") for t, df in hour_sources(spark, d).items()}
    return J.consolidate(sources, ["user_id", "hour"])


@query(
    "j02_left_composite",
    f"""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL)
    SELECT e.event_id, e.user_id, {r('e.value')} AS value, a.n AS daily_events, {r('a.v')} AS daily_value FROM events e
    LEFT JOIN (SELECT * FROM a WHERE n > 2) a ON e.user_id = a.user_id AND CAST(e.ts AS DATE) = a.date""",
)
def j02(spark, d):
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    daily = e.groupBy(F.col("user_id").alias("who"), F.col("day").alias("date")).agg(
        F.count("*").alias("daily_events"), F.sum("value").alias("daily_value")
    )
    out = J.left_lookup(e, daily.where("daily_events > 2"), {"user_id": "who", "day": "date"})
    return out.select("event_id", "user_id", "value", "daily_events", "daily_value")


@query(
    "j03_dimension_unknown",
    """SELECT e.event_id, coalesce(c.c_mktsegment, 'Unknown') AS segment FROM events e
    LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON e.user_id = c.c_custkey""",
)
def j03(spark, d):
    dim = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    out = J.left_lookup(events(spark, d), dim, {"user_id": "c_custkey"}, {"segment": "Unknown"})
    return out.select("event_id", "segment")


@query(
    "j04_key_lookup",
    """SELECT e.event_id, c.c_nationkey AS nation_key, coalesce(n.n_name, 'Unknown') AS nation FROM events e
    LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON e.user_id = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
)
def j04(spark, d):
    dim = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_nationkey").alias("nation_key"))
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    keyed = J.left_lookup(events(spark, d), dim, {"user_id": "c_custkey"})
    return J.left_lookup(keyed, nation, {"nation_key": "n_nationkey"}, {"nation": "Unknown"}).select(
        "event_id", "nation_key", "nation"
    )


@query(
    "j05_daily_measure_lookup",
    f"""WITH m AS (SELECT user_id, CAST(ts AS DATE) AS date, max(value) AS total FROM events WHERE event_type = 'signup'
    GROUP BY ALL), {RESPONSES} SELECT event_id, {r('m.total')} AS daily_total FROM responses q
    LEFT JOIN m ON q.user_id = m.user_id AND CAST(q.response_ts AS DATE) = m.date""",
)
def j05(spark, d):
    from pulsegrid.operators.daily import daily_counter

    steps = events(spark, d).where("event_type = 'signup'").withColumn("date", F.to_date("ts"))
    measure = daily_counter(steps, ["user_id", "date"], "value", "daily_total")
    q = responses(spark, d).withColumn("date", F.to_date("response_ts"))
    return J.left_lookup(q, measure, ["user_id", "date"]).select("event_id", "daily_total")


@query(
    "j06_outer_daily",
    f"""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS score FROM events WHERE event_type = 'signup'
    GROUP BY ALL), b AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS pulse FROM events WHERE event_type = 'click'
    GROUP BY ALL) SELECT user_id, date, {r('score')} AS score, {r('pulse')} AS pulse FROM a FULL JOIN b USING (user_id, date)""",
)
def j06(spark, d):
    e = events(spark, d).withColumn("date", F.to_date("ts"))
    keys = ["user_id", "date"]
    a = e.where("event_type = 'signup'").groupBy(*keys).agg(F.sum("value").alias("score"))
    b = e.where("event_type = 'click'").groupBy(*keys).agg(F.avg("value").alias("pulse"))
    return J.outer_by_key(a, b, keys)


_WIDTHS = "widths(time_window, w) AS (VALUES ('6h', INTERVAL 6 HOUR), ('12h', INTERVAL 12 HOUR), ('24h', INTERVAL 24 HOUR))"
_WINDOW = """FROM responses q CROSS JOIN widths JOIN samples s ON s.user_id = q.user_id AND s.ts >= q.response_ts - w
    AND s.ts < q.response_ts AND CAST(s.ts AS DATE) = q.assigned"""


@query(
    "j07_lookback_join",
    f"""WITH {RESPONSES}, {SAMPLES}, {_WIDTHS} SELECT q.event_id, q.user_id, q.response_ts, s.sample_id, s.ts,
    {r('s.pulse')} AS pulse, time_window, q.response_ts - w AS window_start, q.response_ts AS window_end {_WINDOW}""",
)
def j07(spark, d):
    out = lookback.lookback_join(responses(spark, d), samples(spark, d), "user_id", "response_ts", "ts", HOURS)
    return out.drop("oxygen", "target")


_METRICS = ", ".join(
    f"{r(f'{fn}(s.{m})')} AS {m}_{name}" if name != "count" else f"count(s.{m}) AS {m}_count"
    for m in ("pulse", "oxygen")
    for name, fn in (
        ("mean", "avg"),
        ("std", "stddev_samp"),
        ("min", "min"),
        ("max", "max"),
        ("median", "median"),
        ("count", "count"),
    )
)


@query(
    "g06_lookback_features",
    f"""WITH {RESPONSES}, {SAMPLES}, {_WIDTHS} SELECT q.user_id, q.event_id, q.response_ts, time_window,
    count(*) AS record_count, {_METRICS} {_WINDOW} GROUP BY ALL""",
)
def g06(spark, d):
    return lookback.lookback_features(
        responses(spark, d),
        samples(spark, d),
        "user_id",
        "event_id",
        "response_ts",
        "ts",
        ["pulse", "oxygen"],
        HOURS,
    )


def _asof_sides(spark, d):
    e = events(spark, d)
    cols = ["event_id", "user_id", "ts", "value"]
    return e.where("event_type = 'view'").select(*cols), e.where("event_type = 'click'").select(*cols)


def _asof_sql(by_user: bool, tolerance: str, body: str) -> str:
    part = "l.user_id = c.user_id AND" if by_user else ""
    return f"""WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view'),
    c AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'),
    b AS (SELECT l.*, c.ts AS bts, c.value AS bv FROM l ASOF LEFT JOIN c ON {part} l.ts >= c.ts),
    a AS (SELECT l.event_id, c.ts AS ats, c.value AS av FROM l ASOF LEFT JOIN c ON {part} l.ts <= c.ts),
    m AS (SELECT b.event_id, b.user_id, b.ts, b.value AS value_left,
      CASE WHEN bts IS NULL OR (ats - b.ts) < (b.ts - bts) THEN ats ELSE bts END AS ts_right,
      CASE WHEN bts IS NULL OR (ats - b.ts) < (b.ts - bts) THEN av ELSE bv END AS value_right
      FROM b JOIN a USING (event_id)),
    k AS (SELECT * FROM m WHERE abs(epoch_us(ts) - epoch_us(ts_right)) <= {tolerance})
    {body}"""


@query(
    "j08_nearest_asof",
    _asof_sql(
        True,
        "7200000000",
        f"""SELECT user_id, ts, event_id, {r('value_left')} AS value_left, ts_right, {r('value_right')} AS value_right,
        {r('abs(epoch_us(ts) - epoch_us(ts_right)) / 1000000.0')} AS gap_s FROM k""",
    ),
)
def j08(spark, d):
    left, right = _asof_sides(spark, d)
    return asof.nearest_asof(left, right, "ts", "event_id", ["value"], 7200, by=["user_id"])


@query(
    "g27_overlap_correlation",
    _asof_sql(
        False,
        "120000000",
        f"""SELECT count(*) AS aligned_rows, {r('corr(value_left, value_right)')} AS value_r,
        {r('avg(value_left - value_right)')} AS value_mean_diff FROM k""",
    ),
)
def g27(spark, d):
    left, right = _asof_sides(spark, d)
    aligned = asof.nearest_asof(left, right, "ts", "event_id", ["value"], 120)
    return stats.overlap_statistics(aligned, {"value": ("value_left", "value_right")})


_CAL = f"""WITH {CALENDAR}, {CALENDAR_ROWS}, f AS (SELECT rows.*,
    (SELECT arg_min(name, seq) FROM calendar c WHERE c.grp = rows.grp AND day BETWEEN s AND e) AS cal_in,
    (SELECT min(s) FROM calendar c WHERE c.grp = rows.grp AND s > day) AS next_start,
    (SELECT min(s) FROM calendar c WHERE c.grp = rows.grp AND s >= day) AS next_incl,
    (SELECT max(e) FROM calendar c WHERE c.grp = rows.grp AND e < day) AS prev_end,
    grp IN (SELECT grp FROM calendar) AS known, day BETWEEN DATE '{HOLIDAY[0]}' AND DATE '{HOLIDAY[1]}' AS holi FROM rows)"""


@query(
    "j09_interval_containment",
    f"{_CAL} SELECT event_id, CAST(cal_in IS NOT NULL AS INTEGER) AS inside, cal_in AS entry FROM f",
)
def j09(spark, d):
    out = cal.calendar_facts(calendar_rows(spark, d), calendar(spark), "grp", "day")
    return out.select("event_id", F.col("cal_in").isNotNull().cast("int").alias("inside"), F.col("cal_in").alias("entry"))


@query(
    "j10_next_previous",
    f"""{_CAL} SELECT event_id, CAST(next_start - day AS INTEGER) AS cal_next, CAST(day - prev_end AS INTEGER) AS cal_prev,
    CAST(next_incl - day AS INTEGER) AS cal_next_incl FROM f""",
)
def j10(spark, d):
    rows = calendar_rows(spark, d)
    strict = cal.calendar_facts(rows, calendar(spark), "grp", "day")
    strict = strict.select("event_id", "grp", "day", "cal_next", "cal_prev")
    incl = cal.calendar_facts(
        strict.withColumnsRenamed({"cal_next": "a", "cal_prev": "b"}), calendar(spark), "grp", "day", inclusive_next=True
    )
    return incl.select("event_id", F.col("a").alias("cal_next"), F.col("b").alias("cal_prev"), F.col("cal_next").alias("cal_next_incl"))


_CATEGORY = """CASE WHEN NOT known THEN '' WHEN cal_in IS NOT NULL THEN 'exam_week' WHEN holi THEN 'holiday'
    WHEN next_start - day <= 7 THEN 'pre_exam_week' WHEN next_start - day <= 14 THEN 'pre_exam_2weeks'
    WHEN next_start IS NOT NULL THEN 'normal' WHEN day - prev_end <= 7 THEN 'post_exam_week'
    WHEN day - prev_end <= 14 THEN 'post_exam_2weeks' WHEN prev_end IS NOT NULL THEN 'normal' ELSE '' END"""


@query("h17_calendar_category", f"{_CAL} SELECT event_id, {_CATEGORY} AS exam_proximity_category FROM f")
def h17(spark, d):
    out = cal.exam_features(calendar_rows(spark, d), calendar(spark), "grp", "day", HOLIDAY)
    return out.select("event_id", "exam_proximity_category")


@query(
    "h18_calendar_numbers",
    f"""{_CAL} SELECT event_id, CAST(cal_in IS NOT NULL AS INTEGER) AS is_exam_period,
    coalesce(cal_in, '') AS exam_period_name, CAST(known AND holi AS INTEGER) AS is_holiday,
    CAST(cal_in IS NOT NULL OR (known AND holi) AS INTEGER) AS is_holiday_period,
    CAST(next_start - day AS DOUBLE) AS days_to_next_exam, CAST(day - prev_end AS DOUBLE) AS days_since_last_exam,
    {r('(next_start - day) / 7.0')} AS weeks_to_next_exam, {r('(day - prev_end) / 7.0')} AS weeks_since_last_exam FROM f""",
)
def h18(spark, d):
    out = cal.exam_features(calendar_rows(spark, d), calendar(spark), "grp", "day", HOLIDAY)
    return out.drop("user_id", "grp", "day", "exam_proximity_category")


@query(
    "h19_window_flags",
    f"""{_CAL} SELECT event_id, CAST(cal_in IS NOT NULL AS INTEGER) AS is_exam_period, CAST(holi AS INTEGER) AS
    is_easter_break, CAST(coalesce(next_incl - day, -1) AS INTEGER) AS days_until_exam,
    CAST(coalesce(next_incl - day BETWEEN 0 AND 7, false) AS INTEGER) AS is_pre_exam_week FROM f""",
)
def h19(spark, d):
    out = cal.window_exam_flags(calendar_rows(spark, d), calendar(spark), "grp", "day", HOLIDAY)
    return out.drop("user_id", "grp", "day")


@query(
    "j11_normalised_ids",
    """SELECT 'matched' AS side, user_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id IN (SELECT c_custkey FROM
    customer WHERE c_acctbal > 0) UNION ALL SELECT 'unmatched', user_id FROM (SELECT DISTINCT user_id FROM events)
    WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def j11(spark, d):
    users = events(spark, d).select("user_id").distinct()
    padded = table(spark, d, "customer").where("c_acctbal > 0").select(F.format_string("%06d", "c_custkey").alias("code"))
    both = {
        "matched": J.matched(users, padded, "user_id", "code"),
        "unmatched": J.unmatched(users, padded, "user_id", "code"),
    }
    return sets.union_labelled(both, "side")


MISSING = f"""{EVENT_DAYS}, seen AS (SELECT DISTINCT user_id, day FROM event_days), missing AS (SELECT user_id, day FROM
    (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM seen GROUP BY user_id)
    ANTI JOIN seen USING (user_id, day))"""


@query("j12_missing_dates", f"WITH {MISSING} SELECT user_id, day FROM missing")
def j12(spark, d):
    return J.missing_dates(event_days(spark, d), "user_id", "day")


@query(
    "j12_missing_dates_long",
    """WITH seen AS (SELECT DISTINCT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day FROM orders),
    spine AS (SELECT user_id, date_diff('day', min(day), max(day)) + 1 - count(*) AS n FROM seen GROUP BY user_id)
    SELECT user_id, n AS missing_days FROM spine WHERE n > 0""",
)
def j12_long(spark, d):
    gaps = J.missing_dates(order_days(spark, d), "user_id", "day")
    return gaps.groupBy("user_id").agg(F.count("*").alias("missing_days"))


@query(
    "j13_attach_entity_result",
    f"""WITH p AS (SELECT user_id, avg(value) AS m, CASE WHEN avg(value) > 50 THEN 1 ELSE 0 END AS user_cluster FROM events
    GROUP BY user_id) SELECT event_id, {r('m')} AS user_mean, user_cluster FROM events JOIN p USING (user_id)""",
)
def j13(spark, d):
    e = events(spark, d)
    result = e.groupBy("user_id").agg(F.avg("value").alias("user_mean")).withColumn(
        "user_cluster", (F.col("user_mean") > 50).cast("int")
    )
    return J.attach_per_entity(e, result, "user_id", ["user_mean", "user_cluster"]).select(
        "event_id", "user_mean", "user_cluster"
    )


@query(
    "u01_union_columns",
    f"""SELECT user_id, {r('value')} AS value, NULL AS kind FROM events WHERE event_type = 'click' UNION ALL
    SELECT user_id, NULL, event_type FROM events WHERE event_type <> 'view'""",
)
def u01(spark, d):
    e = events(spark, d)
    a = e.where("event_type = 'click'").select("user_id", "value")
    return sets.union_all(a, e.where("event_type <> 'view'").select("user_id", F.col("event_type").alias("kind")))


@query(
    "u02_union_labelled",
    f"""SELECT event_id, {r('value')} AS value, 'early' AS period FROM events WHERE ts < TIMESTAMP '2024-01-10'
    UNION ALL SELECT event_id, {r('value')}, 'late' FROM events WHERE ts >= TIMESTAMP '2024-01-20'""",
)
def u02(spark, d):
    e = events(spark, d)
    early = e.where("ts < timestamp_ntz '2024-01-10 00:00:00'").select("event_id", "value")
    late = e.where("ts >= timestamp_ntz '2024-01-20 00:00:00'").select("event_id", "value")
    return sets.union_labelled({"early": early, "late": late}, "period")


@query(
    "u03_key_sets",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT o_custkey
    AS k FROM orders WHERE o_orderstatus = 'F') SELECT 'only_a' AS part, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
    UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""",
)
def u03(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    a, b = o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'")
    parts = {"only_a": sets.key_difference(a, b, "k"), "both": sets.key_intersection(a, b, "k")}
    return sets.union_labelled(parts, "part")


@query(
    "u03_split_overlap",
    """SELECT user_id, string_agg(DISTINCT part, ',' ORDER BY part) AS splits FROM (SELECT user_id, CASE WHEN ts < TIMESTAMP
    '2024-01-03' THEN 'train' WHEN ts < TIMESTAMP '2024-01-05' THEN 'val' ELSE 'test' END AS part FROM events)
    GROUP BY user_id HAVING count(DISTINCT part) > 1""",
)
def u03_overlap(spark, d):
    part = (
        F.when(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz"), "train")
        .when(F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz"), "val")
        .otherwise("test")
    )
    return sets.split_overlap(events(spark, d).select("user_id", part.alias("part")), "user_id", "part")


@query("o01_sort", f"SELECT user_id, ts, event_id, {r('value')} AS value FROM events")
def o01(spark, d):
    return ordering.sort_rows(events(spark, d).select("user_id", "ts", "event_id", "value"), "user_id", "-ts", "event_id")


@query("o02_top_k", f"SELECT event_id, {r('value')} AS value FROM events ORDER BY events.value DESC, event_id LIMIT 25")
def o02(spark, d):
    return ordering.top_k(events(spark, d).select("event_id", "value"), 25, "-value", "event_id")


@query("o03_weekday_order", "SELECT strftime(ts, '%A') AS weekday, count(*) AS rows FROM events GROUP BY 1")
def o03(spark, d):
    counts = events(spark, d).groupBy(F.date_format("ts", "EEEE").alias("weekday")).agg(F.count("*").alias("rows"))
    return ordering.sort_by_weekday(counts, "weekday")


@query("o04_abs_order", f"SELECT user_id, {r('sum(value - 50)')} AS excess FROM events GROUP BY user_id")
def o04(spark, d):
    sums = events(spark, d).groupBy("user_id").agg(F.sum(F.col("value") - 50).alias("excess"))
    return ordering.sort_by_abs(sums, "excess", "user_id")


@query(
    "o05_best_row",
    f"""SELECT event_type, event_id, {r('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type
    ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1""",
)
def o05(spark, d):
    rows = events(spark, d).select("event_type", "event_id", "value")
    return ordering.best_row(rows, "value", ["event_id"], ["event_type"])
