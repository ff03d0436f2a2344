"""Sources, sinks and column operators on the given tables."""

from __future__ import annotations

from datetime import date, time

from pyspark.sql import functions as F

from pulsegrid.catalog.base import WIDE, WIDE_FEATURES, events, query, r, table, wide
from pulsegrid.operators import columns as C
from pulsegrid.operators import daily, quality
from pulsegrid.session import scratch_path
from pulsegrid.sources import files, sinks

EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value"]
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


@query("s01_csv_scan", f"SELECT event_id, ts, user_id, event_type, {r('value')} AS value FROM events")
def s01(spark, d):
    path = sinks.write_table(events(spark, d).select(*EVENT_COLS), scratch_path(spark, "s01"), fmt="csv")
    return files.read_csv(spark, path, EVENT_SCHEMA)


@query(
    "s02_csv_semicolon",
    f"SELECT o_orderkey, o_custkey, o_orderstatus, {r('o_totalprice')} AS o_totalprice, o_orderpriority FROM orders",
)
def s02(spark, d):
    o = table(spark, d, "orders").drop("o_orderdate")
    path = scratch_path(spark, "s02")
    o.write.options(header=True, sep=";").csv(path)
    return files.read_csv(
        spark,
        path,
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
        sep=";",
    )


@query(
    "s03_json_scan",
    f"""SELECT event_id, user_id AS "who.user_id", event_type AS "who.kind",
    CAST(json_extract(props, '$.k') AS BIGINT) AS "who.extra.k", {r('value')} AS value FROM events""",
)
def s03(spark, d):
    nested = events(spark, d).select(
        "event_id",
        F.struct(
            "user_id",
            F.col("event_type").alias("kind"),
            F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k")).alias("extra"),
        ).alias("who"),
        "value",
    )
    path = scratch_path(spark, "s03")
    nested.write.json(path)
    schema = "event_id bigint, who struct<user_id:bigint, kind:string, extra:struct<k:bigint>>, value double"
    return files.read_json(spark, path, schema, multi_line=False)


@query(
    "s04_multi_file_scan",
    f"""SELECT ts AS "timestamp", CASE event_type WHEN 'click' THEN 'steps' ELSE 'activity_level' END AS source,
    event_id, {r('value')} AS value FROM events WHERE event_type IN ('click', 'view')""",
)
def s04(spark, d):
    base = scratch_path(spark, "s04")
    cols = [F.col("ts").alias("time"), "event_id", "value"]
    e = events(spark, d)
    # each source is a folder of CSV parts named like a source file
    sinks.write_table(e.where("event_type = 'click'").select(*cols), f"{base}/steps_2024.csv", fmt="csv")
    sinks.write_table(e.where("event_type = 'view'").select(*cols), f"{base}/activity_level_2024.csv", fmt="csv")
    # no time column: this source is dropped
    sinks.write_table(e.where("event_type = 'error'").select("value"), f"{base}/active_minutes_1.csv", fmt="csv")
    found = files.read_sources(spark, base)
    assert set(found) == {"steps", "activity_level"}, found
    both = found["steps"].unionByName(found["activity_level"])
    return both.select(
        "timestamp", "source", F.col("event_id").cast("bigint").alias("event_id"), F.col("value").cast("double").alias("value")
    )


@query(
    "s04_stacked_layouts",
    f"""SELECT ts AS "timestamp", 'steps' AS source, event_id,
    CASE WHEN event_type <> 'view' THEN {r('value')} END AS steps, CASE WHEN event_type = 'click' THEN user_id END AS device
    FROM events WHERE event_type IN ('click', 'signup', 'view')""",
)
def s04_layouts(spark, d):
    """Files of one pattern with a further column, another order, a missing one, and without a time column."""
    base = scratch_path(spark, "s04l")
    layouts = {
        "click": [F.col("ts").alias("timestamp"), "event_id", F.col("value").alias("steps"), F.col("user_id").alias("device")],
        "signup": [F.col("value").alias("steps"), "event_id", F.col("ts").alias("timestamp")],
        "view": ["event_id", F.col("ts").alias("timestamp")],
        "error": ["event_id", F.col("value").alias("steps")],
    }
    for kind, columns in layouts.items():
        sinks.write_table(events(spark, d).where(F.col("event_type") == kind).select(*columns), f"{base}/steps_{kind}.csv", fmt="csv")
    df = files.read_source(spark, base, "steps_*.csv", "steps")
    return df.select(
        "timestamp", "source", F.col("event_id").cast("bigint").alias("event_id"),
        F.col("steps").cast("double").alias("steps"), F.col("device").cast("bigint").alias("device"),
    )


@query("s05_stacked_tree", f"SELECT event_id, {r('value')} AS value, CASE WHEN user_id % 2 = 0 THEN user_id END AS user_id FROM events")
def s05_stacked(spark, d):
    path = scratch_path(spark, "s05s")
    e = events(spark, d)
    sinks.write_table(e.where("user_id % 2 = 0").select("user_id", "value", "event_type", "event_id"), f"{path}/a", fmt="csv")
    sinks.write_table(e.where("user_id % 2 <> 0").select("event_id", "value"), f"{path}/b", fmt="csv")
    return files.read_tree(spark, path, "event_id bigint, user_id bigint, value double")


@query(
    "s05_skipped_files",
    "SELECT reason, rows FROM (SELECT 'no known column' AS reason, count(*) AS rows FROM events WHERE event_type = 'error') WHERE rows > 0",
)
def s05_skipped(spark, d):
    """Files without a known column are reported, here with the rows that they hold."""
    path = scratch_path(spark, "s05r")
    e = events(spark, d)
    sinks.write_table(e.where("event_type <> 'error'").select("event_id", "value"), f"{path}/good", fmt="csv")
    sinks.write_table(e.where("event_type = 'error'").select("ts", "event_type").coalesce(1), f"{path}/other", fmt="csv")
    skipped = files.skipped_files(spark, path, "event_id bigint, value double")
    held = spark.read.option("header", True).csv(f"{path}/other").agg(F.count("*").alias("rows"))
    return skipped.select("reason").crossJoin(F.broadcast(held))


@query("s05_recursive_scan", f"SELECT event_id, user_id, {r('value')} AS value FROM events")
def s05(spark, d):
    path = sinks.write_table(
        events(spark, d).select("event_id", "user_id", "value", "event_type"),
        scratch_path(spark, "s05"),
        ["event_type"],
        "csv",
    )
    return files.read_tree(spark, path, "event_id bigint, user_id bigint, value double")


@query(
    "s06_file_name_columns",
    """SELECT event_id, CAST(day(ts) AS BIGINT) AS file_user, strftime(ts, '%Y-%m-%d') AS file_date FROM events""",
)
def s06(spark, d):
    name = F.concat_ws("_", F.lit("user"), F.date_format("ts", "'0'dd"), F.date_format("ts", "yyyy-MM-dd"))
    path = sinks.write_table(
        events(spark, d).select("event_id", name.alias("part")), scratch_path(spark, "s06"), ["part"], "csv"
    )
    scan = files.read_tree(spark, path, "event_id bigint", with_file=True)
    return files.with_file_columns(scan, level=-2).drop("source_file")


@query(
    "s07_name_category",
    """SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'hot' WHEN contains(o_orderpriority, 'HIGH')
    THEN 'hot' WHEN contains(o_orderpriority, '3-') THEN 'warm' WHEN contains(o_orderpriority, 'M') THEN 'other'
    ELSE 'Unknown' END AS category FROM orders""",
)
def s07(spark, d):
    keywords = {"URGENT": "hot", "HIGH": "hot", "3-": "warm", "M": "other"}
    o = table(spark, d, "orders")
    return o.select("o_orderkey", files.category_of(F.col("o_orderpriority"), keywords).alias("category"))


@query(
    "s08_partitioned_sink",
    f"SELECT event_type, count(*) AS rows, {r('sum(value)')} AS total FROM events GROUP BY event_type",
)
def s08(spark, d):
    path = sinks.write_table(events(spark, d), scratch_path(spark, "s08"), ["event_type"])
    back = spark.read.parquet(path)
    return back.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


@query(
    "s09_stored_statistics",
    f"""SELECT 'p_retailprice' AS column_name, {r('avg(p_retailprice)')} AS mean, {r('stddev_pop(p_retailprice)')} AS std,
    {r('quantile_cont(p_retailprice, 0.5)')} AS median FROM part UNION ALL
    SELECT 'p_size', {r('avg(p_size)')}, {r('stddev_pop(p_size)')}, {r('quantile_cont(p_size, 0.5)')} FROM part""",
)
def s09(spark, d):
    from pulsegrid.ml.fitted import fit_statistics

    fitted = fit_statistics(table(spark, d, "part"), ["p_retailprice", "p_size"])
    path = sinks.save_statistics(fitted, scratch_path(spark, "s09"))
    return sinks.load_statistics(spark, path)


@query("f01_required_columns", f"SELECT event_id, {r('value')} AS value FROM events")
def f01(spark, d):
    return C.require_columns(events(spark, d), ["event_id", "user_id", "ts", "value"]).select("event_id", "value")


@query("f02_first_matching", f"SELECT {r('sum(l_discount)')} AS total, 'l_discount' AS picked FROM lineitem")
def f02(spark, d):
    li = table(spark, d, "lineitem")
    col = C.first_matching(li.columns, [r"^q_", r"DISC", r"tax"])
    return li.agg(F.sum(col).alias("total"), F.lit(col).alias("picked"))


@query(
    "f03_detect_columns",
    "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY ALL",
)
def f03(spark, d):
    e = events(spark, d)
    user = C.detect_column(e.columns, ["userid", "user_id"], ["user"])
    ts = C.detect_column(e.columns, ["timestamp", "date"], ["ts", "time"])
    return e.groupBy(user, F.to_date(ts).alias("day")).agg(F.count("*").alias("rows"))


@query("f04_drop_columns", f"SELECT l_orderkey, l_linenumber, {r('l_tax')} AS l_tax FROM lineitem")
def f04(spark, d):
    li = table(spark, d, "lineitem")
    gone = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "not_there"]
    return C.drop_present(li, gone, containing=["PRICE", "disc", "flag", "status"])


@query("f05_exclude_keys", "SELECT user_id, count(*) AS rows FROM events WHERE user_id NOT IN (3, 7, 11) GROUP BY user_id")
def f05(spark, d):
    kept = C.exclude_keys(events(spark, d), "user_id", [3, 7, 11])
    return kept.groupBy("user_id").agg(F.count("*").alias("rows"))


@query(
    "f06_drop_null_rows",
    f"""WITH {WIDE} SELECT 'any' AS how, count(*) AS rows, {r('sum(q_stress)')} AS total FROM wide
    WHERE hr_mean IS NOT NULL AND hr_std IS NOT NULL UNION ALL SELECT 'all', count(*), {r('sum(q_stress)')} FROM wide
    WHERE hr_mean IS NOT NULL OR steps_count IS NOT NULL""",
)
def f06(spark, d):
    w = wide(spark, d)
    parts = [("any", ["hr_mean", "hr_std"]), ("all", ["hr_mean", "steps_count"])]
    out = [
        C.drop_null_rows(w, subset, how).agg(
            F.lit(how).alias("how"), F.count("*").alias("rows"), F.sum("q_stress").alias("total")
        )
        for how, subset in parts
    ]
    return out[0].unionByName(out[1])


@query(
    "f07_sentinel_null",
    f"""SELECT user_id, {r('avg(nullif(round(value), 50))')} AS value_mean,
    count(nullif(round(value), 50)) AS readings FROM events GROUP BY user_id""",
)
def f07(spark, d):
    e = C.sentinel_to_null(events(spark, d).withColumn("value", F.round("value")), "value", 50.0)
    return e.groupBy("user_id").agg(F.avg("value").alias("value_mean"), F.count("value").alias("readings"))


SLOT = "CAST(ts AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-25' AND isodow(ts) IN (1, 2, 4)"


@query(
    "f08_schedule_filter",
    f"""SELECT event_id, 'open' AS slot FROM events WHERE {SLOT} AND CAST(ts AS TIME) >= TIME '09:30:00'
    AND CAST(ts AS TIME) < TIME '14:15:00' UNION ALL
    SELECT event_id, 'closed' FROM events WHERE {SLOT} AND CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '14:15:00'""",
)
def f08(spark, d):
    e = events(spark, d)
    slot = (date(2024, 1, 4), date(2024, 1, 25), [0, 1, 3], time(9, 30), time(14, 15))
    opened = C.schedule_filter(e, "ts", *slot).select("event_id", F.lit("open").alias("slot"))
    closed = C.schedule_filter(e, "ts", *slot, end_inclusive=True).select("event_id", F.lit("closed").alias("slot"))
    return opened.unionByName(closed)


@query(
    "f09_completeness_filter",
    f"""WITH {WIDE} SELECT event_id, user_id, {r('hr_mean')} AS hr_mean, {r('hr_std')} AS hr_std,
    {r('steps_count')} AS steps_count, {r('sleep_max')} AS sleep_max, {r('q_stress')} AS q_stress FROM wide""",
)
def f09(spark, d):
    # spo2_min is filled in about 3 % of the rows
    w = wide(spark, d).drop("ts", "date")
    return C.keep_complete(w, 10.0, WIDE_FEATURES)


@query(
    "f10_midnight_split",
    f"""SELECT 'daily' AS part, date_trunc('day', ts) AS ts, event_id, {r('value')} AS v FROM events
    WHERE event_type = 'signup' UNION ALL SELECT 'series', ts, event_id, {r('value')} FROM events WHERE event_type = 'click'""",
)
def f10(spark, d):
    e = events(spark, d)
    signup = F.col("event_type") == "signup"
    midnight = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    series = e.select(
        "event_id",
        F.when(signup, midnight).otherwise(F.col("ts")).alias("ts"),
        F.when(signup, F.col("value")).alias("score"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("pulse"),
        F.lit(None).cast("double").alias("empty"),
    )
    daily_part, series_part = C.split_daily(series, "ts", ["event_id"])
    return daily_part.select(F.lit("daily").alias("part"), "ts", "event_id", F.col("score").alias("v")).unionByName(
        series_part.select(F.lit("series").alias("part"), "ts", "event_id", F.col("pulse").alias("v"))
    )


@query("f11_prefix_columns", f"SELECT user_id, event_id AS q_event_id, {r('value')} AS q_value FROM events")
def f11(spark, d):
    return C.prefix_columns(events(spark, d).select("user_id", "event_id", "value"), "q_", keep=["user_id"])


@query(
    "f12_column_roles",
    """SELECT * FROM (VALUES ('event_id', 'metadata'), ('user_id', 'metadata'), ('ts', 'metadata'), ('hr_mean', 'feature'),
    ('hr_std', 'feature'), ('steps_count', 'feature'), ('spo2_min', 'feature'), ('sleep_max', 'feature'),
    ('q_stress', 'target')) t(column_name, role) CROSS JOIN (SELECT count(*) AS rows FROM events)""",
)
def f12(spark, d):
    w = wide(spark, d)
    roles = C.column_roles(w, ["event_id", "user_id", "ts"])
    names = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("role")) for k, cs in roles.items() for c in cs])
    return w.agg(F.count("*").alias("rows")).select(F.explode(names).alias("e"), "rows").select("e.*", "rows")


@query(
    "f13_column_groups",
    f"""WITH {WIDE}, p AS (UNPIVOT (SELECT count(hr_mean) AS hr_mean, count(hr_std) AS hr_std, count(steps_count) AS
    steps_count, count(spo2_min) AS spo2_min, count(sleep_max) AS sleep_max FROM wide) ON COLUMNS(*) INTO NAME c VALUE n)
    SELECT CASE split_part(c, '_', 1) WHEN 'hr' THEN 'heart' ELSE split_part(c, '_', 1) END AS column_group,
    count(*) AS columns, CAST(sum(n) AS BIGINT) AS non_null,
    {r('avg(n * 100.0 / (SELECT count(*) FROM wide))')} AS avg_completeness FROM p GROUP BY 1""",
)
def f13(spark, d):
    profile = quality.column_completeness(wide(spark, d), WIDE_FEATURES)
    return quality.group_completeness(profile, {"hr_": "heart"})


@query("f14_reorder", f"SELECT {r('value')} AS value, event_id, user_id FROM events")
def f14(spark, d):
    e = events(spark, d)
    doubled = e.select("event_id", "user_id", "value", (F.col("value") * 2).alias("value"))
    return C.reorder(doubled, ["value", "missing", "event_id"])


@query("f15_clean_names", f"SELECT user_id, {r('value')} AS value FROM events")
def f15(spark, d):
    return C.clean_names(events(spark, d).select(F.col("user_id").alias("' user_id '"), F.col("value").alias('"value"')))


@query(
    "g03_counter_max",
    f"""SELECT user_id, CAST(ts AS DATE) AS date, {r('max(value)')} AS daily_total FROM events
    GROUP BY ALL""",
)
def g03(spark, d):
    e = events(spark, d).withColumn("date", F.to_date("ts"))
    return daily.daily_counter(e, ["user_id", "date"], "value", "daily_total")
