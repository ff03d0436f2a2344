"""Edge cases with values worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import encode, nested, temporal
from pulsegrid.functions import transforms as tf
from pulsegrid.ml import metrics
from pulsegrid.operators import asof, calendar, columns, continuity, daily, lookback, quality, sequences, stats
from pulsegrid.operators.joins import consolidate, keep_one, missing_dates, normalised_id
from pulsegrid.sources import files, sinks


def ts(text):
    return dt.datetime.fromisoformat(text)


RESP = "rid int, user int, at timestamp_ntz"
SAMP = "user int, ts timestamp_ntz, v double"


def windows(spark, response, stamps, same=True, width=600):
    responses = spark.createDataFrame([(1, 1, ts(response))], RESP)
    samples = spark.createDataFrame([(1, ts(s), float(i)) for i, s in enumerate(stamps)], SAMP)
    out = lookback.lookback_join(responses, samples, "user", "at", "ts", {"w": width}, same)
    return sorted(r["ts"].isoformat(sep=" ") for r in out.collect())


def test_window_is_half_open(spark):
    got = windows(spark, "2024-03-05 10:00:00", ["2024-03-05 09:50:00", "2024-03-05 10:00:00", "2024-03-05 09:49:59.999999"])
    assert got == ["2024-03-05 09:50:00"]


def test_response_after_midnight_sees_only_the_day_before(spark):
    stamps = ["2024-03-04 23:55:00", "2024-03-05 00:03:00"]
    assert windows(spark, "2024-03-05 00:05:00", stamps) == ["2024-03-04 23:55:00"]
    assert windows(spark, "2024-03-05 00:05:00", stamps, same=False) == stamps
    # 01:30 belongs to the day before, so a sample of 01:28 is outside
    assert windows(spark, "2024-03-05 01:30:00", ["2024-03-05 01:28:00"]) == []
    # after the cut-off a window that crosses midnight is cut
    assert windows(spark, "2024-03-05 02:10:00", ["2024-03-04 23:50:00", "2024-03-05 02:00:00"], width=3 * 3600) == [
        "2024-03-05 02:00:00"
    ]


@pytest.mark.parametrize("hot", [False, True])
def test_window_features(spark, hot, request):
    if hot:
        request.getfixturevalue("small_groups")
    responses = spark.createDataFrame([(1, 1, ts("2024-03-05 10:00:00")), (2, 1, ts("2024-03-05 11:00:00"))], RESP)
    rows = [(1, ts("2024-03-05 09:52:00"), 4.0), (1, ts("2024-03-05 09:58:00"), None), (1, ts("2024-03-05 09:59:00"), 7.0)]
    samples = spark.createDataFrame(rows, SAMP).withColumn("none", F.lit(None).cast("double"))
    out = lookback.lookback_features(
        responses, samples, "user", "rid", "at", "ts", ["v", "none"], {"5min": 300, "10min": 600}
    )
    got = {r["time_window"]: r.asDict() for r in out.collect()}
    assert set(got) == {"5min", "10min"}  # the second response has no sample and no row
    five, ten = got["5min"], got["10min"]
    assert (five["record_count"], five["v_count"], five["v_mean"], five["v_std"]) == (2, 1, 7.0, None)
    assert (ten["record_count"], ten["v_count"], ten["v_median"], ten["v_min"], ten["v_max"]) == (3, 2, 5.5, 4.0, 7.0)
    assert ten["none_count"] == 0 and ten["none_mean"] is None and ten["none_median"] is None


@pytest.mark.parametrize("hot", [False, True])
def test_nearest_asof(spark, hot, request):
    if hot:
        request.getfixturevalue("small_groups")
    schema = "id int, ts timestamp_ntz, v double"
    left = spark.createDataFrame([(1, ts("2024-01-01 10:00:00"), 1.0), (2, ts("2024-01-01 12:00:00"), 2.0)], schema)
    right = spark.createDataFrame(
        [(1, ts("2024-01-01 09:59:00"), 10.0), (2, ts("2024-01-01 10:01:00"), 20.0), (3, ts("2024-01-01 12:02:01"), 30.0)], schema
    )
    rows = asof.nearest_asof(left, right, "ts", "id", ["v"], 120).collect()
    # equal distance: the earlier one; 121 s away: no match, the row is dropped
    assert [(r["id"], r["v_right"], r["gap_s"]) for r in rows] == [(1, 10.0, 60.0)]
    kept = asof.nearest_asof(left, right, "ts", "id", ["v"], 120, drop_incomplete=False)
    assert kept.count() == 2


CAL = [(0, 1, "2025-03-17", "2025-03-22", "A"), (1, 1, "2025-05-05", "2025-05-10", "B")]


def exam(spark, day, group=1, window=False):
    cal = spark.createDataFrame(CAL, "seq int, group int, start string, end string, name string")
    cal = cal.withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    rows = spark.createDataFrame([(group, dt.date.fromisoformat(day))], "g int, d date")
    run = calendar.window_exam_flags if window else calendar.exam_features
    return run(rows, cal, "g", "d", ("2025-04-14", "2025-04-19")).first()


def test_calendar_edges(spark):
    first, last = exam(spark, "2025-03-17"), exam(spark, "2025-03-22")
    assert (first["is_exam_period"], last["is_exam_period"], first["exam_period_name"]) == (1, 1, "A")
    # the next entry is strictly later in the daily variant, and may start today in the window variant
    assert first["days_to_next_exam"] == 49.0 and first["weeks_to_next_exam"] == 7.0
    assert exam(spark, "2025-03-17", window=True)["days_until_exam"] == 0
    assert exam(spark, "2025-03-17", window=True)["is_pre_exam_week"] == 1
    assert first["is_holiday_period"] == 1 and first["is_holiday"] == 0
    assert exam(spark, "2025-04-15")["exam_proximity_category"] == "holiday"
    assert exam(spark, "2025-03-10")["exam_proximity_category"] == "pre_exam_week"
    assert exam(spark, "2025-03-03")["exam_proximity_category"] == "pre_exam_2weeks"
    # three days after an exam, but another one follows: the post branch is not reached
    assert exam(spark, "2025-03-25")["exam_proximity_category"] == "normal"
    assert exam(spark, "2025-05-17")["exam_proximity_category"] == "post_exam_week"
    assert exam(spark, "2025-05-24")["exam_proximity_category"] == "post_exam_2weeks"
    assert exam(spark, "2025-06-24")["exam_proximity_category"] == "normal"
    assert exam(spark, "2025-06-24", window=True)["days_until_exam"] == -1
    unknown = exam(spark, "2025-04-15", group=9)
    assert (unknown["is_holiday"], unknown["exam_proximity_category"], unknown["days_to_next_exam"]) == (0, "", None)
    assert exam(spark, "2025-04-15", group=9, window=True)["is_easter_break"] == 1


def test_consolidation_combines_columns_but_keep_last_does_not(spark):
    a = spark.createDataFrame([(1, 10, 1.0)], "user int, t int, x double")
    b = spark.createDataFrame([(1, 10, 2.0), (1, 11, 3.0)], "user int, t int, x double")
    got = {r["t"]: (r["a_x"], r["b_x"]) for r in consolidate({"a": a, "b": b}, ["user", "t"]).collect()}
    assert got == {10: (1.0, 2.0), 11: (None, 3.0)}
    rows = spark.createDataFrame([(1, 1, 5.0, None), (1, 2, None, 6.0)], "t int, seq int, x double, y double")
    last = keep_one(rows, ["t"], "seq").first()
    assert (last["x"], last["y"]) == (None, 6.0)


def test_sum_of_nothing_is_zero_and_zero_division_is_null(spark):
    df = spark.createDataFrame([(1, None, 0.0), (1, None, 2.0)], "d int, steps double, h double")
    row = daily.daily_total(df, ["d"], ["steps"]).first()
    assert row["steps_total"] == 0
    out = daily.ratio_stats(df.withColumn("l", F.lit(4.0)), ["d"], "l", "h", "r").first()
    assert (out["r_mean"], out["r_std"]) == (2.0, None)
    plan = daily.plan_statistics(["minute_spo2_value", "full_sleep_standard_deviation", "daily_rmssd"])
    assert plan == {"minute_spo2_value": ("mean", "std", "min"), "daily_rmssd": ("mean", "std", "min", "max")}


def test_terciles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "y double")
    cuts = (4.0, 7.0)
    loose = tf.binary_drop_middle(df, "y", "c", cuts, strict=False).collect()
    strict = tf.binary_drop_middle(df, "y", "c", cuts, strict=True).collect()
    assert {(r["y"], r["c"]) for r in loose} >= {(7.0, 0), (4.0, 0), (8.0, 1)}
    assert {r["y"] for r in strict} == {1.0, 2.0, 3.0, 8.0, 9.0, 10.0}
    assert df.select(tf.three_classes(F.col("y"), cuts).alias("c")).groupBy("c").count().count() == 3
    with pytest.raises(ValueError, match="do not separate"):
        tf.tercile_cuts(df.withColumn("y", F.lit(1.0)), "y")


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (4.0, 5.0, 3.0)], "a double, k double, b double")
    got = {(r["var_a"], r["var_b"]): r["r"] for r in stats.correlation_matrix(df, ["a", "k", "b"]).collect()}
    assert got[("a", "k")] is None and got[("k", "k")] is None and got[("a", "b")] == pytest.approx(1.0)
    assert got[("b", "a")] == got[("a", "b")] and len(got) == 9


def test_completeness_limits(spark):
    rows = [(i, 1.0 if i == 0 else None, 1.0 if i < 5 else None, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, ten double, half double, full double")
    assert columns.keep_complete(df, 10.0).columns == ["id", "ten", "half", "full"]
    assert columns.keep_complete(df, 50.0).columns == ["id", "half", "full"]
    # exactly 100 % is in none of the six bands
    bands = {r["band"]: r["rows"] for r in quality.band_counts(quality.column_completeness(df, ["ten", "half", "full"]), "completeness_pct", quality.SIX_BANDS).collect()}
    assert bands == {"0-10%": 0, "10-25%": 1, "25-50%": 0, "50-75%": 1, "75-90%": 0, "90-100%": 0}


def test_streaks_and_gaps_over_a_month_end(spark):
    days = ["2024-02-27", "2024-02-28", "2024-03-02", "2024-03-03", "2024-03-03", "2024-03-06"]
    df = spark.createDataFrame([(1, dt.date.fromisoformat(x)) for x in days], "u int, d date")
    streak = continuity.longest_streak(df, "u", "d").first()
    # two streaks of two days: the first one
    assert (streak["days"], streak["start_day"]) == (2, dt.date(2024, 2, 27))
    gaps = [(r["start_day"], r["days"]) for r in continuity.longest_gaps(df, "u", "d").orderBy("place").collect()]
    assert gaps == [(dt.date(2024, 2, 29), 2), (dt.date(2024, 3, 4), 2)]
    assert missing_dates(df, "u", "d").count() == 4
    s = continuity.continuity_summary(df, "u", "d").first()
    assert (s["total_days"], s["missing_days"], s["days_with_multiple_responses"], s["max_responses_per_day"], s["band"]) == (9, 4, 1, 2, "FAIR")


def test_missing_days_are_listed_without_a_join(spark):
    rows = [(1, "2024-02-27"), (1, "2024-03-02"), (1, "2024-03-02"), (2, "2024-01-01"), (None, "2024-05-01"), (None, "2024-05-03"), (1, None)]
    df = spark.createDataFrame([(u, x and dt.date.fromisoformat(x)) for u, x in rows], "u int, d date")
    found = missing_dates(df, "u", "d")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["u"] or 0, r["d"].isoformat()) for r in found.collect())
    # no day of a NULL user counts as observed
    assert got == [(0, "2024-05-01"), (0, "2024-05-02"), (0, "2024-05-03"), (1, "2024-02-28"), (1, "2024-02-29"), (1, "2024-03-01")]


def test_sequences_need_enough_rows(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(4)] + [("b", 1, 1.0), ("b", 2, None)], "u string, t int, v double")
    out = sequences.sliding_sequences(df, ["u"], ["t"], ["v"], "v", 3).orderBy("t").collect()
    assert [(r["sequence"], r["label"]) for r in out] == [([[0.0], [1.0], [2.0]], 2.0), ([[1.0], [2.0], [3.0]], 3.0)]


LEVELS = {
    "summary": {"deep": {"count": 2, "minutes": 50, "thirtyDayAvgMinutes": 60}, "wake": {"count": 1, "minutes": 0, "thirtyDayAvgMinutes": 9}},
    "data": [
        {"dateTime": "2024-01-01T23:00:00.000", "level": "light", "seconds": 1800},
        {"dateTime": "2024-01-01T23:30:00.000", "level": "deep", "seconds": 600},
        {"dateTime": "2024-01-01T23:40:00.000", "level": "deep", "seconds": 1200},
    ],
}


def test_nested_levels(spark):
    texts = [json.dumps(LEVELS), repr(LEVELS | {"mainSleep": True, "note": None}), "not a record"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = df.select("i", F.when(F.col("i") == 1, nested.parse_levels(F.col("t"), True)).otherwise(nested.parse_levels(F.col("t"))).alias("l"))
    cols = nested.stage_summary(F.col("l")) | nested.segment_features(F.col("l")) | nested.micro_event_features(F.col("l"))
    rows = parsed.select("i", *[c.alias(n) for n, c in cols.items()]).orderBy("i").collect()
    for r in rows[:2]:
        assert (r["deep_sleep_minutes"], r["deep_sleep_count"], r["deep_sleep_deviation_from_avg"]) == (50, 2, -10)
        # zero minutes: no deviation
        assert (r["wake_minutes"], r["wake_deviation_from_avg"], r["rem_sleep_minutes"]) == (0, None, None)
        assert (r["sleep_stage_transitions"], r["minutes_to_first_deep_sleep"], r["minutes_to_first_rem_sleep"]) == (3, 30, None)
        assert (r["deep_avg_segment_duration_minutes"], r["deep_segment_duration_std"]) == (15, 5)
        # one segment: deviation 0; absent stage: nothing
        assert (r["light_segment_duration_std"], r["rem_segment_duration_std"], r["last_sleep_stage"]) == (0, None, "deep")
        assert r["micro_awakening_count"] is None and r["micro_awakening_per_hour"] is None
    assert all(v is None for n, v in rows[2].asDict().items() if n != "i")


def test_time_parsing(spark):
    texts = ["2024-03-01T10:00:00.123456789Z", "2024-03-01T12:00:00+02:00", "03/01/24 10:00:00", "2024/03/01 10:00:00", "2024-03-01", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(temporal.parse_timestamp(F.col("t"))).collect()]
    ten = ts("2024-03-01 10:00:00")
    assert got == [ten.replace(microsecond=123456), ten, ten, ten, ts("2024-03-01 00:00:00"), None, None]
    assigned = spark.range(1).select(
        temporal.assigned_timestamp(F.lit("2024-03-01 01:59:59").cast("timestamp_ntz")), temporal.assigned_date(F.lit("2024-03-01 02:00:00").cast("timestamp_ntz"))
    ).first()
    assert list(assigned) == [ts("2024-02-29 01:59:59"), dt.date(2024, 3, 1)]


def test_parsing_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.createDataFrame([("2024-07-01T12:00:00+02:00", "1700000000.5")], "t string, e string").select(
            temporal.parse_timestamp(F.col("t")), temporal.epoch_to_timestamp(F.col("e"))
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert list(row) == [ts("2024-07-01 10:00:00"), ts("2023-11-14 22:13:20.500000")]


def test_windows_do_not_depend_on_the_session_zone(spark):
    # 02:30 does not exist on this day in the session zone
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stamps = ["2024-03-10 02:30:00", "2024-03-10 02:49:00", "2024-03-10 03:20:00"]
        got = windows(spark, "2024-03-10 03:30:00", stamps, width=2700)
        midnight = spark.sql("select timestamp_ntz'2024-03-10 00:00:00' as a, timestamp_ntz'2024-03-10 00:00:01' as b").select(
            temporal.is_midnight(F.col("a")), temporal.is_midnight(F.col("b"))
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-03-10 02:49:00", "2024-03-10 03:20:00"]
    assert list(midnight) == [True, False]


def test_names_and_codes(spark):
    df = spark.createDataFrame([("w5_hr_mean",), ("w5_min_min",), ("steps",)], "n string")
    parts = encode.feature_name_parts(F.col("n"), {"w5_": "5min"})
    rows = [tuple(r) for r in df.select(*[c.alias(k) for k, c in parts.items()]).collect()]
    assert rows == [("5min", "hr", "mean"), ("5min", "min", "min"), ("N/A", "steps", "N/A")]
    assert columns.first_matching(["A_stress", "anxiety"], ["^i_", "STRESS"]) == "A_stress"
    assert columns.detect_column(["x", "UserId"], ["userid"], []) == "UserId"
    ids = spark.createDataFrame([("007",), (" 12",), ("u1",)], "t string").select(normalised_id(F.col("t"))).collect()
    assert [r[0] for r in ids] == [7, 12, None]
    codes = spark.createDataFrame([("rem",), ("odd",)], "s string").select(encode.encode_map(F.col("s"), encode.SLEEP_STAGE_CODES)).collect()
    assert [r[0] for r in codes] == [1, None]
    with pytest.raises(ValueError, match="missing required columns"):
        columns.require_columns(df, ["absent"])


def test_sources(spark, tmp_path):
    (tmp_path / "steps_1.csv").write_text("date,steps\n2024-01-01 08:00:00,5\n2024-01-01 09:00:00,7\n")
    (tmp_path / "steps_2.csv").write_text("date,steps\nbad,5\n")
    (tmp_path / "sleep-1.json").write_text(json.dumps([{"startTime": "2024-01-01T23:00:00.000", "levels": {"a": 1}}, {"startTime": "2024-01-02T23:00:00.000", "levels": {"a": 2}}]))
    (tmp_path / "active_minutes_1.csv").write_text("light,moderate\n1,2\n")
    found = files.read_sources(spark, str(tmp_path))
    assert set(found) == {"steps", "sleep_global"}
    steps = sorted(map(tuple, found["steps"].collect()), key=str)
    assert steps == sorted([(None, "steps", "5"), (ts("2024-01-01 08:00:00"), "steps", "5"), (ts("2024-01-01 09:00:00"), "steps", "7")], key=str)
    assert [r["levels.a"] for r in found["sleep_global"].select("`levels.a`").collect()] == [1, 2]
    single = tmp_path / "one.json"
    single.write_text('{"a": {"b": 1, "c": {"d": "x"}}}')
    assert files.read_json(spark, str(single)).columns == ["a.b", "a.c.d"]
    tree = tmp_path / "tree" / "2024"
    tree.mkdir(parents=True)
    (tree / "Lab_3SP_user_012_2024-05-01.csv").write_text("t;v\n1;2.5\nx;y\n")
    scan = files.read_tree(spark, str(tmp_path / "tree"), "t int, v double", sep=";", with_file=True)
    rows = files.with_file_columns(scan).withColumn("cat", files.category_of(F.col("source_file"))).orderBy(F.col("t").desc_nulls_last()).collect()
    assert (rows[0]["v"], rows[0]["file_user"], rows[0]["file_date"], rows[0]["cat"]) == (2.5, 3, "2024-05-01", "Sensor Lab 3SP")
    assert rows[1]["t"] is None
    out = sinks.write_table(spark.range(4).withColumn("part", F.col("id") % 2), str(tmp_path / "out"), ["part"], "csv")
    assert spark.read.csv(out, header=True).where("part = 1").count() == 2


def test_metrics_of_small_tables(spark):
    rows = [(0, 0, 0.9, 0.1), (0, 1, 0.4, 0.6), (1, 1, 0.2, 0.8), (1, 1, 0.4, 0.6)]
    df = spark.createDataFrame(rows, "label int, prediction int, p0 double, p1 double")
    # the class 2 of the grid never occurs and is left out of the averages
    conf = metrics.confusion_matrix(df, "label", "prediction", [0, 1, 2])
    assert conf.count() == 9
    s = metrics.summary_metrics(conf).first()
    assert s["accuracy"] == pytest.approx(0.75)
    assert s["precision_macro"] == pytest.approx((1 + 2 / 3) / 2)
    # one tie between the classes counts half
    assert metrics.binary_auc(df, "label", "p1").first()["auc"] == pytest.approx(3.5 / 4)
    bands = {v: spark.range(1).select(metrics.gap_band(F.lit(0.10), v)).first()[0] for v in metrics.GAP_BANDS}
    assert bands == {"three_class": "Acceptable", "binary": "Moderate", "sequence": "Excellent"}


def test_label_codes_follow_first_appearance(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "seq int, c string")
    got = {r["seq"]: r["c_encoded"] for r in encode.label_encode(df, "c", "seq").collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: None}
    assert encode.label_mapping(df, "c", "seq", max_values=1).count() == 0


def test_consolidated_downloads(spark, tmp_path):
    from pulsegrid.sources.downloads import consolidate_downloads

    def put(user, download, folder, name, text):
        path = tmp_path / user / download / folder
        path.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)

    activity, oxygen = "Physical Activity_GoogleData", "Oxygen Saturation (SpO2)"
    put("7", "a", activity, "steps_1.csv", "timestamp,steps\n2024-01-01T08:00:00Z,5\n2024-01-01T09:00:00Z,7\n")
    put("7", "a", activity, "activity_level_1.csv", "timestamp,level\n2024-01-01T08:00:00Z,LOW\n2024-01-01T08:00:00Z,HIGH\n")
    put("7", "a", oxygen, "Minute SpO2 - x.csv", "timestamp,value\n2024-01-01T08:00:00Z,96\nnever,1\n")
    put("7", "b", oxygen, "Minute SpO2 - y.csv", "timestamp,value\n2024-01-01T08:00:00Z,97\n")
    put("8", "a", oxygen, "Minute SpO2 - z.csv", "timestamp,value\n2024-01-02T08:00:00Z,95\n")
    rows = {(r["user"], r["timestamp"]): r.asDict() for r in consolidate_downloads(spark, str(tmp_path)).collect()}
    eight = ts("2024-01-01 08:00:00")
    assert set(rows) == {("7", ts("2024-01-01 00:00:00")), ("7", eight), ("8", ts("2024-01-02 08:00:00"))}
    assert rows[("7", ts("2024-01-01 00:00:00"))]["daily_total_steps"] == 12
    # the later download wins with its whole row: the activity level of the earlier one is gone
    assert rows[("7", eight)]["minute_spo2_value"] == "97" and rows[("7", eight)]["activity_level_level"] is None
    put("9", "a", activity, "activity_level_1.csv", "timestamp,level\n2024-01-03T08:00:00Z,LOW\n2024-01-03T08:00:00Z,HIGH\n")
    nine = consolidate_downloads(spark, str(tmp_path)).where("user = '9'").collect()
    assert [r["activity_level_level"] for r in nine] == ["HIGH"]


def _plain_macro_roc(rows, classes):
    """The mean curve by going over every rate and class; rows are (label, scores)."""
    curves, rates = [], set()
    for k in classes:
        pos, neg = sum(y == k for y, _ in rows), sum(y != k for y, _ in rows)
        at = {0.0: [0.0]}
        for cut in {s[k] for _, s in rows}:
            fp, tp = (sum(s[k] >= cut and (y == k) == side for y, s in rows) for side in (False, True))
            at.setdefault(fp / neg if neg else None, []).append(tp / pos if pos else None)
        rates |= set(at)
        known = {f: [t for t in ts if t is not None] for f, ts in at.items() if f is not None}
        curves.append({f: (min(ts), max(ts)) for f, ts in known.items() if ts})
    out = {}
    for f in rates:
        values = []
        for c in curves if f is not None else []:
            f0, f1 = max(x for x in c if x <= f), min((x for x in c if x >= f), default=None)
            if f0 == f:
                values.append(c[f][1])
            elif f1 is not None:
                values.append(c[f0][1] + (c[f1][0] - c[f0][1]) / (f1 - f0) * (f - f0))
        out[f] = sum(values) / len(values) if values else None
    return out


# the last two: a class without positives, and one without negatives
@pytest.mark.parametrize("labels", [[0, 1, 2], [0, 1, 1], [1, 1, 1]])
def test_macro_roc_takes_one_row_per_rate_and_no_other_curve(spark, small_groups, monkeypatch, labels):
    seen = []
    for name in ("roc_curve_points", "neighbours"):
        monkeypatch.setattr(metrics, name, lambda df, *a, f=getattr(metrics, name), name=name: seen.append((name, df, a)) or f(df, *a))
    rows = [(labels[(i * i) % 3 if i % 5 else i % 3], [i * 7 % 11 / 11, i * 5 % 13 / 13, i % 4 / 4]) for i in range(60)]
    df = spark.createDataFrame([(y, *s) for y, s in rows], "label int, p0 double, p1 double, p2 double")
    got = {r["fpr"]: r["tpr"] for r in metrics.macro_roc(df, "label", {0: "p0", 1: "p1", 2: "p2"}).collect()}
    want = _plain_macro_roc(rows, [0, 1, 2])
    assert set(got) == set(want)
    for f, t in want.items():
        assert got[f] == (None if t is None else pytest.approx(t, abs=1e-12))
    # the curve of all classes together is not part of the mean, and rates do not meet classes in a join
    assert [(n, a[:1]) for n, _, a in seen] == [("roc_curve_points", ()), ("neighbours", ([],))]
    assert seen[1][1].count() == len(want)
