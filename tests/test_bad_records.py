"""Bad lines and files are set aside with their reasons; saved fits give the same rows when they are loaded."""

import gzip

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from pulsegrid.ml import stages
from pulsegrid.sources import files

SCHEMA = "id int, value double, day date, note string"


def test_every_fault_is_told_with_its_line(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_bytes(
        b"id,value,day,note\n1,1.5,2024-01-02,fine\n2,many,2024-01-02,x\n\n3,2.5,2024-01-02\n4,2.5,2024-13-02,y\n5,,,\n6,1,2024-01-02,x,z\n"
        b'7,1,2024-01-02,"a, b"\n8,1,2024-01-02,\xff\xfe\nnine,no,never,z\n'
    )
    (tmp_path / "deep" / "b.csv").write_text("note,id\nhello,10\nworld,eleven\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    whole = gzip.compress("\n".join(["id,value", *(f"{i},0.5" for i in range(100, 160))]).encode() + b"\n")
    (tmp_path / "whole.csv.gz").write_bytes(whole)
    (tmp_path / "cut.csv.gz").write_bytes(whole[: len(whole) - 9])
    got = files.read_checked(spark, str(tmp_path), SCHEMA)
    name = F.element_at(F.split("path", "/"), -1)
    bad = sorted((r["name"], r["line"] or 0, r["reason"]) for r in got.bad.withColumn("name", name).collect())
    assert bad == [
        ("a.csv", 3, "unreadable value"), ("a.csv", 5, "3 fields of 4"), ("a.csv", 6, "unreadable day"), ("a.csv", 8, "5 fields of 4"), ("a.csv", 10, "not UTF-8"),
        ("a.csv", 11, "unreadable id, value, day"), ("b.csv", 3, "unreadable id"), ("cut.csv.gz", 0, "breaks off"), ("empty.csv", 0, "empty"), ("other.csv", 0, "no known column"),
    ]
    rows = {r["id"]: (r["value"], str(r["day"]), r["note"]) for r in got.rows.where("id < 100").collect()}
    assert rows == {1: (1.5, "2024-01-02", "fine"), 5: (None, "None", None), 7: (1.0, "2024-01-02", "a, b"), 10: (None, "None", "hello")}
    assert got.rows.where("id >= 100").select("id").distinct().count() == 60


def test_line_numbers_in_a_file_of_many_parts(spark, tmp_path):
    lines = ["id,value"] + [f"{i},{'x' if i % 997 == 0 else i / 2}" for i in range(1, 20_001)]
    (tmp_path / "long.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = files.read_checked(spark, str(tmp_path), "id int, value double")
        assert got.rows.count() == 20_000 - 20
        assert {r["line"]: r["record"] for r in got.bad.collect()} == {i + 1: f"{i},x" for i in range(997, 20_001, 997)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "only.csv").write_text("")
    got = files.read_checked(spark, str(tmp_path), SCHEMA)
    assert got.rows.count() == 0 and [r["reason"] for r in got.bad.collect()] == ["empty"]


def test_a_saved_pipeline_gives_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "u", 1.0, None, None), (2, "u", None, 4.0, None), (3, "v", 5.0, 6.0, None), (4, "w", 2.0, None, None), (5, None, 3.0, 1.0, None)],
        "i int, who string, a double, b double, none double",
    )
    steps = [
        stages.MedianImputer(inputCols=["a", "b", "none"]), stages.EntityBaselines(inputCols=["a"], entity="who", suffix="_own"), stages.PopulationScaler(inputCols=["a", "b", "none"])
    ]
    model = Pipeline(stages=steps).fit(rows.where("i <= 3"))
    want = {r["i"]: r.asDict() for r in model.transform(rows).collect()}
    assert want[2]["a_own"] == 2.0 and want[3]["a_own"] == 5.0 and want[4]["a_own"] == 3.5
    assert all(r["none"] is None for r in want.values())
    # medians 3 and 5, then mean 3 and deviation of (1, 3, 5)
    assert want[2]["a"] == pytest.approx(0.0) and want[1]["a"] == pytest.approx(-2 / (8 / 3) ** 0.5) and want[1]["b"] == pytest.approx(0.0)
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    assert {r["i"]: r.asDict() for r in back.transform(rows).collect()} == want
    assert [s.uid for s in back.stages] == [s.uid for s in model.stages]
    Pipeline(stages=steps).write().overwrite().save(str(tmp_path / "plan"))
    again = Pipeline.load(str(tmp_path / "plan")).fit(rows.where("i <= 3"))
    assert {r["i"]: r.asDict() for r in again.transform(rows).collect()} == want
