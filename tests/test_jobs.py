from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from biospark.operators.windows import WindowOptions
from biospark.plans import build_dataset, extract, make_windows, train
from biospark.sources import readers
from biospark.sources.writers import write_table
from tests.conftest import T0, at


def write_csv(path, header, rows):
    path.write_text("\n".join([",".join(header), *[",".join("" if v is None else str(v) for v in r) for r in rows]]) + "\n")


def source1_rows(subject, n=700, shift=0):
    return [(at(i), subject, 65 + 8 * math.sin(i / 9 + shift), 4 + math.sin(i / 5), 32 + i / 1000, 1 + (i % 7) / 10,
             "stress" if (i // 200) % 2 else "baseline") for i in range(n)]


HEADER1 = ["timestamp", "subject_id", "BVP_HR", "EDA", "TEMP", "ACC_magnitude", "activity_label"]


def test_readers_and_subjects(spark, tmp_path):
    write_csv(tmp_path / "wrist_f07.csv", ["timestamp", "BVP_HR"], [(at(0), 70.5), (at(1), None)])
    write_csv(tmp_path / "wrist_x.csv", ["timestamp", "BVP_HR"], [(at(0), 70.5)])
    both = readers.load_hongn_data(spark, str(tmp_path / "*.csv"))
    assert [(r.subject, r.dataset) for r in both.collect()] == [("f07", "hongn")] * 2
    assert both.filter("hr is null").count() == 1
    write_csv(tmp_path / "p1.csv", ["timestamp", "participant_id", "HR"], [(at(0), "p1", 70.5)])
    assert readers.load_swell_data(spark, str(tmp_path / "p1.csv")).first().subject == "p1"
    write_csv(tmp_path / "s3.csv", ["timestamp", "hr", "temp", "label"], [(at(0), 70.5, 30.0, "rest")])
    assert readers.load_wesad_data(spark, str(tmp_path / "s3.csv")).first().subject == "s3"
    assert readers.load_wesad_data(spark, str(tmp_path / "s3.csv"), subject="z").first().subject == "z"


def test_columns_are_matched_by_header(spark, tmp_path):
    write_csv(tmp_path / "w_f01.csv", ["timestamp", "BVP_HR", "TEMP"], [(at(0), 80.5, 33.5)])
    write_csv(tmp_path / "w_f02.csv", ["timestamp", "TEMP", "BVP_HR"], [(at(0), 33.5, 80.5)])
    write_csv(tmp_path / "w_f03.csv", ["BVP_HR", "timestamp", "note"], [(60.5, at(0), "x")])
    rows = readers.load_hongn_data(spark, str(tmp_path / "*.csv")).orderBy("subject").collect()
    assert [(r.subject, r.hr, r.temp) for r in rows] == [("f01", 80.5, 33.5), ("f02", 80.5, 33.5), ("f03", 60.5, None)]
    given = readers.read_csv(spark, str(tmp_path / "*.csv"), "TEMP double, timestamp timestamp, BVP_HR double").orderBy("BVP_HR")
    assert given.columns == ["TEMP", "timestamp", "BVP_HR"]
    assert [(r.TEMP, r.BVP_HR) for r in given.collect()] == [(None, 60.5), (33.5, 80.5), (33.5, 80.5)]


def test_contract_columns_are_not_inferred(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["timestamp", "subject", "hr", "label"], [(at(0), "007", 70, "1")])
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["timestamp", "string", "double", "string"]
    assert df.first().subject == "007"
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "none*.csv")).count()


def test_other_columns_of_different_types(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["timestamp", "x", "y"], [(at(0), 1, 1)])
    write_csv(tmp_path / "b.csv", ["timestamp", "y", "x"], [(at(0), "word", 2.5)])
    df = readers.read_csv(spark, str(tmp_path / "*.csv"))
    assert dict(df.dtypes) == {"timestamp": "timestamp", "x": "double", "y": "string"}
    assert {(r.x, r.y) for r in df.collect()} == {(1.0, "1"), (2.5, "word")}


def test_prefix_of_the_first_source(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["timestamp", "subject_id", "BVP_HR"], [(at(0), "f1", 70.5), (at(1), "m1", 71.5), (at(2), "m2", 71.5)])
    path = str(tmp_path / "a.csv")
    assert readers.load_hongn_data(spark, path).count() == 1
    assert readers.load_hongn_data(spark, path, subject_prefix=None).count() == 3
    assert tuple(readers.rows_by_prefix(spark, path).first()) == (1, 2)


def test_recordings_that_cannot_be_read_are_errors(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    write_csv(raw / "p01_ECG.csv", ["timestamp", "HR", "RMSSD"], [(at(0), 70.5, 20.5)])
    write_csv(raw / "p02_ECG.csv", ["RMSSD", "timestamp", "HR"], [(30.5, at(0), 60.5)])
    assert {(r.subject, r.HR, r.RMSSD) for r in readers.extract_swell(spark, str(raw)).collect()} == {("p01", 70.5, 20.5), ("p02", 60.5, 30.5)}
    write_csv(raw / "p01_EDA.csv", ["time", "EDA"], [(at(0), 1.5)])
    with pytest.raises(ValueError, match="timestamp"):
        readers.extract_swell(spark, str(raw))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.extract_swell(spark, str(tmp_path / "absent"))


def test_split_folders(spark, tmp_path):
    columns = "window_id string, subject string, label string, eda_mean double"
    rows = [(f"w{i}", f"s{i % 4}", "stress" if i % 2 else "baseline", float(i % 7)) for i in range(80)]
    table = spark.createDataFrame(rows, columns)
    table.withColumn("split", F.when(F.col("subject") == "s0", "test").otherwise("train")).write.partitionBy("split").parquet(
        str(tmp_path / "w" / "splits"))
    training, test, features = train.load(spark, str(tmp_path / "w"))
    assert (training.count(), test.count(), features) == (60, 20, ["eda_mean"])
    table.withColumn("split", F.lit("train")).write.partitionBy("split").parquet(str(tmp_path / "v" / "splits"))
    with pytest.raises(ValueError, match="No test split"):
        train.run(spark, str(tmp_path / "v"), str(tmp_path / "out"))


def test_window_job_checks_the_time_order(spark, tmp_path, caplog):
    rows = [(at(i), "f1", 70.0, i) for i in range(200)] + [(at(50.5), "f1", 70.0, 200)]
    spark.createDataFrame(rows, "timestamp timestamp, subject string, hr double, row long").write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="No valid windows"):
        make_windows.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), WindowOptions(500, 30), order="row")
    assert "not monotonically increasing" in caplog.text


def test_table_formats_round_trip(spark, tmp_path):
    table = spark.createDataFrame([(at(0.5), "a", 1.25), (at(1), "b", None)], "timestamp timestamp, subject string, hr double")
    for name in ("t.csv", "t_parquet"):
        write_table(table, str(tmp_path / name))
        back = readers.read_table(spark, str(tmp_path / name))
        assert sorted(map(str, back.collect())) == sorted(map(str, table.collect())) and back.schema == table.schema


def test_extraction_of_a_directory(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    write_csv(raw / "p01_ECG.csv", ["timestamp", "HR"], [(at(0), 70.5), (at(1), 71.5), (at(2), None)])
    write_csv(raw / "p01_EDA.csv", ["timestamp", "HR", "EDA"], [(at(1), 1.5, 2.5), (at(2), 1.5, 2.5)])
    write_csv(raw / "p02_ecg.csv", ["timestamp", "HR"], [(at(0), 60.5)])
    assert extract.run(spark, "swell", str(raw), str(tmp_path / "out.csv"))
    out = readers.read_csv(spark, str(tmp_path / "out.csv"))
    assert {(r.subject, r.HR, r.HR_eda, r.EDA) for r in out.collect()} == {("p01", 71.5, 1.5, 2.5), ("p02", 60.5, None, None)}
    empty = tmp_path / "empty"
    empty.mkdir()
    assert not extract.run(spark, "swell", str(empty), str(tmp_path / "none.csv"))


def test_extraction_of_wrist_tables(spark, tmp_path):
    write_csv(tmp_path / "bvp.csv", ["timestamp", "hr"], [(at(i / 4), float(i)) for i in range(12)])
    write_csv(tmp_path / "temp.csv", ["timestamp", "temp"], [(at(i), 30.0 + i) for i in range(3)])
    write_csv(tmp_path / "label.csv", ["timestamp", "label"], [(at(0), "rest"), (at(2), "stress")])
    assert extract.run(spark, "wesad", str(tmp_path), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("timestamp").collect()
    assert [(r.hr, r.temp, r.label) for r in got] == [(1.5, 30.0, "rest"), (9.5, 32.0, "stress")]


def test_pipeline_from_csv_to_model(spark, tmp_path):
    subjects = [f"f{i:02d}" for i in range(6)]
    write_csv(tmp_path / "one.csv", HEADER1, [r for i, s in enumerate(subjects) for r in source1_rows(s, shift=i)] + source1_rows("m01"))
    write_csv(tmp_path / "two.csv", ["timestamp", "participant_id", "HR", "EDA_tonic", "stress_label"],
              [(at(3 * i), s, 70 + i % 9, 3 + i % 4, "high_stress" if i > 80 else "calm") for s in ("f50", "p51") for i in range(160)])
    data = str(tmp_path / "data")
    stored = build_dataset.run(
        spark, {"hongn": str(tmp_path / "one.csv"), "swell": str(tmp_path / "two.csv")}, data, female_only=True, quality_report=True)
    counts = {(r.dataset, r.subject): r["count"] for r in stored.groupBy("dataset", "subject").count().collect()}
    assert counts == {("hongn", s): 700 for s in subjects} | {("swell", "f50"): 478}
    assert {r.label for r in stored.select("label").distinct().collect()} == {"stress", "baseline"}
    assert stored.filter("hr is null").count() == 0
    report = spark.read.json(f"{data}_report/report")
    assert report.filter("level = 'overall'").first().total_subjects == 7

    out = str(tmp_path / "windows")
    paths = make_windows.run(spark, data, out, WindowOptions(60, 30))
    split = spark.read.parquet(paths["splits"])
    assert {r.split for r in split.select("split").distinct().collect()} == {"train", "val", "test"}
    assert split.filter("subject = 'f01'").count() == (700 - 60) // 30 + 1
    meta = spark.read.json(paths["metadata"]).first()
    assert meta.total_windows == split.count() and len(meta.feature_columns) == 34

    tables = train.run(spark, out, str(tmp_path / "model"), cross_val=True, cv_folds=2, n_estimators=4, max_depth=4)
    predictions = spark.read.parquet(str(tmp_path / "model" / "predictions"))
    assert predictions.count() == split.filter("split = 'test'").count()
    assert {"prob_stress", "prob_baseline"} <= set(predictions.columns)
    info = spark.read.json(str(tmp_path / "model" / "model_info")).first()
    accuracy = predictions.agg(F.avg((F.col("label") == F.col("predicted_label")).cast("int"))).first()[0]
    assert info.test_accuracy == pytest.approx(accuracy) and info.label_classes == ["baseline", "stress"]
    assert tables["cross_validation"].count() == 3


def test_single_source_and_single_table_training(spark, tmp_path):
    write_csv(tmp_path / "one.csv", HEADER1, [r for i in range(5) for r in source1_rows(f"f{i}", 500, i)])
    stored = build_dataset.run(spark, {"hongn": str(tmp_path / "one.csv")}, str(tmp_path / "d"))
    assert "timestamp_relative" not in stored.columns
    paths = make_windows.run(spark, str(tmp_path / "d"), str(tmp_path / "w"), resample=False)
    tables = train.run(spark, paths["windows"], str(tmp_path / "m"), n_estimators=3, max_depth=3)
    assert tables["confusion_matrix"].agg(F.sum("n")).first()[0] == 15
    with pytest.raises(ValueError, match="No valid windows"):
        make_windows.run(spark, str(tmp_path / "d"), str(tmp_path / "w2"), WindowOptions(5000, 30))
    with pytest.raises(ValueError, match="At least one dataset"):
        build_dataset.run(spark, {}, str(tmp_path / "x"))
