from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from biospark.contracts import CONTRACT
from biospark.functions.scalars import duration_micros
from biospark.operators import harmonize, quality, states
from tests.conftest import at, samples


def source1(spark):
    rows = [(at(i), "f01", 70.0 + i % 3, 5.0, 32.0, "baseline" if i < 50 else "stress") for i in range(100)]
    return spark.createDataFrame(rows, "timestamp timestamp, subject_id string, BVP_HR double, EDA double, TEMP double, activity_label string")


def test_source1_columns(spark):
    out = harmonize.harmonize_columns(source1(spark), "hongn")
    assert out.schema.fieldNames() == CONTRACT.fieldNames()
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in CONTRACT.fields]
    row = out.agg(F.count("hr"), F.count("acc_mag"), F.count("rmssd"), F.count_distinct("label")).first()
    assert tuple(row) == (100, 0, 0, 2)


def test_source2_keeps_case_apart(spark):
    raw = spark.createDataFrame([("2023-01-01 00:00:00", "p01", 71.0, 30.0, "low")],
                                "timestamp string, participant_id string, HR double, RMSSD double, stress_label string")
    row = harmonize.harmonize_columns(raw, "Swell").first()
    assert (row.timestamp, row.subject, row.hr, row.rmssd, row.label) == (at(0), "p01", 71.0, 30.0, "low")
    assert harmonize.harmonize_stress_labels(harmonize.harmonize_columns(raw, "swell")).first().label == "other"


def test_contract_name_wins_over_raw_name(spark):
    raw = spark.createDataFrame([(1.0, 2.0)], "HR double, x double").toDF("HR", "hr")
    assert harmonize.harmonize_columns(raw, "swell").first().hr == 2.0


def test_unknown_source(spark):
    with pytest.raises(ValueError, match="Unknown dataset type"):
        harmonize.harmonize_columns(spark.range(1), "nope")


def test_cohorts(spark):
    table = spark.createDataFrame([("f01", 1), ("f02", 2), ("m01", 3), ("m02", 4), ("f03", 5), (None, 6)], "subject string, v int")
    assert [r.subject for r in harmonize.filter_female_subjects(table).orderBy("v").collect()] == ["f01", "f02", "f03"]
    assert harmonize.filter_female_subjects(table, ["m01", "f03"]).count() == 2
    listed = spark.createDataFrame([("m01",), ("m01",), ("f01",)], "subject string")
    assert harmonize.filter_female_subjects(table, listed).count() == 2


def test_labels(spark):
    raw = spark.createDataFrame([("STRESSED",), ("Calm",), ("movement",), (None,), ("low",), ("unknown",)], "label string")
    got = [r.label for r in harmonize.harmonize_stress_labels(raw).collect()]
    assert got == ["stress", "baseline", "physical", "other", "other", "other"]


def test_relative_time(spark):
    table = samples(spark, [("a", 7205.0, 1.0), ("a", 0.0, 1.0), ("a", 5.0, 1.0), ("b", 100.0, 1.0), (None, 1.0, 1.0)])
    got = {(r.subject, r.timestamp_relative) for r in harmonize.synchronize_timestamps(table).collect()}
    assert got == {("a", 0.0), ("a", 5.0), ("a", 7205.0), ("b", 0.0)}


def test_validation_messages(spark):
    good = samples(spark, [("f01", float(i), 70.0) for i in range(10)]).withColumn("row", F.monotonically_increasing_id())
    assert quality.validate_schema(good, order="row") == (True, [])
    ok, issues = quality.validate_schema(good.select("hr"))
    assert not ok and issues == ["Missing required columns: ['timestamp', 'subject']"]
    ok, issues = quality.validate_schema(good.withColumn("hr", F.col("hr").cast("string")))
    assert issues == ["Column 'hr' should be numeric, got string"]
    ok, issues = quality.validate_schema(good.withColumn("temp", F.lit(None).cast("double")), strict=True)
    assert issues == ["Completely null columns: ['temp']"]
    ok, issues = quality.validate_schema(good.withColumn("row", -F.col("row")), order="row")
    assert issues == ["Timestamps are not monotonically increasing"]


def test_quality_report(spark):
    rows = [("f01" if i < 500 else "f02", float(i), 5.0 if i < 900 else None) for i in range(1000)]
    table = samples(spark, rows, "subject string, seconds double, eda_scl double")
    overall = quality.get_data_quality_report(table).filter("level = 'overall'").first()
    assert (overall.total_rows, overall.total_subjects, overall.sampling_rate) == (1000, 2, "1.0 Hz")
    assert overall.duration_hours == pytest.approx(999 / 3600)
    missing = quality.missing_by_column(table).filter("level = 'overall' and column = 'eda_scl'").first()
    assert (missing.missing_count, missing.missing_pct) == (100, 10.0)


def test_quality_without_timestamp(spark):
    table = spark.createDataFrame([("f01", 1.0), ("f02", 2.0)], "subject string, hr double")
    row = quality.get_data_quality_report(table).filter("level = 'overall'").first()
    assert (row.start, row.duration_hours, row.sampling_rate) == (None, None, None)


def test_quality_single_row_and_unknown_rate(spark):
    report = quality.get_data_quality_report(samples(spark, [("a", 0.0, 1.0), ("b", 0.0, 1.0), ("b", 0.0, 1.0)]))
    by = {(r.level, r.subject): r for r in report.collect()}
    assert by[("subject", "a")].start is None and by[("subject", "a")].sampling_rate is None
    assert by[("subject", "b")].sampling_rate == "Unknown"


def test_rates_across_stretches_and_levels(spark):
    rng = random.Random(4)
    rows = [("a", i * 0.25, 1.0) for i in range(40)] + [("b", 7.0 * i, 1.0) for i in range(30)] + [("a", 9000.0, 1.0)] * 2
    rows += [("c", rng.randrange(10**9) / 1e3, 1.0) for _ in range(200)] + [("d", 5.0, 1.0), (None, 1.0, 1.0), (None, 2.0, 1.0)]
    table = samples(spark, rows).unionByName(spark.createDataFrame([("b", None, 2.0)] * 50, "subject string, timestamp timestamp, hr double"))
    gaps = {}
    for subject in "abcd":
        own = sorted(t for s, t, _ in rows if s == subject)
        gaps[subject] = [b - a for a, b in zip(own, own[1:])]
    expected = {("subject", s): statistics.median(g) for s, g in gaps.items() if g}
    expected["overall", None] = statistics.median(sum(gaps.values(), []))
    for width in ("1 s", "1 min", "400 days"):
        got = {(r.level, r.subject): r.median_interval for r in quality.sampling_rate(table, width).collect()}
        assert got == {k: pytest.approx(v) for k, v in expected.items()}
    whole = {(r.level, r.subject): tuple(r) for r in quality.get_data_quality_report(table).collect()}
    for levels in (["overall"], ["subject"]):
        part = {(r.level, r.subject): tuple(r) for r in quality.get_data_quality_report(table, levels=levels).collect()}
        assert part == {k: v for k, v in whole.items() if k[0] in levels}
    for levels in (["dataset"], []):
        with pytest.raises(ValueError, match="levels"):
            quality.get_data_quality_report(table, levels=levels)


@pytest.mark.parametrize("interval, text", [(4.0, "0.2 Hz"), (20.0, "0.1 Hz"), (0.8, "1.2 Hz"), (1.0, "1.0 Hz"), (0.015625, "64.0 Hz")])
def test_rate_text(spark, interval, text):
    assert spark.range(1).select(quality.rate_text(F.lit(interval))).first()[0] == text


def test_pairing(spark):
    left = samples(spark, [("a", 0.0, 1.0), ("a", 1.0, 2.0), ("b", 0.0, 3.0), ("a", 2.0, None)])
    right = samples(spark, [("a", 0.0, 9.0, 1.5), ("a", 2.0, 9.0, 1.5)], "subject string, seconds double, hr double, eda double")
    out = harmonize.pair_modalities(left, right)
    assert set(out.columns) == {"subject", "timestamp", "hr", "hr_eda", "eda"}
    assert {(r.subject, r.hr, r.hr_eda, r.eda) for r in out.collect()} == {("a", 1.0, 9.0, 1.5), ("b", 3.0, None, None)}


def test_sorted_merge(spark):
    one = harmonize.with_dataset(samples(spark, [("f2", 1.0, 1.0), ("f2", 0.0, 1.0), ("f1", 0.0, 1.0)]), "x")
    two = harmonize.with_dataset(samples(spark, [("p1", 0.0, 1.0)]), "a").drop("hr")
    one, two = (t.withColumn("label", F.lit("rest")) for t in (one, two))
    merged = harmonize.merge_datasets(one, two, sort=True).collect()
    assert [(r.dataset, r.subject, r.timestamp_relative) for r in merged] == [
        ("a", "p1", 0.0), ("x", "f1", 0.0), ("x", "f2", 0.0), ("x", "f2", 1.0)]
    with pytest.raises(ValueError):
        harmonize.merge_datasets()


def test_durations():
    assert duration_micros("5s") == 5_000_000 and duration_micros("1 hour") == 3_600_000_000
    assert duration_micros(None) is None and duration_micros("") is None
    with pytest.raises(ValueError):
        duration_micros("-1s")


def stated(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        t = 0.0
        for _ in range(300):
            t += rng.choice([0.25, 0.25, 1.0, rng.expovariate(0.0002)])
            rows.append((f"f{k:02d}", at(t), rng.choice([None, float("nan"), 1.0, 2.0])))
    rows += [("f01", None, 1.0), (None, at(3.0), 1.0), (None, at(9.0), 1.0), ("f99", at(1.0), None)]
    return spark.createDataFrame(rows, "subject string, timestamp timestamp, hr double")


def test_report_of_stored_states(spark, tmp_path):
    """Loads of single days give the exact report's counts, and medians within the stated rank error."""
    table, path = stated(spark), str(tmp_path / "states")
    days = [r.d for r in table.select(F.to_date("timestamp").alias("d")).distinct().collect()]
    for day in [*days, days[0]]:
        part = table.filter(F.to_date("timestamp").eqNullSafe(F.lit(day)))
        states.store_states(states.quality_states(part, "6 hours"), path, str(day))
    stored = spark.read.parquet(path)
    assert len(days) > 3 and stored.select("load").distinct().count() == len(days)
    kept = ("level", "subject", "total_rows", "total_subjects", "start", "end", "duration_hours")
    exact = quality.get_data_quality_report(table)
    got = states.report_of_states(stored)
    assert set(map(tuple, got.select(*kept).collect())) == set(map(tuple, exact.select(*kept).collect()))
    medians = {(r.level, r.subject): r.median_interval for r in quality.sampling_rate(table).collect()}
    enclosed = {(r.level, r.subject): (r.low_interval, r.high_interval) for r in got.collect() if r.subject or r.level == "overall"}
    single = ("subject", "f99")
    assert enclosed.pop(single) == (None, None) and set(enclosed) == set(medians)
    assert all(low <= medians[k] <= high for k, (low, high) in enclosed.items())
    missing = quality.missing_by_column(table).filter("column = 'hr'")
    assert set(map(tuple, states.missing_of_states(stored).collect())) == set(map(tuple, missing.collect()))


def test_states_of_odd_tables(spark):
    empty = stated(spark).limit(0)
    assert states.quality_states(empty).count() == 0
    assert states.report_of_states(states.quality_states(empty)).count() == quality.get_data_quality_report(empty).count() == 0
    extra = stated(spark).withColumn("rows", F.lit(1)).withColumn("load", F.lit("x")).withColumn("start", F.lit(2.0))
    got = {r["column"]: r.missing_count for r in states.missing_of_states(states.quality_states(extra), ["overall"]).collect()}
    assert got == {"hr": got["hr"], "rows": 0, "load": 0, "start": 0}
    repeated = samples(spark, [("a", 1.0, 1.0)] * 5)
    row = states.report_of_states(states.quality_states(repeated), ["subject"]).first()
    assert (row.total_rows, row.median_interval, row.sampling_rate) == (5, 0.0, "Unknown")
