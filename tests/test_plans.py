"""What the physical plans must and must not contain, and how rows spread under skew."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from biospark.operators import align, features
from biospark.operators.harmonize import filter_female_subjects
from biospark.operators.windows import WindowOptions, align_and_extract, extract_features_from_windows
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A parquet table in which one subject holds nine tenths of all rows."""
    path = str(tmp_path_factory.mktemp("skew") / "t")
    rows = spark.range(100_000).select(
        F.when(F.col("id") < 90_000, "f00").otherwise(F.concat(F.lit("f"), F.col("id") % 40)).alias("subject"),
        F.timestamp_seconds(F.col("id")).alias("timestamp"),
        (F.col("id") % 37 + 60).cast("double").alias("hr"),
        (F.col("id") % 11).cast("double").alias("eda_scl"),
        F.lit("rest").alias("label"),
        F.lit(1.0).alias("unused"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


GRID = align.GridOptions(on_duplicate="unchecked", chunk=500)


def test_samples_are_shuffled_once_and_never_joined(stored):
    text = plan(align.align_to_grid(stored.select("subject", "timestamp", "hr"), GRID))
    assert text.count("REPARTITION_BY_COL") == 1 and "Join" not in text and "Python" not in text
    # The other exchange carries one row per subject and task: the partial minimum and maximum.
    assert text.count("Exchange hashpartitioning") == 2


def test_windows_need_no_further_shuffle(stored):
    options = WindowOptions(60, 30, ratio_columns=("hr",), chunk=500)
    picked = stored.select("subject", "timestamp", "hr")
    grid_only = plan(align.align_to_grid(picked, GRID)).count("Exchange")
    assert plan(align_and_extract(picked, GRID, options)).count("Exchange") == grid_only


def test_only_spectra_use_python(stored):
    def windows(signal):
        options = WindowOptions(60, 30, ratio_columns=(signal,), chunk=500)
        return plan(extract_features_from_windows(stored.select("subject", "timestamp", signal), options))

    assert "Python" not in windows("eda_scl") and "ArrowEvalPython" in windows("hr")


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(filter_female_subjects(stored, ["f1"]).select("subject", "hr"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "In(subject, [f1])" in scan or "EqualTo(subject,f1)" in scan
    assert "ReadSchema: struct<subject:string,hr:double>" in scan
    assert "StringStartsWith(subject,f)" in plan(filter_female_subjects(stored).select("hr"))
    windows = extract_features_from_windows(stored.select("subject", "timestamp", "eda_scl", "unused"), WindowOptions(ratio_columns=("eda_scl",)))
    assert "unused" not in "".join(x for x in plan(windows.select("window_id", "eda_mean")).splitlines() if "FileScan" in x)


def largest_share(df) -> float:
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_a_dominant_subject_is_spread(spark, stored):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert largest_share(align.dense_chunks(stored, GRID, 500)) < 0.2
        options = WindowOptions(60, 30, chunk=500, bucket="10 minutes")
        from biospark.operators.windows import window_rows

        assert largest_share(window_rows(stored, options)) < 0.2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_group_exceeds_a_chunk(stored):
    dense = align.dense_chunks(stored, GRID, 500, overlap=59)
    assert dense.groupBy("subject", "__chunk").count().agg(F.max("count")).first()[0] <= 559


def test_dense_rows_of_a_task_do_not_grow_with_the_table(stored, monkeypatch):
    """Partitions follow the grid points and the windows over them, not the bytes of the sparse samples."""
    picked = stored.select("subject", "timestamp", "hr")
    options = WindowOptions(60, 30, min_valid_ratio=0, ratio_columns=("hr",), chunk=500)

    def partitions(table) -> int:
        return align_and_extract(table, GRID, options).select(F.spark_partition_id()).distinct().count()

    def rows() -> list:
        out = align_and_extract(picked, GRID, options).select("window_id", "window_length", F.round("hrv_hr_mean", 9))
        return sorted(out.collect())

    in_few = rows()
    monkeypatch.setattr(align, "ROWS_PER_TASK", 20_000)
    # The dominant subject has 90,000 grid points, 40 others have a sample every 40 s over 10,000 s.
    assert 45 <= partitions(picked) <= 49
    assert partitions(picked.filter(F.col("subject") != "f00")) <= 40
    assert rows() == in_few and len(in_few) > 15_000


def test_window_rows_of_a_task_do_not_grow_with_the_table(stored, monkeypatch):
    picked = stored.select("subject", "timestamp", "hr")
    options = WindowOptions(60, 15, ratio_columns=("hr",), chunk=500, bucket="10 minutes")

    def rows() -> list:
        return sorted(extract_features_from_windows(picked, options).select("window_id", "label", F.round("hrv_hr_mean", 9)).collect())

    in_few = rows()
    monkeypatch.setattr(align, "ROWS_PER_TASK", 20_000)
    # 100,000 rows in four windows each.
    parts = extract_features_from_windows(picked, options).select(F.spark_partition_id()).distinct().count()
    assert 17 <= parts <= 20
    assert rows() == in_few and len(in_few) > 6_000


def test_nothing_to_align_makes_no_windows(stored):
    none = stored.select("subject", "timestamp", "hr").filter(F.col("timestamp").isNull())
    assert align_and_extract(none, GRID, WindowOptions(60, 30, ratio_columns=("hr",), chunk=500)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
def test_functions_travel_with_the_plan():
    """Workers must not need the package: run from a folder that does not hold it."""
    import subprocess
    import sys

    code = (
        f"import sys; sys.path.insert(0, {os.getcwd()!r})\n"
        "from biospark.session import build_session\n"
        "import __spark_entry__ as e\n"
        "s = build_session('away', 'local[2]', **{'spark.sql.shuffle.partitions': '2', 'spark.log.level': 'ERROR'})\n"
        "print('rows', e.entry(s).count(), len(e.entry(s).filter('hrv_lf_power is not null').take(1)))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd="/tmp", capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout and done.stdout.split()[2] == "1", done.stderr[-2000:]


def test_compute_window_features_is_one_shuffle(stored):
    text = plan(features.compute_eda_features(stored, ["subject"], "timestamp"))
    assert text.count("Exchange hashpartitioning") == 1


def test_reports_rank_gaps_without_a_map_per_group(stored):
    from biospark.operators import quality

    text = plan(quality.get_data_quality_report(stored.select("subject", "timestamp", "hr")))
    assert "percentile(" not in text
