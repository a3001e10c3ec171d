"""Job: recording table to window features with subject-disjoint splits.

    spark-submit -m biospark.plans.make_windows --input TABLE --output DIR --window-sec 60 --hop-sec 30
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from biospark.operators.align import GridOptions
from biospark.operators.harmonize import filter_female_subjects
from biospark.operators.quality import subjects, validate_schema, window_metadata
from biospark.operators.splits import create_stratified_splits
from biospark.operators.windows import WindowOptions, align_and_extract, extract_features_from_windows
from biospark.session import build_session
from biospark.sources.readers import read_table
from biospark.sources.writers import write_report, write_table


def run(
    spark: SparkSession,
    input_path: str,
    output: str,
    options: WindowOptions = WindowOptions(),
    grid: GridOptions = GridOptions(),
    female_only: bool = False,
    resample: bool = True,
    order: str | None = None,
) -> dict[str, str]:
    """Write ``windows``, ``splits`` (partitioned by split), ``subjects`` and ``metadata`` under ``output``.

    ``order`` names a whole-number column with the source order of the rows; then the check includes the time order.
    """
    df = read_table(spark, input_path)
    valid, issues = validate_schema(df, order=order)
    if not valid:
        logging.warning("Schema validation issues: %s", issues)
    df = df.drop(order) if order else df
    if "timestamp" in df.columns:
        df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if female_only and "subject" in df.columns:
        df = filter_female_subjects(df)
    features = align_and_extract(df, grid, options) if resample else extract_features_from_windows(df, options)
    paths = {name: f"{output.rstrip('/')}/{name}" for name in ("windows", "splits", "subjects", "metadata")}
    write_table(features, paths["windows"])
    windows = spark.read.schema(features.schema).parquet(paths["windows"])
    if windows.isEmpty():
        raise ValueError("No valid windows found for feature extraction")
    split = create_stratified_splits(windows)
    write_table(split, paths["splits"], ["split"])
    write_table(subjects(windows), paths["subjects"])
    facts = {
        "window_size_sec": options.window_size_sec, "hop_size_sec": options.hop_size_sec,
        "sampling_rate": options.sampling_rate,
    }
    write_report(window_metadata(windows, facts), paths["metadata"])
    return paths


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--window-sec", type=int, default=60)
    parser.add_argument("--hop-sec", type=int, default=30)
    parser.add_argument("--sampling-rate", type=float, default=1.0)
    parser.add_argument("--female-only", action="store_true")
    parser.add_argument("--no-resample", action="store_true")
    parser.add_argument("--order", help="whole-number column with the source order, to check that time never goes back")
    args = parser.parse_args()
    options = WindowOptions(args.window_sec, args.hop_sec, args.sampling_rate)
    paths = run(build_session("make_windows"), args.input, args.output, options,
                female_only=args.female_only, resample=not args.no_resample, order=args.order)
    for name, path in paths.items():
        print(f"{name}: {path}")


if __name__ == "__main__":
    main()
