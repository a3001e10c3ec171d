"""Job: one or more sources to a harmonized, gridded table with an optional quality report.

    spark-submit -m biospark.plans.build_dataset --hongn A.csv --swell B.csv --output OUT --quality-report
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from biospark.operators.align import GridOptions, duplicate_subjects
from biospark.operators.harmonize import filter_female_subjects, merge_datasets
from biospark.operators.quality import create_quality_report, unusable_rows
from biospark.session import build_session
from biospark.sources.readers import load_hongn_data, load_swell_data, load_wesad_data
from biospark.sources.writers import write_reports, write_table

LOADERS = {"hongn": load_hongn_data, "swell": load_swell_data, "wesad": load_wesad_data}


def run(
    spark: SparkSession,
    sources: dict[str, str],
    output: str,
    female_only: bool = False,
    female_subjects: list[str] | None = None,
    resample: bool = True,
    harmonize_labels: bool = True,
    quality_report: bool = False,
    grid: GridOptions = GridOptions(),
) -> DataFrame:
    """Write the table partitioned by dataset (and ``<output>_report`` folders) and return it as stored."""
    if not sources:
        raise ValueError("At least one dataset must be provided")
    loaded = [LOADERS[name](spark, path) for name, path in sources.items()]
    if female_only:
        loaded = [filter_female_subjects(df, female_subjects) for df in loaded]
    merged = merge_datasets(*loaded, resample_1hz=resample, harmonize_labels=harmonize_labels, grid=grid)
    if len(loaded) == 1:
        merged = merged.drop("timestamp_relative")
    write_table(merged.sortWithinPartitions("dataset", "subject", "timestamp"), output, ["dataset"])
    stored = spark.read.parquet(output)
    if quality_report:
        raw = loaded[0]
        for other in loaded[1:]:
            raw = raw.unionByName(other)
        tables = create_quality_report(stored) | {
            "left_out_rows": unusable_rows(raw), "left_out_subjects": duplicate_subjects(raw),
        }
        write_reports(tables, f"{output.rstrip('/')}_report")
    return stored


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in LOADERS:
        parser.add_argument(f"--{name}")
    parser.add_argument("--output", required=True)
    parser.add_argument("--female-only", action="store_true")
    parser.add_argument("--no-resample", action="store_true")
    parser.add_argument("--quality-report", action="store_true")
    args = parser.parse_args()
    sources = {name: getattr(args, name) for name in LOADERS if getattr(args, name)}
    run(build_session("build_dataset"), sources, args.output, args.female_only,
        resample=not args.no_resample, quality_report=args.quality_report)


if __name__ == "__main__":
    main()
