"""Job: raw recording files to one table.

    spark-submit -m biospark.plans.extract swell RECORDINGS_DIR OUTPUT
    spark-submit -m biospark.plans.extract wesad DIR_WITH_bvp_temp_label OUTPUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from biospark.session import build_session
from biospark.sources.readers import extract_swell, extract_wesad, read_table
from biospark.sources.writers import write_table


def run(spark: SparkSession, source: str, raw: str, output: str) -> bool:
    """Extract one source; False when the folder holds no recording."""
    if source == "swell":
        table = extract_swell(spark, raw)
    else:
        bvp, temp, label = (read_table(spark, f"{raw.rstrip('/')}/{name}.csv") for name in ("bvp", "temp", "label"))
        keys = [k for k in ("subject",) if all(k in t.columns for t in (bvp, temp, label))]
        table = extract_wesad(bvp, temp, label, keys)
    if table is None:
        return False
    write_table(table, output)
    return True


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source", choices=["swell", "wesad"])
    parser.add_argument("input")
    parser.add_argument("output")
    args = parser.parse_args()
    if not run(build_session("extract"), args.source, args.input, args.output):
        print(f"No recordings found in {args.input}")


if __name__ == "__main__":
    main()
