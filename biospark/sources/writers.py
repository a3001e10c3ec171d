"""Write tables and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    """CSV with a header for ``.csv`` paths, otherwise Parquet."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.lower().rstrip("/").endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one JSON-lines file; larger ones (reports per subject, curves) keep their partitions."""
    df.write.mode("overwrite").json(path)


def write_reports(tables: dict[str, DataFrame], directory: str) -> None:
    for name, table in tables.items():
        write_report(table, f"{directory.rstrip('/')}/{name}")
