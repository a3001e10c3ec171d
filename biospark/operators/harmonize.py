"""Bring raw tables to the recording contract, merge sources, select cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biospark.contracts import CONTRACT, SOURCE_COLUMNS, series_keys
from biospark.functions.scalars import any_null, label_class, nan_to_null, seconds_between
from biospark.operators.align import GridOptions, align_to_grid
from biospark.session import stage


def harmonize_columns(df: DataFrame, dataset_type: str) -> DataFrame:
    """Raw columns of one known source as the typed contract columns; absent ones are typed nulls."""
    mapping = SOURCE_COLUMNS.get(dataset_type.lower())
    if mapping is None:
        raise ValueError(f"Unknown dataset type: {dataset_type}")
    # Names are matched with their case, so work on neutral names that cannot collide.
    neutral = [f"__c{i}" for i in range(len(df.columns))]
    source = dict(reversed(list(zip([mapping.get(c, c) for c in df.columns], neutral))))
    source |= {c: n for c, n in zip(df.columns, neutral) if c in CONTRACT.names}
    types = {n: f.dataType for n, f in zip(neutral, df.schema.fields)}
    return nan_to_null(
        df.toDF(*neutral).select(
            *[
                _typed(source[f.name], types[source[f.name]], f).alias(f.name)
                if f.name in source
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in CONTRACT.fields
            ]
        )
    )


def _typed(column: str, actual: T.DataType, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.TimestampType) and isinstance(actual, T.StringType):
        return F.to_timestamp(column)
    return F.col(column).cast(field.dataType)


def with_dataset(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("dataset", F.lit(name))


def filter_female_subjects(df: DataFrame, female_subjects: list[str] | DataFrame | None = None) -> DataFrame:
    """Cohort by listed subjects (list, or table with a ``subject`` column), else by the prefix ``f``."""
    if female_subjects is None:
        return df.filter(F.col("subject").startswith("f"))
    if isinstance(female_subjects, DataFrame):
        return df.join(female_subjects.select("subject").distinct(), "subject", "left_semi").select(*df.columns)
    return df.filter(F.col("subject").isin(list(female_subjects)))


def harmonize_stress_labels(df: DataFrame) -> DataFrame:
    """Map raw labels of any source to the four classes."""
    return df.withColumn("label", label_class(F.col("label")))


def synchronize_timestamps(df: DataFrame) -> DataFrame:
    """Add ``timestamp_relative``: seconds since the first sample of the same recording.

    The first instants, one row per recording, are stored; their size decides whether the join broadcasts them.
    """
    keys = series_keys(df.columns)
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    started = stage(df.groupBy(*keys).agg(F.min("timestamp").alias("__t0")))
    joined = df.join(started, keys) if keys else df.withColumn("__t0", started.scalar())
    return joined.select(*df.columns, seconds_between(F.col("__t0"), F.col("timestamp")).alias("timestamp_relative"))


def merge_datasets(
    *sources: DataFrame,
    resample_1hz: bool = True,
    harmonize_labels: bool = True,
    grid: GridOptions = GridOptions(),
    sort: bool = False,
) -> DataFrame:
    """Harmonized sources as one table: class labels, relative time, common grid.

    ``sort`` orders the whole table by dataset, subject and timestamp. That costs a second evaluation
    for sampling the ranges, so the jobs only sort within the partitions they write.
    """
    if not sources:
        raise ValueError("At least one dataset must be provided")
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    if harmonize_labels:
        merged = harmonize_stress_labels(merged)
    merged = synchronize_timestamps(merged)
    if resample_1hz:
        merged = align_to_grid(merged, grid)
    # Ranges cover all three columns: one long recording spans many partitions.
    return merged.orderBy("dataset", "subject", "timestamp") if sort else merged


def pair_modalities(
    left: DataFrame,
    right: DataFrame,
    subject: str = "subject",
    timestamp: str = "timestamp",
    suffix: str = "_eda",
    drop_incomplete: bool = True,
) -> DataFrame:
    """Two signals of a subject side by side where their instants agree exactly.

    Overlapping right columns get ``suffix``. A subject without any right rows keeps its left rows.
    Rows with a missing value are dropped.
    """
    on = [subject, timestamp]
    shared = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    right = right.withColumnsRenamed(shared)
    both = left.join(right, on, "inner")
    alone = left.join(right.select(subject).distinct(), subject, "left_anti").select(*left.columns)
    if drop_incomplete:
        both, alone = both.na.drop("any"), alone.na.drop("any")
    return both.unionByName(alone, allowMissingColumns=True)


def incomplete_rows(df: DataFrame) -> DataFrame:
    """The rows that a drop of incomplete rows removes."""
    return df.filter(any_null(df.columns))
