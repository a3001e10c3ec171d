"""Validation against the contract and quality reports.

Reports aggregate once per recording and roll the small result up to the levels asked for, so the number of scans does
not depend on the number of levels: one for the totals and one for the gaps between samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biospark.contracts import CONTRACT, feature_columns, series_keys
from biospark.functions.scalars import duration_micros, micros, nan_to_null, seconds_between
from biospark.operators.ordered import median_of_counts, previous_value, quantile_bucket
from biospark.session import stage

# Fixed value: hours in seconds.
HOUR = 3600.0
OVERALL = "overall"


def schema_issues(df: DataFrame) -> list[str]:
    """Missing required columns and wrong column types; reads the schema only."""
    issues = []
    missing = [c for c in ("timestamp", "subject") if c not in df.columns]
    if missing:
        issues.append(f"Missing required columns: {missing}")
    types = {f.name: f.dataType for f in df.schema.fields}
    expected = {
        T.TimestampType: ("datetime", (T.TimestampType, T.TimestampNTZType, T.DateType)),
        T.DoubleType: ("numeric", T.NumericType),
        T.StringType: ("string/object", T.StringType),
    }
    for field in CONTRACT.fields:
        name, allowed = expected[type(field.dataType)]
        if field.name in types and not isinstance(types[field.name], allowed):
            issues.append(f"Column '{field.name}' should be {name}, got {types[field.name].simpleString()}")
    return issues


def null_columns(df: DataFrame) -> DataFrame:
    """Names of the columns without any value, one row each, in one aggregation."""
    counts = nan_to_null(df).agg(*[F.count(c).alias(c) for c in df.columns])
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("known")) for c in df.columns])
    return counts.select(F.inline(listed)).filter("known = 0").select("column")


def out_of_order(df: DataFrame, order: str, keys: list[str] | None = None, timestamp: str = "timestamp") -> DataFrame:
    """Rows whose timestamp lies before that of the preceding row of the same recording.

    ``order`` is a whole-number column with the source order, for a table has no order of its own.
    """
    keys = series_keys(df.columns) if keys is None else keys
    # Ranges of equally many rows, whatever the gaps in the order.
    ranged = quantile_bucket(df, order).withColumnRenamed("__bucket", "__range")
    return (
        previous_value(ranged, keys, F.col("__range"), order, timestamp, "__previous")
        .filter(F.col(timestamp) < F.col("__previous"))
        .select(*df.columns)
    )


def validate_schema(df: DataFrame, strict: bool = False, order: str | None = None) -> tuple[bool, list[str]]:
    """(is valid, issues). ``strict`` also reports wholly null columns, ``order`` enables the order check."""
    issues = schema_issues(df)
    if strict:
        empty = {r["column"] for r in null_columns(df).collect()}
        if empty:
            issues.append(f"Completely null columns: {[c for c in df.columns if c in empty]}")
    if order and "timestamp" in df.columns and not out_of_order(df, order).isEmpty():
        issues.append("Timestamps are not monotonically increasing")
    return not issues, issues


def report_levels(keys: list[str], levels: list[str] | None) -> list[str]:
    """The levels of a report, "overall" and the keys, or those of them that are asked for; others are an error."""
    known = [OVERALL, *keys]
    if levels is None:
        return known
    if not levels or set(levels) - set(known):
        raise ValueError(f"Unknown levels {levels}, the table has {known}")
    return [name for name in known if name in levels]


def roll_up(
    per_recording: DataFrame, keys: list[str], aggs: list[Column], always: list[str] = (), levels: list[str] | None = None
) -> DataFrame:
    """Aggregate a per-recording table overall, per dataset and per recording, in each level also by ``always``."""
    wanted = report_levels(keys, levels)
    if not keys:
        return per_recording.groupBy(*always).agg(*aggs).withColumn("level", F.lit(OVERALL))
    names = [OVERALL, *keys]
    sets = [[*keys[:depth], *always] for depth, name in enumerate(names) if name in wanted]
    # grouping() is 0 for columns that are part of the grouping set of the row.
    depth = sum((1 - F.grouping(k).cast("int") for k in keys), F.lit(1))
    return per_recording.groupingSets([[F.col(k) for k in s] for s in sets], *keys, *always).agg(
        F.element_at(F.array(*[F.lit(n) for n in names]), depth).alias("level"), *aggs
    )


def get_data_quality_report(df: DataFrame, bucket: str = "1 hour", levels: list[str] | None = None) -> DataFrame:
    """Rows, subjects, time range and sampling rate: overall, per dataset, per subject, or at the ``levels`` named.

    Columns: level, the key columns, total_rows, total_subjects, start, end, duration_hours,
    sampling_rate. Time columns are null for a table without timestamps or with a single row.
    """
    keys = series_keys(df.columns)
    timed = "timestamp" in df.columns
    times = [F.min("timestamp").alias("start"), F.max("timestamp").alias("end")] if timed else []
    per_recording = df.groupBy(*keys).agg(F.count("*").alias("rows"), *times)
    subject = F.col("subject") if "subject" in keys else F.lit(None).cast("string")
    per_recording = per_recording.withColumn("__subject", subject)
    aggs = [F.sum("rows").alias("total_rows"), F.count_distinct("__subject").alias("total_subjects")]
    if timed:
        aggs += [F.min("start").alias("start"), F.max("end").alias("end")]
    report = roll_up(per_recording, keys, aggs, levels=levels)
    if not timed:
        absent = {"start": "timestamp", "end": "timestamp", "duration_hours": "double", "sampling_rate": "string"}
        return report.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()})
    rates = sampling_rate(df, bucket, levels)
    on = F.col("r.level") == F.col("s.level")
    for key in keys:
        on = on & F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}"))
    rate = F.coalesce(F.col("s.sampling_rate"), F.lit("Unknown")).alias("sampling_rate")
    return timed_report(report.alias("r").join(rates.alias("s"), on, "left").select("r.*", rate))


def timed_report(report: DataFrame) -> DataFrame:
    """Add the duration to a report with its rates; times and rates of a single row are null."""
    several = F.col("total_rows") > 1
    return report.withColumns({c: F.when(several, F.col(c)) for c in ("start", "end", "sampling_rate")}).withColumn(
        "duration_hours", seconds_between(F.col("start"), F.col("end")) / HOUR
    )


def sampling_rate(df: DataFrame, bucket: str = "1 hour", levels: list[str] | None = None) -> DataFrame:
    """Median interval between successive samples of a recording and its rate text, per level.

    The exact median is taken over (interval, count) pairs. Rows without a key or an instant belong to no recording.
    """
    keys = series_keys(df.columns)
    intervals = _intervals(df, keys, duration_micros(bucket))
    # The interval is part of every level.
    rolled = roll_up(intervals, keys, [F.sum("n").alias("n")], ["gap"], levels)
    found = median_of_counts(rolled, ["level", *keys], "gap", "n", "median_interval")
    found = found.withColumn("median_interval", F.col("median_interval") / F.lit(1e6))
    return found.select(*keys, "level", "median_interval", rate_text(F.col("median_interval")).alias("sampling_rate"))


def _intervals(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """How often (``n``) each interval (``gap``, in microseconds) between successive samples of a recording occurs.

    One scan and one shuffle of samples, by stretches of time: a window gives the intervals inside a stretch, counted
    where they arise; those between stretches follow from one row per stretch. A regular recording leaves a few rows per
    stretch, which are stored, as every level reads them.
    """
    known = F.col("timestamp").isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    at = df.filter(known).select(*keys, micros(F.col("timestamp")).alias("__at"))
    at = at.withColumn("__stretch", F.floor(F.col("__at") / F.lit(width)).cast("long")).repartition(*keys, "__stretch")
    ends = at.groupBy(*keys, "__stretch").agg(F.min("__at").alias("__first"), F.max("__at").alias("__until"))
    # As many rows per recording as it has stretches, whatever its rate.
    entered = F.lag("__until").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("__stretch"))
    between = ends.select(*keys, (F.col("__first") - entered).alias("gap"), F.lit(1).cast("long").alias("n"))
    within = Window.partitionBy(*keys, "__stretch").orderBy("__at")
    inside = at.withColumn("gap", F.col("__at") - F.lag("__at").over(within))
    inside = inside.groupBy(*keys, "__stretch", "gap").agg(F.count("*").alias("n")).drop("__stretch")
    return stage(inside.unionByName(between).filter(F.col("gap").isNotNull()))


def rate_text(interval: Column) -> Column:
    rate = F.lit(1.0) / F.when(interval > 0, interval)
    # Quarters are exact in binary and round half to even.
    shown = F.when(F.pmod(rate * 4, F.lit(2.0)) == 1, F.bround(rate, 1)).otherwise(rate)
    return F.when(interval > 0, F.format_string("%.1f Hz", shown)).otherwise("Unknown")


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column: overall, per dataset, per subject."""
    keys = series_keys(df.columns)
    copies = {f"__{k}": F.col(k) for k in keys}
    clean = nan_to_null(df).withColumns(copies) if copies else nan_to_null(df)
    named = {c: f"__{c}" if c in keys else c for c in df.columns}
    per_recording = clean.groupBy(*keys).agg(
        F.count("*").alias("__rows"), *[F.count(v).alias(f"__known_{c}") for c, v in named.items()]
    )
    sums = [F.sum(f"__known_{c}").alias(f"__known_{c}") for c in df.columns]
    rolled = roll_up(per_recording, keys, [F.sum("__rows").alias("__rows"), *sums])
    listed = F.array(
        *[F.struct(F.lit(c).alias("column"), (F.col("__rows") - F.col(f"__known_{c}")).alias("missing")) for c in df.columns]
    )
    return rolled.select("level", *keys, "__rows", F.inline(listed)).select(
        "level", *keys, "column", F.col("missing").alias("missing_count"),
        (F.col("missing") / F.col("__rows") * 100).alias("missing_pct"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column, nulls left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def subjects_by_dataset(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset").agg(F.count_distinct("subject").alias("subjects"))


def create_quality_report(df: DataFrame) -> dict[str, DataFrame]:
    """All report tables of a recording table, by name."""
    report = {"report": get_data_quality_report(df), "missing": missing_by_column(df)}
    report |= {f"by_{c}": value_counts(df, c) for c in ("dataset", "label") if c in df.columns}
    if {"dataset", "subject"} <= set(df.columns):
        report["subjects_by_dataset"] = subjects_by_dataset(df)
    return report


def unusable_rows(df: DataFrame) -> DataFrame:
    """How many rows the aligner and the windows leave out because a key or the timestamp is null."""
    keys = [*series_keys(df.columns), "timestamp"]
    return df.agg(*[F.count(F.when(F.col(k).isNull(), 1)).alias(f"null_{k}") for k in keys])


def subject_profile(windows: DataFrame) -> DataFrame:
    """Share of stress windows and number of windows per subject."""
    stressed = F.coalesce((F.col("label") == "stress").cast("int"), F.lit(0))
    return windows.groupBy("subject").agg(
        F.avg(stressed).alias("stress_ratio"), F.count("window_id").alias("n_windows")
    )


def cohort_means(windows: DataFrame, columns: list[str], labels: tuple[str, ...] = ("stress", "baseline")) -> DataFrame:
    """Mean of each feature per label, one row per feature and one column per label."""
    means = windows.filter(F.col("label").isin(*labels)).groupBy("label").agg(*[F.avg(c).alias(c) for c in columns])
    return (
        means.unpivot("label", columns, "feature", "mean")
        .groupBy("feature")
        .pivot("label", list(labels))
        .agg(F.first("mean"))
    )


def window_metadata(windows: DataFrame, options: dict[str, object]) -> DataFrame:
    """One row: feature columns, window options, totals, label distribution."""
    labels = value_counts(windows, "label").agg(
        F.sort_array(F.collect_list(F.struct("label", "count"))).alias("label_distribution")
    )
    totals = windows.agg(F.count("*").alias("total_windows"), F.count_distinct("subject").alias("total_subjects"))
    return totals.select(
        F.array(*[F.lit(c) for c in feature_columns(windows.columns)]).alias("feature_columns"),
        *[F.lit(v).alias(k) for k, v in options.items()],
        "total_windows", "total_subjects", labels.scalar().alias("label_distribution"),
    )


def subjects(df: DataFrame) -> DataFrame:
    """The distinct subjects, a null subject included."""
    return df.select("subject").distinct()
