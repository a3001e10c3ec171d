"""Recording-shaped views over the given tables, for queries, benchmarks and tests.

``events`` plays the recording: a user is a subject, an event a sample. Hours take the place of
seconds as the grid step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biospark.functions.scalars import magnitude
from biospark.operators.align import GridOptions
from biospark.operators.windows import WindowOptions

HOURLY = {"step": "1h", "max_gap": "5h", "on_duplicate": "first", "tie_breaker": "event_id"}
# Part of the last shown digit that is added before rounding query results.
SHIFT = 0.13717
# Raw label per event type, in mixed letter case.
EVENT_LABELS = {"error": "Stressed", "click": "rest", "view": "neutral", "signup": "EXERCISE", "purchase": "purchase"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per event at its own instant."""
    return samples_of(table(spark, sf_dir, "events"))


def samples_of(events: DataFrame) -> DataFrame:
    value, ts = F.col("value"), F.col("ts").cast("timestamp")
    sex = F.when(F.col("user_id") % 3 == 0, "m").otherwise("f")
    labels = F.create_map(*[F.lit(x) for pair in EVENT_LABELS.items() for x in pair])
    return (
        events.select(
            "event_id",
            "user_id",
            F.concat(sex, F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("subject"),
            ts.alias("timestamp"),
            F.when(value >= 5, value % 60 + 50).alias("hr"),
            F.when(value <= 150, value / 10).alias("eda_scl"),
            (value % 8 + 30).alias("temp"),
            ((F.minute(ts) - 30) / 30).alias("acc_x"),
            ((F.second(ts) - 30) / 30).alias("acc_y"),
            (value % 1).alias("acc_z"),
            labels[F.col("event_type")].alias("label"),
            "event_type",
            "value",
        )
    )


def hourly_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples moved to the start of their hour; several in one hour stay."""
    return raw_samples(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp"))


def signal(spark: SparkSession, sf_dir: str, axes: bool = False) -> DataFrame:
    """All samples of each subject by hour, with classes as raw labels; the event id orders those of one hour."""
    return hourly_signal(raw_samples(spark, sf_dir), axes)


def hourly_signal(samples: DataFrame, axes: bool = False) -> DataFrame:
    movement = ["acc_x", "acc_y", "acc_z"] if axes else [magnitude(*map(F.col, ("acc_x", "acc_y", "acc_z"))).alias("acc_mag")]
    hourly = samples.withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    return hourly.select("event_id", "subject", "timestamp", "hr", "eda_scl", "temp", *movement, "label")


def predicted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a predicted class: an event is a window of six seconds per hundredth of its value, so they overlap and
    cross midnight; some classes say stress."""
    raw = raw_samples(spark, sf_dir)
    length = F.round(F.col("value") * 100).cast("long") * 6_000_000
    predicted = F.when(F.col("event_type").isin("error", "click"), "stress").otherwise("baseline")
    return raw.select(
        "event_id", "subject", F.col("timestamp").alias("timestamp_start"),
        F.timestamp_micros(F.unix_micros("timestamp") + length).alias("timestamp_end"),
        predicted.alias("predicted_label"), F.when(F.col("value") % 1 < 0.4, "stress").otherwise("baseline").alias("label"), "event_type",
    )


def windows_of(size: int, hop: int, ratio: float = 0.8, rate: float = 1.0, **options) -> WindowOptions:
    """Row-count windows; ten days of samples per position bucket."""
    return WindowOptions(size, hop, rate, ratio, tie_breaker="event_id", bucket="10 days", **options)


def hourly_grid(**options) -> GridOptions:
    return GridOptions(**(HOURLY | options))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a prediction table: label, predicted_label, score, subject (their source)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    joined = documents.join(table(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "stress").when(F.col("quality") == 1, "baseline").otherwise("physical")
    chars = F.col("n_chars")
    predicted = F.when(chars < 400, "stress").when(chars < 4000, "baseline").otherwise("physical")
    return joined.select(
        "doc_id", F.col("source").alias("subject"), label.alias("label"), predicted.alias("predicted_label"),
        (F.lit(1000.0) / (chars + 1000)).alias("score"),
    )
