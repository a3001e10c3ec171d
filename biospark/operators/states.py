"""Quality reports from stored states: a new day of recordings is summed up once, old days are not read again.

A state is one row per recording and stretch of time: row counts, known values per column, first and last instant, a
KLL sketch of the intervals between successive samples and a HyperLogLog sketch of the subjects. States merge to any
level. Counts, missing values and times are exact; the median interval has a rank within RANK_ERROR of the middle, the
number of subjects is an estimate with a relative standard deviation of 1.04 / sqrt(2^SUBJECT_BITS).

Null keys form a recording of their own. Rows without an instant count, but have no place in time; NaN is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biospark.contracts import series_keys
from biospark.functions.scalars import duration_micros, micros, nan_to_null
from biospark.operators.quality import rate_text, roll_up, timed_report

# Size of the sketch of intervals; a merged one keeps its error bound.
INTERVAL_K = 400
# Normalised rank error of one quantile of such a sketch, with 99 % confidence.
RANK_ERROR = 0.01
SUBJECT_BITS = 14
KNOWN = "known_"


def quality_states(df: DataFrame, stretch: str = "1 day") -> DataFrame:
    """The states of a recording table, from one shuffle of its samples by (recording, stretch).

    ``stretch`` bounds what one task sorts: a recording's samples of that time. Columns: the keys, stretch (its number
    since 1970, null for rows without an instant), rows, start, end, known_<column>, intervals, subjects.
    """
    keys = series_keys(df.columns)
    values = [c for c in df.columns if c not in {*keys, "timestamp"}]
    width = duration_micros(stretch)
    at = micros(F.col("timestamp"))
    picked = nan_to_null(df).select(
        *keys, "timestamp", F.floor(at / F.lit(width)).cast("long").alias("stretch"),
        *[F.col(c).isNotNull().cast("int").alias(f"{KNOWN}{c}") for c in values],
    )
    within = Window.partitionBy(*keys, "stretch").orderBy("timestamp")
    gap = (micros(F.col("timestamp")) - F.lag(micros(F.col("timestamp"))).over(within)).alias("__gap")
    timed = picked.filter(F.col("timestamp").isNotNull()).select("*", gap)
    # A window over rows without an instant would bring all of a recording's into one task.
    untimed = picked.filter(F.col("timestamp").isNull()).withColumn("__gap", F.lit(None).cast("long"))
    return timed.groupBy(*keys, "stretch").agg(*_summaries(keys, values)).unionByName(
        untimed.groupBy(*keys, "stretch").agg(*_summaries(keys, values))
    )


def _summaries(keys: list[str], values: list[str]) -> list:
    subject = F.col("subject").cast("string") if "subject" in keys else F.lit(None).cast("string")
    return [
        F.count("*").alias("rows"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        *[F.sum(f"{KNOWN}{c}").alias(f"{KNOWN}{c}") for c in values],
        F.kll_sketch_agg_bigint("__gap", INTERVAL_K).alias("intervals"),
        F.hll_sketch_agg(subject, SUBJECT_BITS).alias("subjects"),
    ]


def store_states(states: DataFrame, path: str, load: str) -> None:
    """Keep the states of one load under ``path``; a load that runs again replaces its own states and no others."""
    labelled = states.withColumn("load", F.lit(load))
    writer = labelled.write.partitionBy("load").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _known_columns(states: DataFrame) -> list[str]:
    return [c.removeprefix(KNOWN) for c in states.columns if c.startswith(KNOWN)]


def report_of_states(states: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """The quality report (see ``get_data_quality_report``) with median_interval and its rank bounds, from states.

    Intervals between states of a recording count where one begins after the other's end; loads that overlap in time
    miss the intervals between each other's samples. ``low_interval`` and ``high_interval`` enclose the exact median.
    """
    keys = series_keys(states.columns)
    # As many rows per recording as it has stretches, whatever its rate.
    along = Window.partitionBy(*keys or [F.lit(0)]).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    between = micros(F.col("start")) - micros(F.max("end").over(along))
    parts = states.withColumn("__between", F.when(between >= 0, between))
    merged = roll_up(
        parts,
        keys,
        [
            F.sum("rows").alias("total_rows"),
            F.hll_union_agg("subjects").alias("__subjects"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.kll_merge_agg_bigint("intervals").alias("__inside"),
            F.kll_sketch_agg_bigint("__between", INTERVAL_K).alias("__across"),
        ],
        levels=levels,
    )
    merged = merged.withColumn("__all", F.kll_sketch_merge_bigint("__inside", "__across"))
    filled = F.kll_sketch_get_n_bigint("__all") > 0
    ranks = {"median_interval": 0.5, "low_interval": 0.5 - RANK_ERROR, "high_interval": 0.5 + RANK_ERROR}
    found = merged.withColumns(
        {n: F.when(filled, F.kll_sketch_get_quantile_bigint("__all", F.lit(r)) / F.lit(1e6)) for n, r in ranks.items()}
        | {"total_subjects": F.hll_sketch_estimate("__subjects")}
    )
    rate = rate_text(F.col("median_interval"))
    return timed_report(found.withColumn("sampling_rate", rate)).select(
        "level", *keys, "total_rows", "total_subjects", "start", "end", "duration_hours", "sampling_rate", *ranks
    )


def missing_of_states(states: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Missing count and percentage of every value column, per level, from states."""
    keys, columns = series_keys(states.columns), _known_columns(states)
    sums = [F.sum(f"{KNOWN}{c}").alias(f"{KNOWN}{c}") for c in columns]
    rolled = roll_up(states, keys, [F.sum("rows").alias("__rows"), *sums], levels=levels)
    listed = [F.struct(F.lit(c).alias("column"), (F.col("__rows") - F.col(f"{KNOWN}{c}")).alias("missing_count")) for c in columns]
    return rolled.select("level", *keys, "__rows", F.inline(F.array(*listed))).select(
        "level", *keys, "column", "missing_count", (F.col("missing_count") / F.col("__rows") * 100).alias("missing_pct")
    )
