"""Stress load: how long, per day and week, a subject's windows say stress.

Windows overlap and cross midnight, so their starts are not counted. Each window becomes pieces, one per day that it touches; the
pieces of a subject's day are laid over each other in one sweep, and the time under at least one of them counts once. A
partition of the sweep is one subject's day, so a subject's history is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biospark.contracts import POSITIVE_LABEL, series_keys

DAY_US = 86_400_000_000
SECOND_US = 1_000_000


def day_pieces(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """One row per interval and day: ``day`` (date, UTC), ``from_us`` and ``to_us`` inside it. Empty intervals have none."""
    # The last instant that belongs to an interval is just before its end.
    first = F.floor(F.unix_micros(start) / DAY_US).cast("long")
    last = F.floor((F.unix_micros(end) - 1) / DAY_US).cast("long")
    known = intervals.filter(F.col(start) < F.col(end))
    days = known.withColumn("__day", F.explode(F.sequence(first, last)))
    return days.withColumns(
        {
            "day": F.date_from_unix_date(F.col("__day").cast("int")),
            "from_us": F.greatest(F.unix_micros(start), F.col("__day") * DAY_US),
            "to_us": F.least(F.unix_micros(end), (F.col("__day") + 1) * DAY_US),
        }
    ).drop("__day")


def covered_us(pieces: DataFrame, keys: list[str], chosen: dict[str, Column]) -> DataFrame:
    """Microseconds of each of ``keys`` that at least one piece covers, for each named choice of pieces."""
    order = Window.partitionBy(*keys).orderBy("from_us", "to_us").rowsBetween(Window.unboundedPreceding, -1)
    swept = pieces
    for name, choice in chosen.items():
        reached = F.max(F.when(choice, F.col("to_us"))).over(order)
        new = F.col("to_us") - F.greatest(F.col("from_us"), F.coalesce(reached, F.col("from_us")))
        swept = swept.withColumn(name, F.when(choice, F.greatest(new, F.lit(0))).otherwise(0))
    return swept.groupBy(*keys).agg(F.count("*").alias("n_windows"), *[F.sum(name).alias(name) for name in chosen])


def daily_load(
    windows: DataFrame, keys: list[str] | None = None, label: str = "predicted_label", positive: str = POSITIVE_LABEL,
    start: str = "timestamp_start", end: str = "timestamp_end",
) -> DataFrame:
    """Per subject and day: windows that touch it, seconds under any window, seconds under a stress window, their ratio.

    A window without bounds, or that ends before it starts, counts nowhere; one without a label covers time but says nothing.
    """
    keys = series_keys(windows.columns) if keys is None else keys
    stress = F.coalesce(F.col(label) == positive, F.lit(False))
    pieces = day_pieces(windows.select(*keys, start, end, stress.alias("__stress")), start, end)
    found = covered_us(pieces, [*keys, "day"], {"__covered": F.lit(True), "__stressed": F.col("__stress")})
    return _loads(found, [*keys, "day"])


def weekly_load(daily: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``daily_load`` summed by week (its Monday); a window that touches two days counts for both."""
    keys = series_keys(daily.columns) if keys is None else keys
    week = F.to_date(F.date_trunc("week", "day")).alias("week")
    found = daily.groupBy(*keys, week).agg(
        F.count("*").alias("days"), F.sum("n_windows").alias("n_windows"),
        F.sum("covered_us").alias("__covered"), F.sum("stress_us").alias("__stressed"),
    )
    return _loads(found, [*keys, "week"], "days")


def _loads(found: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    load = F.try_divide(F.col("__stressed").cast("double"), F.col("__covered"))
    return found.select(
        *keys, *extra, "n_windows", F.col("__covered").alias("covered_us"), F.col("__stressed").alias("stress_us"), load.alias("load")
    )
