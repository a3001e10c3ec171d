"""Biphasic temperature rises, the cycles between them, and how stress load goes with their regularity.

A night runs from the evening to the morning and bears the date of its evening. Frames over nights are calendar frames, so
missing nights are missing, not skipped. Nights are dealt to blocks of days with the few nights around that a frame
can see, and hits are joined to episodes by values carried from block to block, so a long history is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biospark.contracts import series_keys
from biospark.functions.scalars import nan_to_null
from biospark.operators.ordered import previous_value, running_sums
from biospark.session import stage

BLOCK_DAYS = 64
# Days per bucket of the range join of days to cycles.
JOIN_DAYS = 8
# Normal quantile of a two-sided interval of 95 %.
Z95 = 1.959963984540054


@dataclass(frozen=True)
class RiseOptions:
    """``after`` nights from a night on against ``before`` nights up to it, how many of them must be known, the rise in
    degrees, the days without a hit that end an episode, and the hours of the night (UTC)."""

    after: int = 3
    before: int = 6
    min_after: int = 2
    min_before: int = 3
    rise: float = 0.2
    apart: int = 3
    evening: int = 20
    morning: int = 8
    block: int = BLOCK_DAYS


def nightly_means(
    samples: DataFrame, options: RiseOptions = RiseOptions(), value: str = "temp", timestamp: str = "timestamp", keys: list[str] | None = None
) -> DataFrame:
    """Mean of the known values per subject and ``night`` (date of its evening), and their number. Other hours count nowhere."""
    keys = series_keys(samples.columns) if keys is None else keys
    hour = F.hour(timestamp)
    known = nan_to_null(samples).filter(F.col(value).isNotNull() & F.col(timestamp).isNotNull())
    asleep = known.filter((hour >= options.evening) | (hour < options.morning))
    night = F.to_date(F.col(timestamp) - F.make_dt_interval(F.lit(0), F.lit(options.morning))).alias("night")
    return asleep.groupBy(*keys, night).agg(F.avg(value).alias("mean"), F.count("*").alias("n_samples"))


def night_rises(nights: DataFrame, options: RiseOptions = RiseOptions(), keys: list[str] | None = None) -> DataFrame:
    """Each known night with the means around it and their difference; ``hit`` where it reaches the rise."""
    keys = series_keys(nights.columns) if keys is None else keys
    blocks = F.sequence(
        F.floor((F.col("__d") - (options.after - 1)) / options.block).cast("long"),
        F.floor((F.col("__d") + options.before) / options.block).cast("long"),
    )
    dealt = nights.withColumn("__d", F.unix_date("night").cast("long")).withColumn("__block", F.explode(blocks))
    order = Window.partitionBy(*keys, "__block").orderBy("__d")
    after, before = order.rangeBetween(0, options.after - 1), order.rangeBetween(-options.before, -1)
    around = dealt.withColumns(
        {
            "n_after": F.count("mean").over(after), "n_before": F.count("mean").over(before),
            "mean_after": F.avg("mean").over(after), "mean_before": F.avg("mean").over(before),
        }
    ).filter(F.floor(F.col("__d") / options.block) == F.col("__block"))
    enough = (F.col("n_after") >= options.min_after) & (F.col("n_before") >= options.min_before)
    rise = F.when(enough, F.col("mean_after") - F.col("mean_before"))
    return around.withColumns({"rise": rise, "hit": F.coalesce(rise >= options.rise, F.lit(False))}).drop("__d", "__block")


def rise_episodes(rises: DataFrame, options: RiseOptions = RiseOptions(), keys: list[str] | None = None) -> DataFrame:
    """Hits no more than ``apart`` days from the one before, joined: episode (1, 2, ... per subject), start, last, hits, peak."""
    keys = series_keys(rises.columns) if keys is None else keys
    hits = rises.filter("hit").select(*keys, "night", "rise", F.unix_date("night").cast("long").alias("__d"))
    block = F.floor(F.col("__d") / options.block).cast("long")
    linked = previous_value(hits, keys, block, "__d", name="__last")
    new = (F.col("__last").isNull() | (F.col("__d") - F.col("__last") > options.apart)).cast("long")
    numbered = running_sums(linked.withColumn("__block", block), keys, "__block", ["__d"], {"episode": new})
    return numbered.groupBy(*keys, "episode").agg(
        F.min("night").alias("start"), F.max("night").alias("last"), F.count("*").alias("hits"), F.max("rise").alias("peak")
    )


def temperature_rises(
    samples: DataFrame, options: RiseOptions = RiseOptions(), value: str = "temp", timestamp: str = "timestamp", keys: list[str] | None = None
) -> DataFrame:
    """The episodes of biphasic temperature rise of each subject."""
    return rise_episodes(night_rises(nightly_means(samples, options, value, timestamp, keys), options, keys), options, keys)


def cycles_of(episodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stretches from one episode's start to the next one's: cycle, start, stop, days, and how far the days lie from the
    subject's mean (``irregularity``)."""
    keys = series_keys(episodes.columns) if keys is None else keys
    # One row per episode, a few dozen a year.
    order = Window.partitionBy(*keys).orderBy("episode")
    ended = episodes.withColumn("stop", F.lead("start").over(order)).filter(F.col("stop").isNotNull())
    days = F.date_diff("stop", "start").cast("long")
    with_days = ended.select(*keys, F.col("episode").alias("cycle"), "start", "stop", days.alias("days"))
    spread = F.abs(F.col("days") - F.avg("days").over(Window.partitionBy(*keys)))
    return with_days.withColumn("irregularity", spread)


def cycle_loads(cycles: DataFrame, daily: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each cycle with the stress load of its days (first day included, last not).

    Days meet cycles by subject and stretch of ``JOIN_DAYS`` days, not by subject alone.
    """
    keys = series_keys(cycles.columns) if keys is None else keys
    first, last = F.unix_date("start"), F.unix_date("stop") - 1
    stretch = F.explode(F.sequence(_stretch(first), _stretch(last))).alias("__stretch")
    spread = cycles.select(*keys, "cycle", "start", "stop", stretch)
    days = daily.select(*keys, "day", "stress_us", "covered_us", _stretch(F.unix_date("day")).alias("__stretch"))
    inside = (F.col("day") >= F.col("start")) & (F.col("day") < F.col("stop"))
    loads = spread.join(days, [*keys, "__stretch"]).filter(inside).groupBy(*keys, "cycle").agg(
        F.sum("stress_us").alias("stress_us"), F.sum("covered_us").alias("covered_us")
    )
    load = F.try_divide(F.col("stress_us").cast("double"), F.col("covered_us"))
    return cycles.join(loads, [*keys, "cycle"], "left").withColumn("load", load)


def _stretch(day: Column) -> Column:
    return F.floor(day / JOIN_DAYS).cast("long")


def co_moments(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key what correlations need: n, means, squared sums and the mixed sum of deviations. Rows with a null are left out."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count("*")
    return known.groupBy(*keys).agg(
        n.alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        (F.var_pop(x) * n).alias("xx"), (F.var_pop(y) * n).alias("yy"), (F.covar_pop(x, y) * n).alias("xy"),
    )


def correlation(moments: DataFrame, least: int = 4) -> DataFrame:
    """``r`` per row of ``co_moments``; null with fewer than ``least`` pairs or without any spread."""
    spread = (F.col("xx") > 1e-12) & (F.col("yy") > 1e-12)
    r = F.when((F.col("n") >= least) & spread, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    # Rounding may carry a perfect correlation beyond 1.
    return moments.withColumn("r", r).withColumn("r", F.when(F.abs("r") > 1, F.signum("r")).otherwise(F.col("r")))


def pooled_correlation(correlations: DataFrame) -> DataFrame:
    """One row over subjects: pooled r with its 95 % interval (Fisher's z, weighted by n - 3), and the correlation of all
    deviations from the subjects' own means. A subject with |r| = 1 has an unbounded z and counts at 1 - 1e-9."""
    usable = correlations.filter("r is not null and n > 3")
    edge = F.greatest(F.lit(1e-9 - 1), F.least(F.lit(1 - 1e-9), F.col("r")))
    weighted = usable.agg(
        F.count("*").alias("subjects"), F.sum("n").alias("pairs"), F.sum(F.col("n") - 3).alias("w"),
        F.sum((F.col("n") - 3) * F.atanh(edge)).alias("wz"),
        F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.sum("xy").alias("xy"),
    )
    z, half = F.col("wz") / F.col("w"), Z95 / F.sqrt("w")
    return weighted.select(
        "subjects", "pairs", F.tanh(z).alias("r"), F.tanh(z - half).alias("r_low"), F.tanh(z + half).alias("r_high"),
        (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("r_within"),
    )


def load_and_regularity(
    samples: DataFrame, daily: DataFrame, options: RiseOptions = RiseOptions(), least: int = 4, keys: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(per subject, pooled): how the stress load of a cycle goes with how irregular the cycle is."""
    keys = series_keys(samples.columns) if keys is None else keys
    cycles = cycles_of(temperature_rises(samples, options, keys=keys), keys)
    per_subject = stage(correlation(co_moments(cycle_loads(cycles, daily, keys), keys, "load", "irregularity"), least))
    return per_subject, pooled_correlation(per_subject)
