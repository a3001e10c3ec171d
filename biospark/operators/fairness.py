"""How far quality metrics lie apart between subgroups, with bootstrap intervals.

A replicate of the bootstrap gives every unit (a subject, or a row) a Poisson(1) number of copies that follows from the
unit's name, the seed and the replicate's number. All replicates and the plain estimate (replicate 0, one copy each) are
one aggregation over counts per unit, so rows are read once, and a run can be repeated on any cluster.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biospark.contracts import POSITIVE_LABEL

METRICS = ("accuracy", "precision", "recall", "f1")
# Upper ends of the probabilities of 0, 1, 2, ... copies under Poisson(1), as far as 32 bits tell them apart.
POISSON_STEPS = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(12)]


def copies(unit: Column, seed: int, replicate: Column) -> Column:
    """How often a unit counts in a replicate; once in replicate 0."""
    name = F.concat_ws("|", unit.cast("string"), F.lit(seed).cast("string"), replicate.cast("string"))
    share = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 2.0**32
    drawn = sum(((share >= step).cast("int") for step in POISSON_STEPS), F.lit(0))
    return F.when(replicate == 0, 1).otherwise(drawn)


def unit_counts(
    predictions: DataFrame, group: str, unit: str, label: str = "label", predicted: str = "predicted_label", positive: str = POSITIVE_LABEL
) -> DataFrame:
    """Per subgroup and unit the counts of the confusion of one class. Rows without a group, unit, label or prediction count nowhere."""
    known = predictions.select(group, unit, label, predicted).dropna()
    is_positive, said = F.col(label) == positive, F.col(predicted) == positive
    return known.groupBy(F.col(group).cast("string").alias("subgroup"), F.col(unit).alias("unit")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col(label) == F.col(predicted), 1)).alias("right"),
        F.count(F.when(is_positive & said, 1)).alias("tp"), F.count(F.when(said, 1)).alias("said"),
        F.count(F.when(is_positive, 1)).alias("positive"),
    )


def replicate_metrics(counts: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """One row per replicate, subgroup and metric; a metric that has no cases is null."""
    every = counts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    weighted = every.withColumn("w", copies(F.col("unit"), seed, F.col("replicate"))).filter("w > 0")
    sums = weighted.groupBy("replicate", "subgroup").agg(
        *[F.sum(F.col(c) * F.col("w")).cast("double").alias(c) for c in ("n", "right", "tp", "said", "positive")]
    )
    values = {
        "accuracy": F.try_divide("right", "n"), "precision": F.try_divide("tp", "said"), "recall": F.try_divide("tp", "positive"),
        "f1": F.try_divide(F.lit(2.0) * F.col("tp"), F.col("said") + F.col("positive")),
    }
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), values[m].alias("value")) for m in METRICS])
    return sums.select("replicate", "subgroup", "n", F.inline(pairs))


def subgroup_spread(
    predictions: DataFrame, group: str, unit: str, label: str = "label", predicted: str = "predicted_label",
    positive: str = POSITIVE_LABEL, replicates: int = 200, seed: int = 0, level: float = 0.95,
) -> DataFrame:
    """Per metric: number of subgroups, lowest and highest value and whose they are, the gap between them, and the bootstrap's
    interval of the gap.

    ``unit`` is what is drawn: name the subject where a subject has many windows, because those are not independent.
    """
    values = replicate_metrics(unit_counts(predictions, group, unit, label, predicted, positive), replicates, seed)
    known = values.filter("value is not null")
    ordered = F.struct("value", "subgroup")
    gaps = known.groupBy("metric", "replicate").agg(
        F.count("*").alias("subgroups"), F.min(ordered).alias("low"), F.max(F.struct(F.col("value"), F.col("subgroup"))).alias("high")
    ).withColumn("gap", F.col("high.value") - F.col("low.value"))
    drawn = F.when(F.col("replicate") > 0, F.col("gap"))
    plain = lambda c: F.max(F.when(F.col("replicate") == 0, F.col(c)))
    return gaps.groupBy("metric").agg(
        plain("subgroups").alias("subgroups"),
        plain("low.value").alias("lowest"), plain("low.subgroup").alias("lowest_in"),
        plain("high.value").alias("highest"), plain("high.subgroup").alias("highest_in"),
        plain("gap").alias("gap"), F.count(drawn).alias("replicates"),
        F.percentile(drawn, (1 - level) / 2).alias("gap_low"), F.percentile(drawn, (1 + level) / 2).alias("gap_high"),
    )
