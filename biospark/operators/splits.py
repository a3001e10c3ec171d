"""Splits by subject and stratified folds.

Subjects (or rows) are ranked by the md5 of an id and the seed, so a split depends on nothing
but the ids and the seed. Ranks come from hash buckets, without a sort of everything in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biospark.operators.ordered import hash_bucket, row_positions
from biospark.operators.quality import subject_profile
from biospark.session import stage

# Least windows per subject, least subjects for the main path.
MIN_WINDOWS = 10
MIN_SUBJECTS = 3


def _ranked(subjects: DataFrame, seed: int) -> DataFrame:
    """Add ``rank``, the 0-based place of each subject in the seeded order."""
    keyed = subjects.withColumn("__hash", F.md5(F.concat_ws(":", "subject", F.lit(seed))))
    ranked = row_positions(keyed, [], hash_bucket(F.col("__hash")), ["__hash", "subject"], "rank")
    return ranked.drop("__hash")


def split_subjects(
    windows: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.2,
    random_state: int = 42,
    min_windows: int = MIN_WINDOWS,
    min_subjects: int = MIN_SUBJECTS,
) -> DataFrame:
    """Subject -> split (train, val, test, excluded), with its profile.

    Subjects need ``min_windows`` windows; with fewer than ``min_subjects`` such subjects, all subjects take part.
    The profile, one row per subject, is stored first, so the windows are computed once.
    """
    profile = stage(subject_profile(windows.filter(F.col("subject").isNotNull())))
    enough = F.col("n_windows") >= min_windows
    totals = profile.agg(F.count("*").alias("all"), F.count(F.when(enough, 1)).alias("valid"))
    profile = profile.withColumn("__totals", totals.select(F.struct("all", "valid")).scalar())
    main = F.col("__totals.valid") >= min_subjects
    takes_part = enough | ~main
    n = F.when(main, F.col("__totals.valid")).otherwise(F.col("__totals.all"))
    n_test = F.when(main, F.ceil(F.lit(test_size) * n)).otherwise(_at_least_one(n * F.lit(test_size)))
    rest = n - n_test
    n_val = F.when(
        main, F.when(rest > 1, F.ceil(F.lit(val_size / (1 - test_size)) * rest)).otherwise(0)
    ).otherwise(_at_least_one(rest * F.lit(val_size)))
    split = (
        F.when(F.col("rank") < n_test, "test").when(F.col("rank") < n_test + n_val, "val").otherwise("train")
    )
    ranked = _ranked(profile.filter(takes_part), random_state).withColumn("split", split)
    left_out = profile.filter(~takes_part).withColumn("split", F.lit("excluded"))
    return ranked.unionByName(left_out, allowMissingColumns=True).drop("__totals", "rank")


def _at_least_one(value: Column) -> Column:
    return F.greatest(F.floor(value), F.lit(1).cast("long"))


def split_table(subjects: DataFrame, random_state: int = 42) -> DataFrame:
    """Subject -> train or test for a table without prepared splits: a fifth, at least one, for testing."""
    distinct = subjects.select("subject").filter(F.col("subject").isNotNull()).distinct()
    total = distinct.agg(F.count("*").alias("n")).scalar()
    ranked = _ranked(distinct.withColumn("__n", total), random_state)
    n_test = F.greatest(F.floor(F.col("__n") / 5), F.lit(1).cast("long"))
    return ranked.select("subject", F.when(F.col("rank") < n_test, "test").otherwise("train").alias("split"))


def create_stratified_splits(
    windows: DataFrame, test_size: float = 0.2, val_size: float = 0.2, random_state: int = 42
) -> DataFrame:
    """The window table with a ``split`` column; subjects never span two splits.

    The windows are stored first, so that they are computed once. The subject table is stored too: its size on disk
    decides whether the join broadcasts it.
    """
    windows = stage(windows)
    subjects = stage(split_subjects(windows, test_size, val_size, random_state).select("subject", "split"))
    return windows.join(subjects, "subject").select(*windows.columns, "split")


def stratified_folds(
    df: DataFrame, label: str = "label", row_id: str = "window_id", k: int = 5, random_state: int = 42
) -> DataFrame:
    """Add ``fold`` 0..k-1: rows of each label in seeded order, dealt out in turn. The rows are stored first."""
    keyed = stage(df).withColumn("__hash", F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(random_state))))
    placed = row_positions(keyed, [label], hash_bucket(F.col("__hash")), ["__hash", row_id], "__place")
    return placed.select(*df.columns, F.pmod("__place", F.lit(k)).cast("int").alias("fold"))


def grouped_folds(df: DataFrame, k: int = 5, random_state: int = 42) -> DataFrame:
    """Add ``fold`` by subject, so that no subject is in two folds."""
    subjects = _ranked(df.select("subject").filter(F.col("subject").isNotNull()).distinct(), random_state)
    folds = stage(subjects.select("subject", F.pmod("rank", F.lit(k)).cast("int").alias("fold")))
    return df.join(folds, "subject").select(*df.columns, "fold")
