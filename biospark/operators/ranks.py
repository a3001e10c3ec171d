"""Values by rank for many columns at a time, without sorting whole columns.

A chunk of rows hands on at most ``POINTS`` values of each column, evenly spread over the chunk's order; each stands for the
values between the one before and itself. Added up over all chunks they tell the rank of a value to one in ``POINTS``,
exactly where chunks hold no more values than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biospark.session import ship_package

# Rows that are sorted at a time, and the values that are kept of each column of them.
CHUNK = 65_536
POINTS = 10_240
SUMMARY = "feature int, n long, points binary"
MERGED = "feature int, n long, picked array<double>"
COUNTED = "feature int, below long, value binary, copies binary"


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Matrices of some ``CHUNK`` rows of a table of doubles, or of one array of doubles."""
    held, rows = [], 0
    for batch in batches:
        if batch.empty:
            continue
        held.append(np.stack(batch.iloc[:, 0].to_numpy()) if batch.dtypes.iloc[0] == object else batch.to_numpy(float))
        rows += len(batch)
        if rows >= CHUNK:
            yield np.concatenate(held)
            held, rows = [], 0
    if held:
        yield np.concatenate(held)


def kept_ranks(n: int) -> np.ndarray:
    """The ranks, from 1, of the values that a chunk with ``n`` of them hands on."""
    kept = min(n, POINTS)
    return np.unique(np.concatenate([np.ones(min(n, 1), np.int64), -(-np.arange(1, kept + 1) * n // max(kept, 1))]))


def known_of(column: np.ndarray) -> np.ndarray:
    return column[~np.isnan(column)]


def summaries(rows: DataFrame, wanted: Callable[[int, int], np.ndarray]) -> list:
    """Per column with any value: its place, the number of its values, and the values at the ranks, from 1, that ``wanted`` gives
    for this number and the most that ranks may be too low by."""
    ship_package(rows.sparkSession)

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in chunks(batches):
            found = []
            for i, column in enumerate(np.ascontiguousarray(block.T)):
                known = np.sort(known_of(column))
                found.append((i, len(known), known[kept_ranks(len(known)) - 1].tobytes()))
            yield pd.DataFrame(found, columns=["feature", "n", "points"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        counts = group["n"].to_numpy()
        n = int(counts.sum())
        if not n:
            return pd.DataFrame(columns=["feature", "n", "picked"])
        gaps = [np.diff(kept_ranks(k), prepend=0) for k in counts]
        points, gap = np.frombuffer(b"".join(group["points"])), np.concatenate(gaps)
        order = np.argsort(points, kind="stable")
        slack = sum(int(g.max()) - 1 for g in gaps if len(g))
        ranks = np.clip(wanted(n, slack), 1, n)
        picked = points[order][np.searchsorted(gap[order].cumsum(), ranks)]
        return pd.DataFrame({"feature": [int(group["feature"].iloc[0])], "n": [n], "picked": [picked.tolist()]})

    return rows.mapInPandas(summarize, SUMMARY).groupBy("feature").applyInPandas(merge, MERGED).collect()


def around_the_middle(n: int, slack: int) -> np.ndarray:
    """Ranks whose values enclose the median, whatever lies between the values that chunks hand on."""
    return np.array([(n - 1) // 2 + 1 - slack, n // 2 + 1])


def medians_between(rows: DataFrame, brackets: list, names: list[str]) -> DataFrame:
    """(feature, median) from the distinct values in each column's bracket, as ``summaries`` gives them, and the number below."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in chunks(batches):
            found, block = [], np.ascontiguousarray(block.T)
            for r in brackets:
                known, (low, high) = known_of(block[r["feature"]]), r["picked"]
                value, copies = np.unique(known[(known >= low) & (known <= high)], return_counts=True)
                found.append((r["feature"], int((known < low).sum()), value.tobytes(), copies.astype(np.int64).tobytes()))
            yield pd.DataFrame(found, columns=["feature", "below", "value", "copies"])

    known = {r["feature"]: r["n"] for r in brackets}

    def middle(group: pd.DataFrame) -> pd.DataFrame:
        feature = int(group["feature"].iloc[0])
        value, copies = np.frombuffer(b"".join(group["value"])), np.frombuffer(b"".join(group["copies"]), np.int64)
        order = np.argsort(value, kind="stable")
        upto = int(group["below"].sum()) + copies[order].cumsum()
        lower, upper = (known[feature] - 1) // 2 + 1, known[feature] // 2 + 1
        if group["below"].sum() >= lower or not len(upto) or upto[-1] < upper:
            raise ValueError("the bracket does not hold the median: the table changed while it was read")
        median = (value[order][np.searchsorted(upto, lower)] + value[order][np.searchsorted(upto, upper)]) / 2
        return pd.DataFrame({"feature": [names[feature]], "median": [median]})

    ship_package(rows.sparkSession)
    return rows.mapInPandas(count, COUNTED).groupBy("feature").applyInPandas(middle, "feature string, median double")
