"""Connected components of a link table by large-star and small-star steps.

Every step is one minimum per node, combined before its shuffle, and one join; results are written to
the shared folder, so a lost executor costs one step. A node with very many links is a skewed
join key between two stored tables, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biospark.session import stage


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Connect the larger (or the smaller and own) neighbours of each node to the smallest one around it."""
    both = links.union(links.select("b", "a"))
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    if large:
        moved = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        smaller = both.filter("b < a")
        moved = (
            smaller.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        )
    return stage(moved.filter("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """One row (node, component) per node of ``links(a, b)``; the component is its smallest node.

    ``links`` holds whole numbers without nulls, in either direction, with or without repeats. An
    empty table gives an empty result.
    """
    current = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(current)
    while True:
        current = _star(_star(current, large=True), large=False)
        after = _signature(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
