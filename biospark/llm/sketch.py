"""Count-min sketches that are built per partition and merged in slices.

A sketch has ``rows`` rows of ``2 ** bits`` counters; counters stop at ``limit``, which is all that the question
"may this key have been counted ``limit`` times?" needs. Estimates are never too low, so a key that was counted that
often always passes. Partitions hand on their counters in slices of ``SLICE`` cells, only those that are not zero;
merging reads a slice's parts as a stream, first within neighbouring partitions, so neither a task nor the driver
ever holds counters of all partitions. What reaches the driver and the workers is one bit per cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 16
# Partitions whose parts are merged before all are.
LANE = 64
PART = "slice int, cells binary, counts binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bits_for(cells: float, least: int, most: int) -> int:
    """The power of two that holds ``cells``, between two bounds."""
    return int(min(max(np.ceil(np.log2(max(cells, 1))), least), most))


@dataclass(frozen=True)
class Shape:
    rows: int
    bits: int
    limit: int

    def cells(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        """For each row the cells of well mixed ``keys``."""
        for row in range(self.rows):
            factor = mixed(np.array([row], np.uint64)) | np.uint64(1)
            yield ((keys * factor) >> np.uint64(64 - self.bits)).astype(np.int64) + (row << self.bits)


def parts(cells: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """Rows of ``PART`` for ascending distinct cells and their counts."""
    number = cells // SLICE
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    ends = [*starts[1:], len(cells)]
    low, small = (cells % SLICE).astype("<u2"), counts.astype(np.uint8)
    return pd.DataFrame(
        {
            "slice": number[starts].astype(np.int32),
            "cells": [low[a:b].tobytes() for a, b in zip(starts, ends)],
            "counts": [small[a:b].tobytes() for a, b in zip(starts, ends)],
        }
    )


def _merge(df: DataFrame, keys: list[str], limit: int, bits: bool) -> DataFrame:
    """One part per combination of ``keys``, read as a sorted stream; with ``bits`` only which cells reach the limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, np.zeros(SLICE, np.int32)

        def done() -> pd.DataFrame:
            if bits:
                packed = np.packbits(total >= limit, bitorder="little").tobytes()
                return pd.DataFrame({"slice": [now[0]], "bits": [packed]})
            cells = np.flatnonzero(total)
            return parts(cells + now[0] * SLICE, total[cells])

        for batch in batches:
            lanes = batch["lane"] if "lane" in keys else [0] * len(batch)
            for number, lane, cells, counts in zip(batch["slice"], lanes, batch["cells"], batch["counts"]):
                if now != (number, lane):
                    if now is not None:
                        yield done()
                    now, total = (number, lane), np.zeros(SLICE, np.int32)
                at = np.frombuffer(cells, "<u2")
                total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), limit)
        if now is not None:
            yield done()

    sorted_parts = df.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_parts.mapInPandas(run, "slice int, bits binary" if bits else PART)


def reached(partial: DataFrame, shape: Shape) -> Broadcast:
    """Which cells reach the limit, as ``rows * 2 ** bits / 8`` bytes at most, for all workers.

    ``partial`` has the counters of each partition (columns ``PART``).
    """
    lanes = partial.withColumn("lane", F.floor(F.spark_partition_id() / LANE).cast("int"))
    merged = _merge(lanes, ["slice", "lane"], shape.limit, bits=False)
    found = _merge(merged, ["slice"], shape.limit, bits=True).toPandas()
    table = np.zeros(max(shape.rows << shape.bits, SLICE) // 8, np.uint8)
    for number, packed in zip(found["slice"], found["bits"]):
        table[number * SLICE // 8 : (number + 1) * SLICE // 8] = np.frombuffer(packed, np.uint8)
    return partial.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, shape: Shape, keys: np.ndarray) -> np.ndarray:
    """Which keys may have been counted ``limit`` times."""
    out = np.ones(len(keys), bool)
    for cells in shape.cells(keys):
        out &= (table[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
    return out
