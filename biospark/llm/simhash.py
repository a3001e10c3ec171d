"""SimHash near-deduplication with vantage-point trees over Hamming distance.

1. Every text gets a 64-bit fingerprint from its word shingles.
2. Equal fingerprints are one class; copies never become pairs.
3. A tree is fitted to a small, bounded sample of the classes. Each inner node has a vantage point v and a radius m:
   fingerprints with d(x, v) <= m + r go left, those with d(x, v) > m go right (r: maximum distance of a
   link). By the triangle inequality two linked fingerprints whose distances to v lie on different sides
   of m differ by r at most, so both are in the left shard; every other linked pair shares a side. Fingerprints
   between m and m + r are the boundary overlap and sit in both shards.
4. Each shard is searched exactly by the same kind of tree in memory, down to blocks that are compared fully.
   A block emits links to the smallest member of each of its components, not its pairs.
5. The links are joined to connected components across shards.

The sample fixes where the splits are, never which links are found.

Defined cases: a null or empty text, or one without a word, has fingerprint zero and is linked like any
other; rows that repeat an identifier are rows of their own, of which one at most stays in a group; a row with a null
identifier stays only if its group has no other; an empty table gives an empty result. Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biospark.llm.components import components
from biospark.llm.words import ship_package, word_chunks
from biospark.session import stage

SEED = 42
# Fingerprints (distinct ones) a shard should hold, the largest sample, and the smallest share of it in a shard.
SHARD_ROWS = 2048
SAMPLE_ROWS = 1 << 18
SAMPLE_PER_SHARD = 16
# Fingerprints that are compared with each other without another split.
BLOCK = 256


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text as a signed 64-bit number: words are split at ASCII white space, A-Z become a-z."""
    total, ones, tail = 0, np.zeros(64, dtype=np.int64), []
    hasher, seen_words = xxhash.xxh64_intdigest, 0
    for words in word_chunks((text or "").encode().lower()):
        seen_words += len(words)
        words = tail + words
        tail = words[-(shingle - 1):] if shingle > 1 else []
        if len(words) >= shingle:
            joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
            hashes = np.fromiter((hasher(s, SEED) for s in joined), np.uint64, len(words) - shingle + 1)
            ones += _bits(hashes)
            total += len(hashes)
    if 0 < seen_words < shingle:
        ones, total = _bits(np.array([hasher(b" ".join(tail), SEED)], np.uint64)), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0]) if total else 0


def _bits(hashes: np.ndarray) -> np.ndarray:
    spread = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return spread.sum(axis=0, dtype=np.int64)


def fingerprints(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def fingerprint_text(value: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _distance(a: np.ndarray, b: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(points: np.ndarray, reach: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius with small sides and a small overlap; None if some side is always nearly everything."""
    best, found = np.inf, None
    for at in np.linspace(0, len(points) - 1, 8).astype(int):
        counts = np.bincount(_distance(points, points[at]), minlength=65 + reach)
        upto = counts.cumsum()
        left, right = upto[reach : reach + 64], len(points) - upto[:64]
        larger = np.maximum(left, right)
        # A small overlap is worth a little imbalance.
        cost = np.where(larger < 0.8 * len(points), larger + left + right, np.inf)
        radius = int(cost.argmin())
        if cost[radius] < best:
            best, found = cost[radius], (points[at], radius)
    return found


@dataclass
class Tree:
    """Inner nodes as arrays; a child below zero is the shard -(child + 1)."""

    vantage: np.ndarray
    radius: np.ndarray
    children: np.ndarray
    reach: int

    @classmethod
    def fit(cls, sample: np.ndarray, shards: int, reach: int) -> Tree:
        vantage, radius, children, leaves = [], [], [], 0
        small = max(SAMPLE_PER_SHARD, len(sample) / max(shards, 1))
        stack: list[tuple[np.ndarray, int, int]] = [(sample, -1, 0)]
        while stack:
            points, parent, side = stack.pop()
            cut = _split(points, reach) if len(points) > small else None
            if cut is None:
                place, leaves = -(leaves + 1), leaves + 1
            else:
                place = len(vantage)
                vantage.append(cut[0])
                radius.append(cut[1])
                children.append([0, 0])
                d = _distance(points, cut[0])
                stack += [(points[d <= cut[1] + reach], place, 0), (points[d > cut[1]], place, 1)]
            if parent >= 0:
                children[parent][side] = place
        return cls(np.array(vantage, np.uint64), np.array(radius, int), np.array(children, int).reshape(-1, 2), reach)

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions in ``points``) for every shard that gets any."""
        stack = [(0 if len(self.vantage) else -1, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield -(node + 1), at
                continue
            d = _distance(points[at], self.vantage[node])
            left, right = self.children[node]
            stack += [(left, at[d <= self.radius[node] + self.reach]), (right, at[d > self.radius[node]])]


def _block_labels(points: np.ndarray, reach: int) -> np.ndarray:
    """For each point the position of the smallest point of its component; rows are compared in slices."""
    label = np.arange(len(points))
    while True:
        before = label.copy()
        for i in range(0, len(points), BLOCK):
            near = np.bitwise_count(points[i : i + BLOCK, None] ^ points[None, :]) <= reach
            label[i : i + BLOCK] = np.where(near, label[None, :], len(points)).min(axis=1)
        label = label[label]
        if (label == before).all():
            return label


def shard_links(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, smaller point) that connect exactly what the links within ``reach`` connect."""
    a, b = [], []
    stack = [np.unique(points)]
    while stack:
        part = stack.pop()
        cut = _split(part, reach) if len(part) > BLOCK else None
        if cut is None:
            label = _block_labels(part, reach)
            moved = label != np.arange(len(part))
            a.append(part[moved])
            b.append(part[label[moved]])
        else:
            d = _distance(part, cut[0])
            stack += [part[d <= cut[1] + reach], part[d > cut[1]]]
    return np.concatenate(a), np.concatenate(b)


def _sample(classes: DataFrame, total: int) -> DataFrame:
    """``SAMPLE_PER_SHARD`` of ``SHARD_ROWS`` fingerprints, a small part of tables of any size, ``SAMPLE_ROWS`` at most."""
    share = min(SAMPLE_PER_SHARD / SHARD_ROWS, SAMPLE_ROWS / max(total, 1))
    return classes.filter(F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * share))


def near_links(classes: DataFrame, reach: int = 2) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column ``fp`` that connect what ``reach`` connects."""
    total = classes.count()
    sample = np.sort(_sample(classes, total).select("fp").toPandas()["fp"].to_numpy("int64").view(np.uint64))
    tree = Tree.fit(sample, -(-total // SHARD_ROWS), reach)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch["fp"].to_numpy("int64")
            for shard, at in tree.route(points.view(np.uint64)):
                yield pd.DataFrame({"shard": np.full(len(at), shard, np.int64), "fp": points[at]})

    def search(part: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(part["fp"].to_numpy("int64").view(np.uint64), reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = classes.select("fp").mapInPandas(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def _judged(docs: DataFrame, id_col: str, text_col: str, shingle: int, reach: int, row: Column) -> DataFrame:
    """row, id, fp, component (a fingerprint) and component_id for every row of ``docs``."""
    ship_package(docs.sparkSession)
    rows = stage(
        docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(
            "row", "id", fingerprints(F.col("text"), shingle).alias("fp")
        )
    )
    classes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    member = components(near_links(classes, reach))
    grouped = stage(
        classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "component", F.coalesce("component", "fp")
        )
    )
    named = stage(grouped.groupBy("component").agg(F.min("least").alias("component_id")))
    by_class = stage(grouped.join(named, "component").select("fp", "component", "component_id"))
    return rows.join(by_class, "fp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 2
) -> DataFrame:
    """One row per row of ``docs``: identifier, fp (signed), component_id, the smallest identifier reachable
    over links of at most ``reach`` differing bits."""
    judged = _judged(docs, id_col, text_col, shingle, reach, F.lit(None).cast("long"))
    return judged.select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 2
) -> DataFrame:
    """One row of each group, with all columns of ``docs``: the one with the smallest identifier.

    Of rows that share it (or that all have none) one stays; rows are told apart by hashes of their texts.
    """

    def hashes(text: Column) -> list[Column]:
        return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]

    judged = _judged(docs, id_col, text_col, shingle, reach, F.struct(*hashes(F.col(text_col).cast("string"))))
    counted = judged.groupBy("component", "id", "row").agg(F.count("*").alias("n"))
    first = counted.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "n")).alias("first"))
    kept = stage(
        first.select(
            F.col("first.id").alias("kept_id"), F.col("first.row.k1").alias("kept_1"), F.col("first.row.k2").alias("kept_2"),
            (F.col("first.n") > 1).alias("repeated"),
        )
    )
    held = docs.select(F.struct("*").alias("rest"), F.col(id_col).alias("id"), *hashes(F.col(text_col).cast("string")))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("k1") == F.col("kept_1")) & (F.col("k2") == F.col("kept_2"))
    found = held.join(kept.filter("not repeated"), same, "left_semi")
    repeated = kept.filter("repeated")
    if not repeated.isEmpty():
        found = found.unionByName(held.join(repeated, same, "left_semi").dropDuplicates(["id", "k1", "k2"]))
    return found.select("rest.*")
