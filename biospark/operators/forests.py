"""Random forests whose trees grow on the executors, and stay there.

MLlib keeps every node of every tree on the driver and sends the trees to all tasks of every pass, which a deep forest over
many rows outgrows. Here rows are stored with their features as bins and with the number of times that each tree draws
them. While a node holds more than ``ROWS_PER_TASK`` drawn rows it is split as in MLlib, by the summed histograms of all
tasks; only these upper nodes come to the driver. All rows of a smaller node go to one task, which grows what hangs below
it. A forest is these upper nodes and a stored table of lower trees. A scored row goes to one lower tree per tree, and what
the trees say is added up by blocks of scored rows.

A task keeps the rows of a level in the order of its nodes. The drawn rows per class of a node, feature and bin are fields of
one number, so that one count serves all classes; only the bins that a node's rows are in are looked at as borders.

As in MLlib: bins with as many borders on all rows' quantiles, Poisson(1) samples, the square root of the number of features
drawn per node, Gini impurity, the mean of the leaves' shares, importances by weighted gain and normalised per tree.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biospark.operators.fairness import POISSON_STEPS
from biospark.operators.ranks import summaries
from biospark.session import ship_package, stage

# MLlib's number of bins, and the quantiles that their borders are picked from.
BINS = 32
QUANTILES = 1024
# A node with more drawn rows is split by histograms of all tasks.
ROWS_PER_TASK = 2_000_000
# Partitions per tree, more than it has lower trees in most tables, so that few tasks grow several.
TASKS_PER_TREE = 8
# Rows that are scored in one task by one lower tree, and rows whose trees' shares are added up in one task, at most 2**16.
SCORED_PER_TASK = 2_000_000
SCORED_BLOCK = 16_384
# Rows and nodes of a task whose bins are counted at the same time.
ROWS_AT_ONCE = 32_768
NODES_AT_ONCE = 4096
# Bits of a field for the drawn rows of a class in a small node, twice as many in a large one; doubles hold 52.
FIELD = 13
# The class of a row that comes to a leaf of several.
SEVERAL = 255
# Shares are added as whole numbers of this part, so that the order of trees does not show in a sum.
UNIT = 2.0**-40
LEAF = -1
LOWER = "tree int, node int, feature binary, bin binary, below binary, shares binary, importance array<double>"


def bin_borders(rows: DataFrame) -> list[list[float]]:
    """Upper ends of all bins but the last of each feature; features of few values have a bin for each."""

    def steps(n: int, slack: int) -> np.ndarray:
        return -(-np.arange(QUANTILES + 1) * n // QUANTILES)

    borders = []
    for r in sorted(summaries(rows.select(vector_to_array("__features")), steps), key=lambda r: r["feature"]):
        found = r["picked"]
        inner = sorted(set(found))[:-1]
        if len(inner) >= BINS:
            every = found[QUANTILES // BINS : QUANTILES : QUANTILES // BINS]
            inner = sorted(set(every) - {found[-1]})
        borders.append(inner)
    return borders


def binned(rows: DataFrame, borders: list[list[float]], kept: list[str], trees: int = 0, seed: int = 0) -> DataFrame:
    """The columns ``kept`` and ``__bins``, as ``squeezed`` makes them; with ``trees`` also ``__times``, a byte per tree."""
    edges = [np.asarray(b) for b in borders]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            values = np.ascontiguousarray(np.stack(batch.pop("__x").to_numpy()).T)
            bins = np.stack([np.searchsorted(edge, column) for edge, column in zip(edges, values)], 1)
            batch["__bins"] = [row.tobytes() for row in squeezed(bins)]
            if trees:
                times = np.stack([drawn_times(batch["__unit"].to_numpy(), seed, t) for t in range(trees)], 1)
                batch["__times"] = [row.tobytes() for row in times]
            yield batch

    plain = rows.select(*kept, vector_to_array("__features").alias("__x"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields if f.name != "__x"]
    return plain.mapInPandas(place, ", ".join([*types, "__bins binary", *(["__times binary"] if trees else [])]))


def squeezed(bins: np.ndarray) -> np.ndarray:
    """Three bins of five bits to a number of two bytes."""
    spread = np.zeros((len(bins), -(-bins.shape[1] // 3) * 3), np.uint16)
    spread[:, : bins.shape[1]] = bins
    return (spread[:, ::3] | spread[:, 1::3] << 5 | spread[:, 2::3] << 10).astype("<u2")


def unsqueezed(column: pd.Series, features: int) -> np.ndarray:
    threes = np.frombuffer(b"".join(column), "<u2").reshape(-1, -(-features // 3))
    bins = np.empty((*threes.shape, 3), np.uint8)
    for k in range(3):
        bins[:, :, k] = threes >> 5 * k & 31
    return np.ascontiguousarray(bins.reshape(len(threes), -1)[:, :features])


def drawn_times(units: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree's sample holds each row: Poisson(1) by the row's number, through SplitMix64."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % 2**64)
    x = units.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON_STEPS, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.uint8)


def matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, width)


def histograms(
    bins: np.ndarray, label: np.ndarray, times: np.ndarray, node: np.ndarray, drawn: np.ndarray, classes: int
) -> np.ndarray:
    """Drawn rows by node, one of its drawn features, bin and class."""
    nodes, several = drawn.shape
    out = np.empty((nodes, several, BINS, classes))
    first, cell, flat = np.arange(len(node)) * bins.shape[1], node * (BINS * classes) + label, bins.reshape(-1)
    for j in range(several):
        at = cell + flat.take(first + drawn[:, j].take(node)) * np.int64(classes)
        out[:, j] = np.bincount(at, times, nodes * BINS * classes).reshape(nodes, BINS, classes)
    return out


def best_splits(counted: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node: the place of the best feature among those drawn, its last bin to the left, the gain times the node's weight
    (0: no split), and the counted rows per class to the left and in all."""
    nodes, features, _, classes = counted.shape
    left = counted.cumsum(2)
    total = left[:, 0, -1]

    def spread(counts: np.ndarray) -> np.ndarray:
        """Gini impurity times weight."""
        weighed = counts * weights
        whole = weighed.sum(-1)
        return whole - np.divide((weighed * weighed).sum(-1), whole, out=np.zeros_like(whole), where=whole > 0)

    gain = spread(total)[:, None, None] - spread(left) - spread(total[:, None, None] - left)
    rows = left.sum(-1)
    gain[(rows == 0) | (rows == rows[:, :, -1:])] = 0
    # Noise of the sums is no gain.
    gain[gain <= 1e-9 * (total * weights).sum(-1)[:, None, None]] = 0
    flat = gain.reshape(nodes, features * BINS)
    best = flat.argmax(1)
    place, last = best // BINS, best % BINS
    at = np.arange(nodes)
    return place, last, flat[at, best], left[at, place, last], total


def packed_splits(
    bins: np.ndarray, label: np.ndarray, times: np.ndarray, sizes: np.ndarray, drawn: np.ndarray,
    total: np.ndarray, weights: np.ndarray, field: int,
) -> tuple[np.ndarray, ...]:
    """What ``best_splits`` gives, but the last, for nodes whose ``sizes`` rows follow each other.

    ``total`` are their drawn rows per class, each below 2**``field``. Counts of a bin's classes are fields of one double, or
    of several where there are more classes than fit.
    """
    nodes, several = drawn.shape
    fields = 52 // field
    word, shift = np.arange(len(weights)) // fields, np.arange(len(weights)) % fields * field
    node = np.repeat(np.arange(nodes), sizes)
    one = times * (2.0**shift).take(label)
    ones = [one] if word[-1] == 0 else [np.where(word.take(label) == k, one, 0) for k in range(word[-1] + 1)]
    counted = np.empty((len(ones), several, nodes * BINS))
    first, begins, flat = np.arange(len(label)) * bins.shape[1], node * BINS, bins.reshape(-1)
    for j in range(several):
        cell = begins + flat.take(first + drawn[:, j].take(node))
        for k, own in enumerate(ones):
            counted[k, j] = np.bincount(cell, own, nodes * BINS)
    counted = counted.reshape(len(ones), -1)
    # Bins with rows; the last of each feature is no border, as nothing is to its right.
    cell = np.flatnonzero(counted[0] != 0 if len(ones) == 1 else counted.any(0))
    place = cell // BINS
    inner = np.flatnonzero(place[1:] == place[:-1])
    border, place = cell[inner], place[inner]
    borders = np.bincount(place, minlength=several * nodes)
    lefts = []
    for k, count in enumerate(counted):
        # Running over all features and nodes; a field that overflows does so in both terms of the difference.
        whole = (total[:, word == k].astype(np.int64) << shift[word == k]).sum(1)
        before = (whole.cumsum() - whole) + np.arange(several)[:, None] * whole.sum()
        lefts.append(count[cell].astype(np.int64).cumsum()[inner] - before.ravel()[place])

    def left_of(c: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        return (lefts[word[c]][some] >> shift[c] & (1 << field) - 1).astype(float)

    # Gini impurity times weight of both sides: whole less the sum of squares by whole.
    node = place % nodes
    sides = [[np.zeros(len(border)), np.zeros(len(border))] for _ in range(2)]
    for c, weight in enumerate(weights):
        left = left_of(c)
        for (whole, squares), own in zip(sides, (left, total[:, c].take(node) - left)):
            own *= weight
            whole += own
            own *= own
            squares += own
    weighed = total * weights
    whole = weighed.sum(1)
    gain = (whole - (weighed * weighed).sum(1) / whole).take(node)
    for own, squares in sides:
        squares /= own
        own -= squares
        gain -= own
    # The best of each feature and node, then of each node; the first of equals.
    some = np.flatnonzero(borders)
    most, found = np.zeros(several * nodes), np.zeros(several * nodes, np.int64)
    if len(some):
        begins = (borders.cumsum() - borders)[some]
        most[some] = np.maximum.reduceat(gain, begins)
        best = np.flatnonzero(gain == most.take(place))
        found[some] = best[np.searchsorted(best, begins)]
    most = most.reshape(several, nodes)
    feature, at = most.argmax(0), np.arange(nodes)
    gain, found = most[feature, at], found.reshape(several, nodes)[feature, at]
    # Noise of the sums is no gain.
    gain[gain <= 1e-9 * whole] = 0
    if not len(border):
        return feature, np.zeros(nodes, np.int64), gain, np.zeros(total.shape)
    return feature, border[found] % BINS, gain, np.stack([left_of(c, found) for c in range(len(weights))], 1)


def drawn_features(nodes: int, features: int, *seeds: int) -> np.ndarray:
    """The square root of their number of features for each node."""
    several = max(1, math.ceil(math.sqrt(features)))
    # Doubles from 0 on are in the order of their bits; the last bits give way to the feature's number.
    last = (1 << features.bit_length()) - 1
    keys = np.random.default_rng(seeds).random((nodes, features)).view(np.int64)
    keys &= ~last
    keys |= np.arange(features)
    keys.sort(1)
    return keys[:, :several] & last


def descend(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The leaf, as its place in the tree's arrays, that each row comes to."""
    feature, border, below = tree["feature"], tree["bin"], tree["below"]
    at = np.zeros(len(bins), np.int64)
    if not len(feature) or feature[0] == LEAF:
        return at
    flat = bins.reshape(-1)
    rows, here = np.arange(len(bins)), at
    while len(rows):
        here = below.take(here) + (flat.take(rows * bins.shape[1] + feature.take(here)) > border.take(here))
        at[rows] = here
        going = np.flatnonzero(feature.take(here) != LEAF)
        rows, here = rows[going], here[going]
    return at


def grow(
    bins: np.ndarray, label: np.ndarray, times: np.ndarray, weights: np.ndarray, depth: int, seeds: tuple[int, ...]
) -> dict:
    """A whole tree over rows of one task, level by level: arrays by node, shares by node, importances."""
    classes, features = len(weights), bins.shape[1]
    total = np.bincount(label, times, classes)
    feature, border, below, counts = [[LEAF]], [[0]], [[0]], [total[None]]
    importance = np.zeros(features)
    # The open nodes by their places in their level; the rows of each follow each other.
    base = 0
    open_nodes, sizes = (np.arange(1), np.array([len(label)])) if (total > 0).sum() > 1 else (np.arange(0), np.arange(0))
    for level in range(depth):
        if not len(open_nodes):
            break
        order = np.argsort(open_nodes)
        drawn = drawn_features(len(open_nodes), features, *seeds, level)[np.argsort(order)]
        whole, ends = counts[-1][open_nodes], sizes.cumsum()
        large = whole.max(1) >= 2**FIELD
        parts = ends // ROWS_AT_ONCE, np.arange(len(ends)) // NODES_AT_ONCE, large
        cuts = np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], 0)) + 1
        found = []
        for low, high in zip([0, *cuts], [*cuts, len(ends)]):
            part, rows = slice(low, high), slice(ends[low] - sizes[low], ends[high - 1])
            field = 2 * FIELD if large[low] else FIELD
            found.append(packed_splits(bins[rows], label[rows], times[rows], sizes[part], drawn[part], whole[part], weights, field))
        place, last, gain, left = map(np.concatenate, zip(*found))
        chosen = drawn[np.arange(len(open_nodes)), place]
        split = order[gain[order] > 0]
        np.add.at(importance, chosen[split], gain[split])
        at = open_nodes[split]
        feature[-1], border[-1], below[-1] = map(np.array, (feature[-1], border[-1], below[-1]))
        base += len(feature[-1])
        feature[-1][at], border[-1][at], below[-1][at] = chosen[split], last[split], base + 2 * np.arange(len(at))
        children = np.stack([left[split], whole[split] - left[split]], 1).reshape(-1, classes)
        feature.append(np.full(len(children), LEAF))
        border.append(np.zeros(len(children), int))
        below.append(np.zeros(len(children), int))
        counts.append(children)
        # Rows go on to the children that hold more than one class, those of all left children first.
        right = bins.reshape(-1).take(np.arange(len(label)) * features + np.repeat(chosen, sizes)) > np.repeat(last, sizes)
        mixed, gone = (children > 0).sum(1) > 1, []
        for side, taken in enumerate((~right, right)):
            child, goes = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
            child[split], goes[split] = 2 * np.arange(len(split)) + side, mixed[side::2]
            own = np.flatnonzero(taken & np.repeat(goes, sizes))
            held = np.searchsorted(own, ends) - np.searchsorted(own, ends - sizes)
            gone.append((own, child[goes], held[goes]))
        alive, open_nodes, sizes = map(np.concatenate, zip(*gone))
        bins, label, times = bins[alive], label[alive], times[alive]
    weighed = np.concatenate(counts) * weights
    return {
        "feature": np.concatenate(feature).astype(np.int16), "bin": np.concatenate(border).astype(np.uint8),
        "below": np.concatenate(below).astype(np.int32), "shares": weighed / weighed.sum(1, keepdims=True), "importance": importance,
    }


def packed(tree: int, node: int, grown: dict) -> dict:
    """A row of the table of lower trees. ``below`` of a leaf is the place of its shares: those of a single class come first."""
    leaf, classes = grown["feature"] == LEAF, grown["shares"].shape[1]
    own = grown["shares"][leaf]
    mixed = np.flatnonzero(own.max(1) < 1)
    place = own.argmax(1)
    place[mixed] = classes + np.arange(len(mixed))
    below = grown["below"].astype("<i4")
    below[leaf] = place
    shares = np.concatenate([np.eye(classes), own[mixed]])
    return {
        "tree": tree, "node": node, "feature": grown["feature"].astype("<i2").tobytes(), "bin": grown["bin"].tobytes(),
        "below": below.tobytes(), "shares": shares.astype("<f8").tobytes(), "importance": grown["importance"].tolist(),
    }


def unpacked(row) -> dict:
    return {
        "feature": np.frombuffer(row.feature, "<i2"), "bin": np.frombuffer(row.bin, np.uint8),
        "below": np.frombuffer(row.below, "<i4"), "shares": np.frombuffer(row.shares, "<f8"),
    }


def _arrays(top: dict) -> dict:
    return {k: np.asarray(top[k], np.int32) for k in ("feature", "bin", "below")}


def _upper_trees(rows: DataFrame, trees: int, features: int, weights: list[float], depth: int, seed: int) -> list[dict]:
    """The upper nodes of all trees, from one pass over the rows per level.

    ``final`` holds the counts of nodes for which no rows are sent on: one class is left, or a large node has no split.
    """
    classes = len(weights)
    tops = [{"feature": [LEAF], "bin": [0], "below": [0], "level": [0], "final": {}, "importance": [0.0] * features} for _ in range(trees)]
    opened = [[0] if rows.count() > ROWS_PER_TASK else []] * trees
    level = 0
    # The functions of a pass are sent before the next pass changes what they read.
    while any(opened) and level < depth:
        drawn = [drawn_features(len(nodes), features, seed, tree, level) for tree, nodes in enumerate(opened)]
        shapes = [_arrays(top) for top in tops]

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {}
            for batch in batches:
                if batch.empty:
                    continue
                bins, label = unsqueezed(batch["__bins"], features), batch["__label"].to_numpy(np.int64)
                times = matrix(batch["__times"], trees).T.copy()
                for t, nodes in enumerate(opened):
                    if not nodes:
                        continue
                    place = np.full(len(shapes[t]["feature"]), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = np.flatnonzero(times[t])
                    node = place[descend(shapes[t], bins[at])]
                    at, node = at[node >= 0], node[node >= 0]
                    found = histograms(bins[at], label[at], times[t, at], node, drawn[t], classes)
                    sums[t] = sums[t] + found if t in sums else found
            for t in sums:
                yield pd.DataFrame({"tree": t, "node": opened[t], "sums": [h.tobytes() for h in sums[t]]})

        def decide(group: pd.DataFrame) -> pd.DataFrame:
            tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
            own = drawn[tree][opened[tree].index(node)]
            summed = np.sum([np.frombuffer(h) for h in group["sums"]], axis=0).reshape(1, len(own), BINS, classes)
            place, last, gain, left, whole = (x[0] for x in best_splits(summed, np.asarray(weights)))
            return pd.DataFrame([{
                "tree": tree, "node": node, "feature": int(own[place]), "bin": int(last), "gain": float(gain),
                "left": left.tolist(), "whole": whole.tolist(),
            }])

        decided = "tree int, node int, feature int, bin int, gain double, left array<double>, whole array<double>"
        counted = rows.mapInPandas(count, "tree int, node int, sums binary")
        made = counted.groupBy("tree", "node").applyInPandas(decide, decided).collect()
        opened, level = [[] for _ in tops], level + 1
        for r in sorted(made, key=lambda r: (r["tree"], r["node"])):
            top, whole = tops[r["tree"]], np.array(r["whole"])
            if r["gain"] <= 0:
                top["final"][r["node"]] = whole.tolist()
                continue
            first = len(top["feature"])
            top["feature"][r["node"]], top["bin"][r["node"]], top["below"][r["node"]] = r["feature"], r["bin"], first
            top["importance"][r["feature"]] += r["gain"]
            for node, own in enumerate((np.array(r["left"]), whole - np.array(r["left"])), first):
                for name, value in (("feature", LEAF), ("bin", 0), ("below", 0), ("level", level)):
                    top[name].append(value)
                if (own > 0).sum() < 2 or level == depth:
                    top["final"][node] = own.tolist()
                elif own.sum() > ROWS_PER_TASK:
                    opened[r["tree"]].append(node)
    return tops


def _deal(tops: list[dict], features: int, trees: int, scored: bool):
    """A function of batches that sends each row, with others in one record, to the lower tree of each tree it is in.

    Rows to learn from take their label and times along, scored rows their place in their block, which is its own record.
    """
    shapes, final = [_arrays(top) for top in tops], [[] if scored else list(top["final"]) for top in tops]
    names = ["block", "__bins", "__place"] if scored else ["__bins", "__label", "__times"]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            threes = np.frombuffer(b"".join(batch["__bins"]), "<u2").reshape(len(batch), -1)
            bins = unsqueezed(batch["__bins"], features) if any(len(shape["feature"]) > 1 for shape in shapes) else threes
            block = batch["__block"].to_numpy() if scored else np.zeros(len(batch), np.int64)
            other = batch["__place"].to_numpy("<u2") if scored else batch["__label"].to_numpy(np.uint8)
            part = batch["__part"].to_numpy() if scored else block
            times = None if scored else matrix(batch["__times"], trees).T.copy()
            records = []
            for t, shape in enumerate(shapes):
                at = np.arange(len(bins)) if scored else np.flatnonzero(times[t])
                node = descend(shape, bins[at])
                if final[t]:
                    kept = ~np.isin(node, final[t])
                    at, node = at[kept], node[kept]
                if len(shape["feature"]) > 1:
                    order = np.argsort(node, kind="stable")
                    at, node = at[order], node[order]
                apart = (np.diff(node) != 0) | (np.diff(block[at]) != 0)
                for rows in np.split(np.arange(len(at)), np.flatnonzero(apart) + 1):
                    if len(rows):
                        own = at[rows]
                        record = [t, int(node[rows[0]]), int(part[own[0]])]
                        rest = [threes[own].tobytes(), other[own].tobytes()]
                        records.append([*record, int(block[own[0]]), *rest] if scored else [*record, *rest, times[t, own].tobytes()])
            yield pd.DataFrame(records, columns=["tree", "node", "part", *names])

    return deal, "tree int, node int, part int, " + ", ".join(f"{n} {'long' if n == 'block' else 'binary'}" for n in names)


def fit_forest(prepared: DataFrame, weights: list[float], trees: int = 100, depth: int = 30, seed: int = 42) -> GrownForest:
    """A forest over ``__features`` and ``__label`` (0, 1, ...) whose classes weigh ``weights``."""
    spark = prepared.sparkSession
    ship_package(spark)
    borders = bin_borders(prepared)
    features = len(borders)
    numbered = prepared.select("__features", F.col("__label").cast("int").alias("__label"), F.monotonically_increasing_id().alias("__unit"))
    rows = stage(binned(numbered, borders, ["__label", "__unit"], trees, seed))
    tops = _upper_trees(rows, trees, features, weights, depth, seed)
    share = np.asarray(weights)

    def grow_below(group: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
        label, times = (np.frombuffer(b"".join(group[c]), np.uint8).astype(np.int64) for c in ("__label", "__times"))
        left = depth - tops[tree]["level"][node]
        grown = grow(unsqueezed(group["__bins"], features), label, times, share, left, (seed, tree, node))
        return pd.DataFrame([packed(tree, node, grown)])

    deal, dealt = _deal(tops, features, trees, scored=False)
    sent = rows.mapInPandas(deal, dealt).repartition(max(TASKS_PER_TREE * trees, partitions_of(spark)), "tree", "node")
    lower = sent.groupBy("tree", "node").applyInPandas(grow_below, LOWER)
    closed = [(t, n, counts) for t, top in enumerate(tops) for n, counts in top["final"].items()]
    if closed:
        leaves = []
        for t, n, counts in closed:
            single = {"feature": np.array([LEAF]), "bin": np.zeros(1, np.uint8), "below": np.zeros(1), "importance": np.zeros(features)}
            leaves.append(packed(t, n, single | {"shares": (np.array(counts) * share / (counts @ share))[None]}))
        lower = lower.unionByName(spark.createDataFrame(pd.DataFrame(leaves), LOWER))
    return GrownForest(tops, borders, len(weights), stage(lower))


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class GrownForest:
    """The upper nodes of all trees, the bins' borders, and the stored table of lower trees."""

    tops: list[dict]
    borders: list[list[float]]
    classes: int
    lower: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` (the first of the likeliest classes) and ``__shares``, an array of probabilities.

        ``df`` is stored, as its rows are numbered.
        """
        spark, classes = df.sparkSession, self.classes
        ship_package(spark)
        rows = stage(df.withColumn("__unit", F.monotonically_increasing_id()))
        parts = -(-rows.count() // SCORED_PER_TASK) or 1
        names, features = [f"s{k}" for k in range(classes)], len(self.borders)

        def vote(sent: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            """Per record the class of the leaf that each row comes to, and the shares of those that hold several."""
            if sent.empty:
                return pd.DataFrame(columns=["block", "place", "class", "shares"])
            found = unpacked(next(tree.itertuples(index=False)))
            leaf = found["below"][descend(found, unsqueezed(sent["__bins"], features))]
            shares = np.rint(found["shares"].reshape(-1, classes) / UNIT).astype("<i8")
            # As ``packed`` has it, the first shares are those of a single class each.
            single = np.where(leaf < classes, leaf, SEVERAL).astype(np.uint8)
            ends = np.cumsum([len(places) // 2 for places in sent["__place"]])[:-1]
            mixed = [shares[own[code == SEVERAL]].tobytes() for own, code in zip(np.split(leaf, ends), np.split(single, ends))]
            codes = [code.tobytes() for code in np.split(single, ends)]
            return pd.DataFrame({"block": sent["block"], "place": sent["__place"], "class": codes, "shares": mixed})

        def add_up(votes: pd.DataFrame) -> pd.DataFrame:
            sums = np.zeros((SCORED_BLOCK, classes), np.int64)
            seen = np.zeros(SCORED_BLOCK, bool)
            for places, codes, shares in zip(votes["place"], votes["class"], votes["shares"]):
                # A record holds a row once.
                place, code = np.frombuffer(places, "<u2"), np.frombuffer(codes, np.uint8)
                seen[place] = True
                single = code != SEVERAL
                sums[place[single], code[single]] += round(1 / UNIT)
                sums[place[~single]] += np.frombuffer(shares, "<i8").reshape(-1, classes)
            unit = int(votes["block"].iloc[0]) * SCORED_BLOCK + np.flatnonzero(seen)
            return pd.DataFrame({"__unit": unit} | {n: sums[seen, k] for k, n in enumerate(names)})

        deal, dealt = _deal(self.tops, features, len(self.tops), scored=True)
        # Numbers of rows follow each other within a partition, so blocks of them are full but for the last ones.
        place = F.pmod("__unit", F.lit(SCORED_BLOCK))
        block = ((F.col("__unit") - place) / SCORED_BLOCK).cast("long")
        placed = binned(rows, self.borders, ["__unit"]).withColumns({
            "__block": block, "__place": place, "__part": F.pmod(F.xxhash64(block), F.lit(parts)),
        })
        keys = ["tree", "node", "part"]
        number = max(TASKS_PER_TREE * len(self.tops), partitions_of(spark))
        sent = placed.mapInPandas(deal, dealt).repartition(number, *keys)
        trees = self.lower.drop("importance").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        votes = sent.groupBy(*keys).cogroup(trees.repartition(number, *keys).groupBy(*keys)).applyInPandas(
            vote, "block long, place binary, class binary, shares binary"
        )
        summed = votes.groupBy("block").applyInPandas(add_up, ", ".join(f"{n} long" for n in ("__unit", *names)))
        total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        shares = summed.select("__unit", F.array(*[F.col(n) / total for n in names]).alias("__shares"))
        first = (F.array_position("__shares", F.array_max("__shares")) - 1).cast("double")
        return rows.join(shares, "__unit").drop("__unit").withColumn("prediction", first)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - MLlib's name
        """The mean over trees of each feature's part of the tree's gain."""
        gains = np.array([top["importance"] for top in self.tops])
        below = self.lower.select("tree", F.posexplode("importance").alias("i", "v")).groupBy("tree", "i").agg(F.sum("v").alias("v"))
        for r in below.collect():
            gains[r["tree"], r["i"]] += r["v"]
        whole = gains.sum(1, keepdims=True)
        each = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(0)
        return Vectors.dense(each / each.sum() if each.sum() else each)

    def save(self, path: str) -> None:
        spark = self.lower.sparkSession
        kept = json.dumps({"tops": self.tops, "borders": self.borders, "classes": self.classes})
        spark.createDataFrame([(kept,)], "value string").write.mode("overwrite").text(f"{path}/upper")
        self.lower.write.mode("overwrite").parquet(f"{path}/lower")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GrownForest:
        kept = json.loads(spark.read.text(f"{path}/upper").first()["value"])
        for top in kept["tops"]:
            top["final"] = {int(n): counts for n, counts in top["final"].items()}
        return cls(**kept, lower=spark.read.parquet(f"{path}/lower"))
