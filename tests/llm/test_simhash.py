from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from biospark.llm import components, simhash
from tests.llm.conftest import prose, table

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, reach):
    points = np.asarray(points, np.uint64)
    label = np.arange(len(points))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= reach
    while True:
        new = np.where(near, label[None, :], len(points)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def joined(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return [root(i) for i in range(n)]


def clusters(seed, centres, copies, flips):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 1 << 63, centres, dtype=np.uint64) * np.uint64(2)
    out = [points]
    for _ in range(copies):
        moved = points.copy()
        for _ in range(rng.integers(1, flips + 1)):
            moved ^= np.uint64(1) << rng.integers(0, 64, centres).astype(np.uint64)
        out.append(moved)
        points = np.where(rng.random(centres) < 0.5, moved, points)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("reach", [0, 1, 2, 3])
def test_shard_links_join_what_brute_force_joins(reach):
    points = clusters(reach, 500, 4, 3)
    a, b = simhash.shard_links(points, reach)
    place = {int(p): i for i, p in enumerate(points)}
    got = joined(len(points), [(place[int(x)], place[int(y)]) for x, y in zip(a, b)])
    assert got == brute_components(points, reach).tolist()


def test_dense_cluster_that_no_split_helps():
    centre = 0x0F0F_3333_5555_1234
    points = np.unique(np.array([centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)], np.uint64))
    a, b = simhash.shard_links(points, 2)
    place = {int(p): i for i, p in enumerate(points)}
    assert len(a) < 4 * len(points)
    assert set(joined(len(points), [(place[int(x)], place[int(y)]) for x, y in zip(a, b)])) == {0}


def test_tree_sends_linked_points_to_a_common_shard():
    points = clusters(7, 800, 3, 2)
    tree = simhash.Tree.fit(points[::3], 20, 2)
    shards = [set() for _ in points]
    for shard, at in tree.route(points):
        for i in at:
            shards[i].add(shard)
    assert len(set().union(*shards)) > 5 and all(shards)
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    assert all(shards[x] & shards[y] for x, y in zip(i, j))


def test_fingerprints(odd_rows):
    short = [r[1] for r in odd_rows if len(r[1] or "") < 2000] + ["one", "One TWO", "a b c", "É é"]
    assert [simhash.fingerprint(t) % (1 << 64) for t in short] == [brute_fingerprint(t) for t in short]


def test_long_text_in_chunks(monkeypatch):
    from biospark.llm import words

    text = prose(3, 5000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "word_chunks", lambda data: words.word_chunks(data, 100))
    assert simhash.fingerprint(text) == whole


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 10), (20, 20), (7, 9), (8, 9)] + [(100, i) for i in range(101, 160)]
    links += [(i, i + 1) for i in range(1000, 1064)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {n: 1 for n in range(1, 6)} | {10: 10, 11: 10, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 160)}
    assert got == expected | {i: 1000 for i in range(1000, 1065)}


def test_groups_against_brute_force(spark, odd, odd_rows):
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=str)
    prints = [simhash.fingerprint(r[1]) % (1 << 64) for r in odd_rows]
    label = brute_components(prints, 2)
    least = {}
    for i, r in enumerate(odd_rows):
        if r[0] is not None:
            least[label[i]] = min(least.get(label[i], r[0]), r[0])
    assert got == sorted(((r[0], least.get(label[i])) for i, r in enumerate(odd_rows)), key=str)


def test_near_copies_meet_and_one_stays(spark):
    text = prose(1, 3000)
    rows = [(3, text), (1, text + " more"), (2, prose(2, 300)), (9, text), (4, None)]
    docs = table(spark, rows)
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert near == {1: 1, 3: 1, 9: 1, 2: 2, 4: 4}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).count() == 0


def test_sample_is_a_small_part_of_a_middle_table(spark, monkeypatch):
    sizes, fit = [], simhash.Tree.fit
    monkeypatch.setattr(simhash.Tree, "fit", lambda sample, *a: sizes.append(len(sample)) or fit(sample, *a))
    points = clusters(3, 8000, 4, 2)
    classes = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(4)
    links = simhash.near_links(classes, 2).collect()
    assert 0 < sizes[0] < len(points) / 64
    place = {int(p): i for i, p in enumerate(points.view(np.int64))}
    got = joined(len(points), [(place[r["a"]], place[r["b"]]) for r in links])
    a, b = simhash.shard_links(points, 2)
    whole = joined(len(points), [(place[int(x)], place[int(y)]) for x, y in zip(a.view(np.int64), b.view(np.int64))])
    assert got == whole


def test_one_row_of_a_group_stays(spark):
    """Also where identifiers repeat with other texts, or are null."""
    a, b = prose(1, 200), prose(2, 200)

    def left(rows):
        return sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(table(spark, rows)).collect())

    near = a + " more"
    assert simhash.near_duplicates(table(spark, [(1, a), (2, near)])).select("component_id").distinct().count() == 1
    assert len(left([(5, a), (5, near)])) == 1
    assert left([(3, a), (5, b), (5, near)]) == [(False, 3, a), (False, 5, b)]
    assert len(left([(None, a), (None, near), (None, a), (None, b)])) == 2
    assert left([(None, a), (7, near), (7, near)]) == [(False, 7, near)]
    assert len(left([(1, ""), (1, None), (1, " "), (2, "")])) == 1


def test_rows_keep_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = table(spark, [(1, prose(1, 50)), (2, prose(1, 50))]).withColumn("__row", F.lit("x")).withColumn("row", F.lit("y"))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and [r["__row"] for r in kept.collect()] == ["x"]
