from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from biospark.operators.align import GridOptions, align_to_1hz, align_to_grid, duplicate_subjects
from tests.conftest import samples, seconds


def collect(df, *columns):
    return [tuple(seconds(r.timestamp) if c == "timestamp" else r[c] for c in columns) for r in df.orderBy("timestamp").collect()]


def test_regular(spark):
    out = align_to_1hz(samples(spark, [("a", float(i), 70.0) for i in range(60)]))
    assert (out.count(), out.filter("hr is null").count()) == (60, 0)


def test_every_fifth_second(spark):
    out = align_to_1hz(samples(spark, [("a", 5.0 * i, 70.0 + i) for i in range(12)]))
    assert (out.count(), out.filter("hr is null").count()) == (56, 0)


def test_large_gap(spark):
    out = align_to_1hz(samples(spark, [("a", float(i), 70.0) for i in [*range(30), *range(120, 150)]]), max_gap="30s")
    assert (out.count(), out.filter("hr is null").count()) == (150, 90)


@pytest.mark.parametrize("chunk", [2, 3, 8192])
def test_edges(spark, chunk):
    rows = [("a", float(i), v) for i, v in enumerate([None, None, 1.0, None, 3.0, None])]
    out = align_to_grid(samples(spark, rows), GridOptions(chunk=chunk))
    assert [v for _, v in collect(out, "timestamp", "hr")] == [1, 1, 1, 2, 3, 3]


def test_off_grid_samples_drop_out(spark):
    out = align_to_1hz(samples(spark, [("a", 0.25, 1.0), ("a", 1.0, 9.0), ("a", 2.25, 3.0)]))
    assert collect(out, "timestamp", "hr") == [(0.25, 1.0), (1.25, 2.0), (2.25, 3.0)]


def test_grid_reaches_the_last_off_grid_sample(spark):
    out = align_to_1hz(samples(spark, [("a", 0.0, 1.0), ("a", 3.5, 9.0)]))
    assert collect(out, "timestamp", "hr") == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_one_series_without_subject(spark):
    table = samples(spark, [("a", 0.0, 1.0), ("b", 2.0, 3.0)]).drop("subject")
    assert collect(align_to_1hz(table), "timestamp", "hr") == [(0, 1), (1, 2), (2, 3)]


def test_duplicates(spark):
    table = samples(spark, [("a", 0.0, 1.0), ("a", 0.0, 5.0), ("a", 1.0, 2.0), ("b", 0.0, 1.0), (None, 0.0, 1.0)])
    assert [r.subject for r in align_to_1hz(table).collect()] == ["b"]
    rejected = duplicate_subjects(table).collect()
    assert [(r.subject, r.duplicate_instants) for r in rejected] == [("a", 1)]
    first = align_to_1hz(table.filter("subject = 'a'"), on_duplicate="first", tie_breaker="hr")
    assert collect(first, "timestamp", "hr") == [(0, 1), (1, 2)]
    with pytest.raises(Exception, match="duplicate timestamp in a"):
        align_to_1hz(table, on_duplicate="error").collect()


def test_bad_options(spark):
    table = samples(spark, [("a", 0.0, 1.0)])
    for bad in ({"method": "cubic"}, {"on_duplicate": "x"}, {"grid": "x"}, {"on_duplicate": "first"}):
        with pytest.raises(ValueError):
            GridOptions(**bad)
    with pytest.raises(ValueError, match="Timestamp column"):
        align_to_1hz(table.drop("timestamp"))


def fill(values, method, limit):
    """Plain rendering of the fill rules on one dense series."""
    known = [i for i, v in enumerate(values) if v is not None]
    out = []
    for i, v in enumerate(values):
        left = max((k for k in known if k < i), default=None)
        right = min((k for k in known if k > i), default=None)
        run = (len(values) if right is None else right) - (-1 if left is None else left) - 1
        if v is not None or (limit is not None and run > limit):
            out.append(v)
        elif method == "forward":
            out.append(None if left is None else values[left])
        elif method == "backward":
            out.append(None if right is None else values[right])
        elif left is None or right is None:
            edge = right if left is None else left
            out.append(None if edge is None else values[edge])
        else:
            out.append(values[left] + (values[right] - values[left]) * (i - left) / (right - left))
    return out


@pytest.mark.parametrize("method", ["linear", "forward", "backward"])
@pytest.mark.parametrize("limit, chunk", [(3, 7), (3, 16), (9, 40), (None, 7), (20, 8), (5, 8192)])
def test_against_plain_rendering(spark, method, limit, chunk):
    rng = random.Random(7)
    rows, expected = [], {}
    for subject in "abcdef":
        start = rng.randrange(0, 50) + rng.choice([0.0, 0.5])
        length = rng.randrange(1, 120)
        values, labels = [None] * length, [None] * length
        present = sorted({0, length - 1, *(rng.randrange(length) for _ in range(length // 3))})
        for i in present:
            values[i] = None if rng.random() < 0.2 else round(rng.uniform(0, 100), 3)
            labels[i] = None if rng.random() < 0.5 else rng.choice("xyz")
            rows.append((subject, start + i, values[i], labels[i]))
            if rng.random() < 0.2 and i != length - 1:
                rows.append((subject, start + i + 0.25, 999.0, "off"))
        filled, text = fill(values, method, limit), None
        for i in range(length):
            text = labels[i] or text
            expected[subject, start + i] = (filled[i], text)
    table = samples(spark, rows, "subject string, seconds double, hr double, label string")
    gap = None if limit is None else f"{limit}s"
    out = align_to_grid(table, GridOptions(method=method, max_gap=gap, chunk=chunk)).collect()
    got = {(r.subject, seconds(r.timestamp)): (r.hr, r.label) for r in out}
    assert len(out) == len(expected) and got.keys() == expected.keys()
    for key, (value, text) in expected.items():
        assert got[key][1] == text, key
        assert (got[key][0] is None) == (value is None), key
        assert value is None or math.isclose(got[key][0], value, rel_tol=1e-12, abs_tol=1e-12), key


def test_aligning_twice_changes_nothing(spark):
    table = samples(spark, [("a", float(i), float(i)) for i in (0, 1, 4, 30, 31)])
    once = align_to_1hz(table)
    assert sorted(map(tuple, align_to_1hz(once).collect())) == sorted(map(tuple, once.collect()))


def test_bucket_mean(spark):
    table = samples(spark, [("a", 0.1, 1.0), ("a", 0.9, 3.0), ("a", 2.5, 4.0)])
    out = align_to_1hz(table, grid="bucket_mean")
    assert collect(out, "timestamp", "hr") == [(0, 2), (1, 3), (2, 4)]


def test_other_types_stay_at_their_sample(spark):
    table = samples(spark, [("a", 0.0, 1.0), ("a", 2.0, 3.0)]).withColumn("worn", F.lit(True))
    assert collect(align_to_1hz(table), "worn") == [(True,), (None,), (True,)]


def test_both_ways_across_chunk_borders_agree(spark):
    """A gap limit up to a quarter of a chunk copies samples over its border, a longer one carries values."""
    times = [i for i in range(0, 400) if i % 37 < 5]
    table = samples(spark, [("f1", float(i), 50.0 + i % 11) for i in times])
    for gap in ("10s", "11s", "30s", "32s"):
        small = align_to_grid(table, GridOptions(max_gap=gap, chunk=40)).collect()
        large = align_to_grid(table, GridOptions(max_gap=gap)).collect()
        assert sorted(map(str, small)) == sorted(map(str, large))
