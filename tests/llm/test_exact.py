from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from biospark.llm import exact
from tests.llm.conftest import table


def brute(rows, keep=max):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        left = [best]
        for i in ids:
            kept = i in left
            if kept:
                left.remove(i)
            out.append((i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_odd_rows(odd, odd_rows):
    assert found(exact.duplicate_groups(odd)) == brute(odd_rows)


def test_smallest_stays(odd, odd_rows):
    assert found(exact.duplicate_groups(odd, keep="smallest")) == brute(odd_rows, min)


def test_hot_group_is_split_and_whole(spark):
    rows = [(i, "the same text" if i % 2 else f"text {i}") for i in range(2000)]
    df = exact.duplicate_groups(table(spark, rows))
    assert found(df) == brute(rows)


def test_rows_that_stay_have_all_columns(odd, odd_rows):
    kept = exact.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r[1] or "" for r in odd_rows})


def test_normalisation(spark):
    from pyspark.sql import functions as F

    df = exact.duplicate_groups(table(spark, [(1, "A b"), (2, "a B")]), normalise=F.lower)
    assert {(r["keep_id"], r["group_size"]) for r in df.collect()} == {(2, 2)}


def test_empty_table(nothing):
    assert exact.duplicate_groups(nothing).count() == 0
    assert exact.drop_duplicates(nothing).columns == nothing.columns


def test_unknown_rule(nothing):
    with pytest.raises(ValueError):
        exact.duplicate_groups(nothing, keep="any")
