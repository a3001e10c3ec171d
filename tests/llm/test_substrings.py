from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from biospark.llm import sketch, substrings
from tests.llm.conftest import prose, table


def brute(rows, need):
    """(doc_id, n_words, n_removed, kept) by the first place of every window."""
    least = {}
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for doc, words in split:
        for i in range(len(words) - need + 1):
            key = tuple(words[i : i + need])
            if doc is not None:
                least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - need + 1):
            if doc is not None and least[tuple(words[i : i + need])] < doc:
                gone |= set(range(i, i + need))
        out.append((doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=str)


def check(df, rows, need):
    got = substrings.remove_repeats(df, min_words=need)
    expected = brute(rows, need)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    short = substrings.remove_repeats(df, min_words=need, digest=True).collect()
    hashed = [(*e[:3], hashlib.sha256(e[3].encode()).hexdigest()) for e in expected]
    assert sorted((tuple(r) for r in short), key=str) == sorted(hashed, key=str)
    return sum(e[2] for e in expected)


@pytest.mark.parametrize("need", [1, 2, 5, 12])
def test_against_brute_force(spark, need):
    rng = random.Random(need)
    passages = [prose(i, rng.randint(4, 80), rng.randint(2, 20)) for i in range(10)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(passages).split() if rng.random() < 0.6 else prose(rng.random(), 30).split()
            a = rng.randrange(len(words))
            parts.append(rng.choice([" ", "\n", " \t"]).join(words[a:]))
        rows.append((rng.randrange(70), " ".join(parts)))
    rows += rows[:9]
    assert check(table(spark, rows), rows, need) > 500


def test_passages_copies_and_near_copies(spark):
    passage, base = prose(1, 60), prose(2, 300)
    near = base.split()
    near[150] = "other"
    rows = [(9, base), (3, " ".join(near)), (5, base), (7, base + "\n" + passage), (2, passage), (1, prose(3, 49)), (8, prose(3, 49))]
    check(table(spark, rows), rows, 50)


def test_copies_of_a_text_whose_windows_an_earlier_one_has(spark):
    text = prose(4, 90)
    rows = [(4, text), (6, text), (2, prose(5, 20) + " " + text + " " + prose(6, 20)), (7, prose(5, 10) + text)]
    check(table(spark, rows), rows, 50)


def test_odd_rows(odd, odd_rows, nothing):
    for need in (5, 50):
        check(odd, odd_rows, need)
    assert substrings.remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(nothing, min_words=0)


def test_one_word_over_and_over(spark):
    rows = [(1, "la " * 500), (2, "la " * 700 + "end"), (3, "la " * 49), (4, "a b " * 300), (5, "b a " * 300)]
    check(table(spark, rows), rows, 50)


def test_hot_passage_and_hot_text(spark):
    passage, text = prose(1, 70), prose(2, 120)
    rows = [(i, text if i % 3 == 0 else f"{prose(i, 30)} {passage}" if i % 3 == 1 else prose(i, 60)) for i in range(400)]
    assert check(table(spark, rows), rows, 50) > 10_000


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    """With far too few counters nearly all windows pass the first step; the result is the same."""
    monkeypatch.setattr(substrings, "BYTES_PER_CELL", 1 << 30)
    monkeypatch.setattr(substrings, "LEAST_BITS", 2)
    passage = prose(1, 70)
    rows = [(i, f"{prose(i, 200)} {passage if i % 2 else ''} {prose(i + 1000, 50)}") for i in range(40)]
    check(table(spark, rows), rows, 50)


def test_stretches_of_long_texts(monkeypatch):
    """Keys and windows do not depend on where a text is cut for hashing."""
    text = prose(1, 5000)
    whole = substrings._Text(text, 50)
    table_of_all, shape = np.full(1 << 13, 255, np.uint8), sketch.Shape(1, 16, 2)
    every = whole.candidates(table_of_all, shape, 50)
    monkeypatch.setattr("biospark.llm.words.word_chunks.__defaults__", (700,))
    parts = substrings._Text(text, 50)
    assert len(whole.runs) == 1 and len(parts.runs) > 10 and parts.n_words == whole.n_words and parts.whole == whole.whole
    assert (parts.keys() == whole.keys()).all() and parts.candidates(table_of_all, shape, 50) == every
    assert sum(map(len, every.values())) == len(text.split()) - 49


def test_sketch_estimates_are_never_too_low(spark):
    rng = np.random.default_rng(1)
    shape = sketch.Shape(2, 16, 3)
    keys = sketch.mixed(rng.integers(0, 3000, 200_000).astype(np.uint64) ** 2)
    parts = []
    for part in np.array_split(keys, 150):
        counts = np.bincount(np.concatenate(list(shape.cells(part))), minlength=2 << 16)
        cells = np.flatnonzero(counts)
        parts.append(sketch.parts(cells, np.minimum(counts[cells], 3)))
    import pandas as pd

    df = spark.createDataFrame(pd.concat(parts), sketch.PART).repartition(150)
    bits = sketch.reached(df, shape).value
    values, counts = np.unique(keys, return_counts=True)
    assert sketch.passes(bits, shape, values[counts >= 3]).all()
    others = sketch.mixed(np.arange(10**7, 10**7 + 5000, dtype=np.uint64))
    assert sketch.passes(bits, shape, others).mean() < 0.02
