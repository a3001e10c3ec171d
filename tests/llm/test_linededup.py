from __future__ import annotations

import random
from collections import Counter

import pytest

from biospark.llm import linededup
from tests.llm.conftest import prose, table


def brute_runs(texts, need):
    """(document, line) of every later place of a run of ``need`` words that stands at an earlier place, by all runs."""
    runs, gone = {}, set()
    for n, text in enumerate(texts):
        own = [(i, x, len(x.split())) for i, x in enumerate(text.split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
        for s in range(len(own)):
            words = 0
            for e in range(s, len(own)):
                words += own[e][2]
                if words >= need:
                    earlier = runs.setdefault(tuple(x for _, x, _ in own[s : e + 1]), (n, s))
                    gone |= {(n, i) for i, _, _ in own[s : e + 1]} if earlier != (n, s) else set()
    return gone


def brute(rows, need):
    """Deleted lines per (doc_id, text)."""
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    deleted = {d: set() for d in docs}
    for n, line in brute_runs([t for _, t in docs], need):
        deleted[docs[n]].add(line)
    return deleted


def check(spark, rows, need):
    got = linededup.deduplicate_lines(table(spark, rows), min_words=need).collect()
    deleted = brute(rows, need)
    expected = []
    for r in rows:
        text = r[1] or ""
        gone = deleted[(r[0], text)]
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        expected.append((r[0], kept, len(text.split("\n")), len(gone)))
    assert sorted(map(str, (tuple(g) for g in got))) == sorted(map(str, expected))
    return sum(e[3] for e in expected)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [prose(100 + i, rng.randint(4, 40), 5).split("\n") for i in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            cut = rng.choice(passages)
            a = rng.randrange(len(cut))
            parts += cut[a : a + rng.randint(1, 6)] if rng.random() < 0.7 else prose(rng.random(), 12, 4).split("\n")
            if rng.random() < 0.2:
                parts.append("  ")
        rows.append((i, "\n".join(parts)))
    assert check(spark, rows, 10) > 50


def test_passages_of_fifty_words(spark):
    passage, short = prose(1, 60, 60), prose(2, 49, 49)
    rows = [(i, f"{prose(10 + i, 30)}\n{passage}\n{short}\n{prose(50 + i, 30)}") for i in range(5)]
    rows.append((9, f"{short}\nother"))
    got = {r["doc_id"]: r["clean_text"] for r in linededup.deduplicate_lines(table(spark, rows)).collect()}
    assert passage in got[0] and all(passage not in got[i] for i in range(1, 5))
    # The short line goes where it follows the passage, and stays on its own.
    assert all(short not in got[i] for i in range(1, 5)) and short in got[9]


def test_hot_passage(spark):
    hot = prose(3, 80)
    rows = [(i, f"{hot}\n{prose(i, 20)}" if i % 3 else prose(i, 70)) for i in range(300)]
    assert check(spark, rows, 50) > 0


def test_odd_rows(spark, odd_rows):
    # Rows that repeat an identifier with other texts have an order of their own.
    rows = [r for r in odd_rows if r[0] != 8]
    check(spark, rows, 50)


def test_clashing_columns_and_empty_table(odd, odd_rows, nothing):
    assert linededup.deduplicate_lines(odd).count() == len(odd_rows)
    assert linededup.deduplicate_lines(nothing).count() == 0


def test_every_shared_run_keeps_a_mark(spark):
    from pyspark.sql import functions as F

    passage = prose(5, 80, 7)
    rows = [(1, f"{prose(6, 25)}\n{passage}"), (2, f"{passage}\n{prose(7, 25)}")]
    docs = table(spark, rows).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    marks = Counter(r["mark"] for r in linededup._windows(linededup._lines(docs), 50).select("id", "mark").distinct().collect())
    assert max(marks.values()) == 2


def deleted_lines(spark, texts, need):
    from pyspark.sql import functions as F

    docs = table(spark, list(enumerate(texts))).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    return {(r["id"], at) for r in linededup.repeated_lines(docs, need).collect() for at in r["deleted"]}


@pytest.mark.parametrize("seed", range(3))
def test_against_all_runs_at_any_earlier_place(spark, seed):
    rng = random.Random(seed)
    passages = [prose(200 + i, rng.randint(8, 60), rng.randint(2, 15)).split("\n") for i in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            cut = rng.choice(passages)
            a = rng.randrange(len(cut))
            parts += cut[a : a + rng.randint(1, 6)] if rng.random() < 0.8 else prose(rng.random(), 12, 4).split("\n")
            if rng.random() < 0.2:
                parts.append("  ")
        texts.append("\n".join(parts))
    expected = brute_runs(texts, 10)
    assert deleted_lines(spark, texts, 10) == expected and len(expected) > 100


def test_the_earliest_place_may_end_before_the_run(spark):
    a, c = prose(1, 50), prose(2, 20, 10)
    texts = [f"{a}\n{prose(3, 30)}"] + [f"{a}\n{c}\n{prose(10 + i, 30)}" for i in range(5)]
    n = a.count("\n") + 1
    whole = {(i, at) for i in range(2, 6) for at in range(n + 2)} | {(1, at) for at in range(n)}
    assert deleted_lines(spark, texts, 50) == whole == brute_runs(texts, 50)


def test_short_line_after_a_very_long_one(spark):
    text = "\n".join([prose(1, 9, 9), prose(2, 160, 160), prose(3, 4, 4)])
    assert deleted_lines(spark, [text + "\n\nsome", text], 50) == {(1, 0), (1, 1), (1, 2)}
