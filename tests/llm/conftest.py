from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, line: int = 12) -> str:
    """Sentences of ``line`` invented words, one per line."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    chosen = [rng.choice(vocabulary) for _ in range(words)]
    lines = [" ".join(chosen[i : i + line]).capitalize() + "." for i in range(0, words, line)]
    return "\n".join(lines)


def table(spark, rows):
    """Rows (doc_id, text[, lang, source]) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and white texts, a very long text, ties, repeated rows."""
    return [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a"),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n\r ", "de", "b"),
        (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", None),
        (5, prose(5, 30_000), "en", "b"),
        (6, "x" * 70_000, "en", "b"),
        (7, "Ünïcödé \U0001f600   words here \x1c end's 12 3!!", "fr", "a"),
        (8, prose(8, 40), "en", "a"),
        (8, prose(9, 40), "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names are used inside the operators."""
    from pyspark.sql import functions as F

    df = table(spark, odd_rows)
    for name in ("id", "key", "rid", "size", "kept", "score", "ids", "text_sha256", "words", "component_id", "slot", "fp"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
