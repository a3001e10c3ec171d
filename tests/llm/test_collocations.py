from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from biospark.llm import collocations
from tests.llm.conftest import prose, table


def brute(rows, least, top=2000, longest=5):
    counts = defaultdict(Counter)
    for lang, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, seen in counts.items():
        n = sum(v for k, v in seen.items() if len(k) == 1)
        frequent = {k: v for k, v in seen.items() if len(k) > 1 and v >= least}
        inside = {k[i : i + m] for k, v in frequent.items() for m in range(2, len(k)) for i in range(len(k) - m + 1) if v >= seen[k[i : i + m]]}
        rows = []
        for k, a in frequent.items():
            if k not in inside:
                cuts = [(1000 * a * n // (seen[k[:q]] * seen[k[q:]]), q) for q in range(1, len(k))]
                score, q = min(cuts)
                rows.append((-score, -a, " ".join(k).encode(), seen[k[:q]], seen[k[q:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def check(df, rows, **options):
    got = sorted(tuple(r) for r in collocations.collocations(df, **options).collect())
    assert got == brute(rows, options.get("least", 100), options.get("top", 2000), options.get("longest", 5))
    return got


@pytest.mark.parametrize("modulus", [1, 3, 64])
def test_against_brute_force(spark, modulus):
    rng = random.Random(modulus)
    passages = [prose(i, rng.randint(3, 60), rng.randint(1, 20)) for i in range(8)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.6 else prose(rng.random(), 30, 7) for _ in range(rng.randint(0, 4))]
        rows.append((i, rng.choice([" ", "\n", ", ", "\t"]).join(parts), rng.choice(["en", "de", None])))
    assert len(check(table(spark, rows), [(r[2], r[1]) for r in rows], least=4, modulus=modulus)) > 100


def test_every_phrase_is_counted_once(spark):
    """Overlaps, repeats of one word and texts of a few words."""
    texts = ["a", "a b", "a b c", "a b c d", "a b c d e", "x " * 300, ". ".join(["p q r s t u v w"] * 40), "A,b;C:d!E?f\ng\x0bh", "", None]
    rows = [(i, t, "en") for i, t in enumerate(texts * 2)]
    for modulus in (1, 2, 64):
        check(table(spark, rows), [(r[2], r[1]) for r in rows], least=2, modulus=modulus)


def test_parts_overlap_and_follow_content():
    text = prose(1, 400, 9)
    words = b"\n".join(collocations.pieces(text)).split()
    _, parts, lasts = collocations.parse([text], modulus=8)
    assert len(parts) > 10 and lasts == [False] * (len(parts) - 1) + [True]
    joined = [w for p, last in zip(parts, lasts) for w in (p.split() if last else p.split()[:-4])]
    assert joined == words
    assert all(p.split()[-4:] == q.split()[:4] for p, q in zip(parts, parts[1:]))
    # A passage falls into the same parts whatever stands before it, but for its ends.
    _, moved, _ = collocations.parse([prose(2, 57, 5) + "\n" + text], modulus=8)
    assert set(parts[1:]) <= set(moved)


def test_odd_rows(odd, odd_rows, nothing):
    rows = [(r[2], r[1]) for r in odd_rows]
    check(odd, rows, least=2)
    check(odd, rows, least=2, top=5)
    assert collocations.collocations(nothing).count() == 0


def test_one_language_and_one_passage_hold_most(spark):
    hot = prose(3, 25, 25)
    rows = [(i, hot if i % 3 else prose(i, 40), "en" if i % 9 else "de") for i in range(400)]
    check(table(spark, rows), [(r[2], r[1]) for r in rows], top=7)


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    wide = spark.range(1).select(F.lit(10**12).alias("a"), F.lit(10**13).alias("n"), F.lit(3 * 10**12).alias("l"), F.lit(7).alias("r"))
    names = {f"w_{c}": F.col(c).cast("decimal(18,0)") for c in "anlr"}
    got = wide.withColumns(names).select(F.expr("(cast(1000 * w_a as decimal(19,0)) * w_n) div (w_l * w_r)")).first()[0]
    assert got == 1000 * 10**12 * 10**13 // (3 * 10**12 * 7)


def test_options(nothing):
    with pytest.raises(ValueError):
        collocations.collocations(nothing, least=1000)
