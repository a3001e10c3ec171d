from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from biospark.llm import conversations
from biospark.llm.words import WORD_CLASS

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
CODES = "".join(chr(97 + i) for i in range(16))


def exhaustive(codes):
    """All edits of a few rows, with up to two insertions at every place."""
    best = None
    for own in itertools.product("KRD", repeat=len(codes)):
        for extra in itertools.product(range(3), repeat=len(codes) + 1):
            letters = "".join("I" * n + c for n, c in zip(extra, own)) + "I" * extra[-1]
            cost = price(codes, letters)
            if cost is not None and (best is None or (cost, letters) < best):
                best = (cost, letters)
    return best


def price(codes, letters):
    """What edits cost; None if they are not allowed or leave other roles than they may."""
    cost, state, rows = 0, "", iter(codes)
    for letter in letters:
        if letter == "I":
            state, cost = "a" if state == "u" else "u", cost + 5
            continue
        number = ord(next(rows)) - 97
        initial, fault = "suax"[number % 4], number // 4
        if letter == "D":
            cost += 2
            continue
        if fault in (1, 2) or letter == "K" and (state, initial) not in STEP:
            return None
        state = initial if letter == "K" else "a" if state == "u" else "u"
        cost += (letter == "R") + 5 * (fault == 3)
    return cost if state in ("", "a") else None


def stepwise(codes):
    """The best prefix per state, row by row."""
    def inserted(best):
        for _ in range(3):
            for state, (cost, letters) in list(best.items()):
                put(best, "a" if state == "u" else "u", (cost + 5, letters + "I"))
        return best

    def put(best, state, prefix):
        if state not in best or prefix < best[state]:
            best[state] = prefix

    best = {"": (0, "")}
    for code in codes:
        number, after = ord(code) - 97, {}
        for state, (cost, letters) in inserted(best).items():
            put(after, state, (cost + 2, letters + "D"))
            if number // 4 not in (1, 2):
                extra, initial = 5 * (number // 4 == 3), "suax"[number % 4]
                if (state, initial) in STEP:
                    put(after, initial, (cost + extra, letters + "K"))
                put(after, "a" if state == "u" else "u", (cost + 1 + extra, letters + "R"))
        best = after
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def test_search_against_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        codes = "".join(rng.choice(CODES[:4] * 3 + CODES) for _ in range(rng.randint(0, 4)))
        assert conversations.edits(codes) == exhaustive(codes), codes


@pytest.mark.parametrize("letters", [CODES, "abc", "a", "b", "abcmno", "bcbcbcbca", "mn"])
def test_search_and_joined_pieces_against_steps(letters):
    rng = random.Random(letters)
    for size in [1, 2, 3, 5, 8, 13, 40, 150]:
        codes = "".join(rng.choice(letters) for _ in range(size))
        expected = stepwise(codes)
        assert conversations.edits(codes) == expected == conversations.edits(codes, piece=7) == conversations.edits(codes, piece=1)
        assert price(codes, expected[1]) == expected[0]


def test_search_stays_near_the_best_path():
    """The bounds and tables keep a conversation of many rows from being searched again and again."""
    import time

    for letters in ("a", "b", "bc", "abcd", CODES):
        rng = random.Random(letters)
        codes = "".join(rng.choice(letters) for _ in range(3000))
        start = time.perf_counter()
        conversations.edits(codes)
        assert time.perf_counter() - start < 20


def expected_rows(rows):
    """conv -> the report's values, for damaged rows (conv, turn, role, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append((r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    out = {}
    for conv, own in groups.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0))
        seen, codes, faults, illegal = set(), "", [], 0
        for i, (_, role, text) in enumerate(own):
            if not re.search(WORD_CLASS, text):
                fault = 1
            elif (role, text) in seen:
                fault = 2
            else:
                fault = 0 if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else 3
            seen.add((role, text))
            initial = "suax".index(role[:1] if role[:1] in ("s", "u", "a") else "x")
            codes += chr(97 + initial + 4 * fault)
            faults.append(fault)
            illegal += i > 0 and own[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        cost, letters = stepwise(codes)
        lines, rest, state = [], iter(own), ""
        for letter in letters:
            row = None if letter == "I" else next(rest)
            if letter == "D":
                continue
            role = row[1] if letter == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{row[2] if row else ''}")
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, letters, digest)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def reports(df):
    got = conversations.report(conversations.repair(df))
    return {r[0]: tuple(r[1:]) for r in got.collect()}


TEXTS = ["One two.", "Three?", "four", "", " \t", "Five! ", "six. seven", None, "Ünd so?\n"]


def talk(rng, conv, size):
    return [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(TEXTS)) for t in range(size)]


def test_against_plain_reports(spark):
    rng = random.Random(5)
    rows = [r for c in range(150) for r in talk(rng, c, rng.randint(1, 9))]
    rows += [(None, t, "user", f"{t}.") for t in range(4)]
    # Gaps, and turns that are null.
    rows = [r if rng.random() > 0.1 else (r[0], None if sum(q[0] == r[0] and q[1] is None for q in rows) else r[1] + 3, *r[2:]) for r in rows]
    rng.shuffle(rows)
    tied = {c for c in {r[0] for r in rows} if len({(r[1]) for r in rows if r[0] == c}) < sum(r[0] == c for r in rows)}
    got, expected = reports(frame(spark, rows)), expected_rows(rows)
    assert got.keys() == expected.keys()
    # Different rows of one turn are read in an order of their own.
    assert {k: v for k, v in got.items() if k not in tied} == {k: v for k, v in expected.items() if k not in tied}
    assert len(tied) < 100


def test_a_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 16)
    rng = random.Random(2)
    rows = talk(rng, 1, 700) + talk(rng, 2, 300) + [r for c in range(3, 40) for r in talk(rng, c, 3)]
    rows = [(c, t, r, x if rng.random() < 0.5 else f"{t}." if rng.random() < 0.8 else f"{t}") for c, t, r, x in rows]
    assert reports(frame(spark, rows).repartition(4)) == expected_rows(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (1, 2, "user", "Again."), (1, 3, "assistant", "cut")]
    got = conversations.repair(frame(spark, rows)).orderBy("pid", "at", "place").collect()
    assert [(r["edit"], r["fault"], r["role"], r["text"]) for r in got] == [
        ("D", "none", None, None), ("K", "none", "user", "Again."), ("D", "duplicate", None, None), ("K", "truncated", "assistant", "cut")
    ] or sum({"K": 0, "R": 1, "D": 2, "I": 5}[r["edit"]] + 5 * (r["fault"] == "truncated" and r["edit"] != "D") for r in got) == stepwise("bbjo")[0]


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        chance = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if chance == 0:
            continue
        text = "" if chance == 1 else re.sub("[.!?]", "", text) if chance == 2 else text
        out += [(c, t, "user" if chance == 4 else role, text)] * (2 if chance == 3 else 1)
    return out


def test_damage_and_lost_conversations(spark):
    rng = random.Random(8)
    rows = [r for c in [*range(120), None] for r in talk(rng, c, rng.randint(1, 6))]
    df = frame(spark, rows)
    assert sorted(map(tuple, conversations.damage(df).collect()), key=str) == sorted(damaged(rows), key=str)
    got = {r[0]: tuple(r[1:]) for r in conversations.repair_report(df, conversations.damage(df)).collect()}
    expected = expected_rows(damaged(rows))
    lost = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: expected.get(c, lost) for c in [*range(120), None]} and lost in got.values()


def test_odd_tables(spark):
    from pyspark.sql import functions as F

    assert reports(frame(spark, [])) == {}
    df = frame(spark, [])
    assert conversations.repair_report(df, conversations.damage(df)).count() == 0
    long = "word " * 100_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, None, None, None)]
    df = frame(spark, rows)
    for name in ("rid", "key", "hash", "code", "at", "pid", "edit", "place", "fault", "conv"):
        df = df.withColumn(name, F.lit("x"))
    assert reports(df) == expected_rows(rows)
