from __future__ import annotations

import re
from collections import Counter

from biospark.llm import quality
from tests.llm.conftest import prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(odd, odd_rows):
    got = quality.quality_rules(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((r[0], *base_counts(r[1]))) for r in odd_rows)


def test_overlapping_windows(spark):
    texts = ["a " * 7, "a b c d e f a b c d e", "a b c d e x a b c d e y a b c d e"]
    got = quality.quality_rules(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r["n_repeat_words"] for r in got] == [base_counts(t)[4] for t in texts] == [7, 10, 15]


def verdicts(spark, texts):
    rows = quality.quality_rules(table(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    return [(r["base_failed"], r["kept"], r["clean_text"]) for r in rows]


def test_line_rules(spark):
    good = prose(1, 60)
    junk = "Home | About | Contact | Login"
    got = verdicts(
        spark,
        [good, good + "\n" + junk, "\n".join([junk] * 1 + [prose(2, 3)] * 1), good + "\nAll rights reserved.", good + "\nHome Login",
         "WORD!! OTHER!! THIRD!! " * 6 + "END!!", "one### two%%% three*** four&&& five six seven eight nine ten.", good + "\nno end here"],
    )
    assert [g[:2] for g in got[:2]] == [(False, True)] * 2
    assert got[0][2] == got[1][2] == got[3][2] == got[4][2] == got[7][2] == good
    assert [g[1] for g in got] == [True, True, False, True, True, False, False, True]


def test_long_line_without_end_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    assert verdicts(spark, [text])[0] == (False, True, text)


def test_empty_table(nothing):
    assert quality.quality_rules(nothing).count() == 0
