from __future__ import annotations

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from biospark.llm import bpe
from tests.llm.conftest import prose

CODER = bpe.encoding(bpe.RANKS, public_tokenizers.PATTERN)
TRICKY = st.text(alphabet="ab1'sét \n\t\r\x1c\x85\xa0 #😀中", max_size=60)


@given(TRICKY, st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_parts_encode_like_the_whole(text, size):
    parts = list(bpe.parts_of(text, size))
    assert "".join(parts) == text
    assert [t for p in parts for t in CODER.encode_ordinary(p)] == CODER.encode_ordinary(text)


def test_long_text_is_cut(monkeypatch):
    text = prose(1, 20_000)
    assert len(list(bpe.parts_of(text, 1000))) > 50
    monkeypatch.setattr(bpe, "PART_CHARS", 1000)
    assert bpe.encode_text(CODER, text) == np.array(CODER.encode_ordinary(text), "<u4").tobytes()


def test_odd_rows(odd, odd_rows):
    got = sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.round_trip(odd).collect()), key=str)
    expected = []
    for r in odd_rows:
        ids = CODER.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), np.array(ids, "<u4").tobytes(), (r[1] or "").encode()))
    assert got == sorted(expected, key=str)


def test_tokens_that_are_not_whole_characters(spark):
    from pyspark.sql import functions as F

    ids = CODER.encode_ordinary("😀")
    half = np.array(ids[:1], "<u4").tobytes()
    df = spark.createDataFrame([(half,), (None,)], "ids binary").select(bpe.decoded(F.col("ids")).alias("d"))
    got = [r["d"] for r in df.collect()]
    assert got[0] is not None and "😀".encode().startswith(bytes(got[0])) and got[1] is None


def test_empty_table(nothing):
    assert bpe.round_trip(nothing).count() == 0
