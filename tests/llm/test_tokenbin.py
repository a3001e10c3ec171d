from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from biospark.llm import tokenbin
from tests.llm.conftest import prose, table

TOKENS = st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 2**32 - 1)), min_size=1, max_size=300)
CODER = Tokenizer.from_file(tokenbin.VOCABULARY)


def direct(text):
    return np.array(CODER.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@given(TOKENS)
@settings(max_examples=300, deadline=None)
def test_block_round_trip(tokens):
    data = np.array(tokens, "<u4")
    assert (tokenbin.unpack_block(b"xx" + tokenbin.pack_block(data), 2) == data).all()


def test_block_uses_the_percentile_width():
    data = np.array([7] * 10 + list(range(100, 1000)) + [4_000_000_000] * 20, "<u4")
    packed = tokenbin.pack_block(data)
    low, n, width, size, patches = tokenbin.HEADER.unpack_from(packed)
    assert (low, n, width, patches) == (7, 930, 10, 20) and len(packed) < 930 * 10 / 8 + 20 * (2 + size) + 16


@given(st.lists(st.text(alphabet="abÉß1'#&. \n\t<|endoftext|>́é中", max_size=40), max_size=5))
@settings(max_examples=200, deadline=None)
def test_remembered_pieces_encode_like_whole_texts(texts):
    assert list(tokenbin.encoder(tokenbin.VOCABULARY).encode(texts)) == [direct(t) for t in texts]


def test_generations_do_not_change_tokens(monkeypatch):
    monkeypatch.setattr(tokenbin, "REMEMBERED", 3)
    own = tokenbin.Encoder(tokenbin.VOCABULARY)
    texts = [prose(i, 60) for i in range(6)]
    assert [x for t in texts for x in own.encode([t, t])] == [direct(t) for t in texts for _ in range(2)]


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out, start = [], 0
    for key, text, *_ in order:
        ids = direct(text) + np.array([1], "<u4").tobytes()
        out.append((key, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_odd_rows(odd, odd_rows, monkeypatch, tmp_path):
    got = [tuple(r) for r in tokenbin.token_report(odd, str(tmp_path / "t")).orderBy("start").collect()]
    assert got == expected(odd_rows)


def test_files_are_small_and_indexed(spark, odd, odd_rows, tmp_path):
    path = str(tmp_path / "t")
    tokenbin.write_tokens(odd, path)
    for row in spark.read.parquet(path).collect():
        assert sum(row["lengths"]) == row["tokens"] and len(row["block_starts"]) == -(-row["tokens"] // tokenbin.BLOCK)
        blocks = [tokenbin.unpack_block(row["payload"], s) for s in row["block_starts"]]
        assert sum(map(len, blocks)) == row["tokens"]
    total = sum(r["tokens"] for r in spark.read.parquet(path).collect())
    assert sum(len(r["payload"]) for r in spark.read.parquet(path).collect()) < 2.2 * total + 4096


def test_one_document_through_the_block_index(spark, tmp_path):
    path, rows = str(tmp_path / "t"), [(i, prose(i, 5 + 301 * i)) for i in range(20)] + [(7, prose(99, 70)), (30, None), (None, "none")]
    tokenbin.write_tokens(table(spark, rows), path)
    for key in (0, 7, 19, 30, 1000):
        got = sorted(r["ids"] for r in tokenbin.read_document(spark, path, key).collect())
        assert got == sorted(direct(t) + np.array([1], "<u4").tobytes() for k, t in rows if k == key)


def test_lines_that_cannot_be_cut_are_encoded_apart():
    own = tokenbin.Encoder(tokenbin.VOCABULARY)
    own.ends[:] = False
    texts = [prose(1, 60), "12 ab,c 3.5 (x) y!"]
    assert list(own.encode(texts)) == [direct(t) for t in texts]


def test_empty_table(nothing, tmp_path):
    assert tokenbin.token_report(nothing, str(tmp_path / "t")).count() == 0


def test_texts_that_spell_an_added_token(spark, tmp_path):
    library = Tokenizer.from_file(tokenbin.VOCABULARY)
    texts = ["a <|endoftext|> b", "<|startoftext|>", "A <|ENDOFTEXT|> b", "x<|endoftext|><|endoftext|>y\n<|start", "é中 <|endoftext|>", "a b"]
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [320, 49407, 321]
    packed = [np.array(i, "<u4").tobytes() for i in ids]
    assert list(tokenbin.encoder(tokenbin.VOCABULARY).encode(texts)) == packed
    got = tokenbin.token_report(table(spark, list(enumerate(texts))), str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(i) + 1 for i in ids]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(p + np.array([1], "<u4").tobytes()) for p in packed]
