"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than ``PART_CHARS`` are encoded in parts. A part ends only where the pre-splitting pattern must
end a match: before an ASCII space that follows a character which no reading of "white space" includes. A run
without such a place is one part. Token identifiers travel as packed little-endian unsigned
32-bit integers, so a text costs four bytes per token and no list.

Defined cases: null and empty texts have no tokens; rows that repeat are encoded alike; an empty table gives an
empty result. Only the text column enters Python.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PART_CHARS = 1 << 16
# Documents whose tokens are held at once.
GROUP = 128
# A space after a character that is neither white space nor a control character.
SAFE_CUT = re.compile(r"(?<=[^\s\x00-\x20\x7f-\xa0]) ")


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts_of(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters that can be encoded one by one."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(coder: tiktoken.Encoding, text: str | None) -> bytes:
    packed = (np.array(coder.encode_ordinary(part), dtype="<u4").tobytes() for part in parts_of(text or ""))
    return b"".join(packed)


def decode_ids(coder: tiktoken.Encoding, packed: bytes) -> bytes:
    return coder.decode_bytes(np.frombuffer(packed, "<u4").tolist())


def encoded(text: Column, ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Packed token identifiers (binary) of a text column."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoding(ranks_path, pattern)
        for texts in batches:
            yield pd.Series([encode_text(coder, t) for t in texts], dtype=object)

    return encode(text)


def decoded(ids: Column, ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes (binary) that packed token identifiers stand for; they need not be whole characters."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoding(ranks_path, pattern)
        for packed in batches:
            yield pd.Series([None if p is None else decode_ids(coder, p) for p in packed], dtype=object)

    return decode(ids)


def round_trip(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str = RANKS,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """One row per document: identifier, n_tokens, ids (packed), decoded (bytes).

    Encoded and decoded in one pass, ``GROUP`` documents at a time, so a worker holds few tokens besides its input.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks_path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                some = batch.slice(start, GROUP)
                ids = [encode_text(coder, text) for text in some.column("text").to_pylist()]
                decoded_bytes = [decode_ids(coder, packed) for packed in ids]
                columns = [
                    some.column("id"), pa.array([len(p) // 4 for p in ids], pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(decoded_bytes, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"])

    schema = T.StructType([rows.schema["id"]]).add("n_tokens", "long").add("ids", "binary").add("decoded", "binary")
    return rows.mapInArrow(code, schema).withColumnRenamed("id", id_col)
