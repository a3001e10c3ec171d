"""Token identifiers in binary files: patched frame-of-reference blocks.

Encoding: the tokenizers library, its file given by path. ASCII white space never lies inside a token of a pre-split
that drops white space, so for plain Latin texts without apostrophes what stands between white space is encoded once
and remembered; new words are encoded many to a line, whose identifiers are cut where words end. Every other text is
encoded as it stands, as is one that spells an added token of the vocabulary (``<|endoftext|>``), which the library gives
that token's identifier.

File format: documents are sorted by identifier and dealt out in ranges, one row of the Parquet output per segment of a
range. A segment holds
  offset, tokens the number of tokens before it in its range, and its own
  ids, lengths   the documents and the number of their tokens (the document index)
  payload        blocks of ``BLOCK`` tokens, the last one may be shorter
  block_starts   the byte position of every block (the block index)
A block is, little-endian: minimum (u32), number of tokens (u16), width in bits (u8), size of an exception's high part
in bytes (u8), number of exceptions (u16); the low ``width`` bits of (token - minimum), packed from the lowest bit up;
the exceptions' positions (u16 each); their high parts. The width is the one that ``PERCENTILE`` per cent of
the block's values fit in, all larger values are exceptions. Spark commits the files, so a lost executor or
a repeated task leaves no half-written one.

Defined cases: a null text is empty and has only its end token; null identifiers come first; rows that repeat an identifier
follow each other in the order of their texts; an empty table gives an empty result. Identifiers are whole numbers; one
that is not (a text that spells none) is an error.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from biospark.llm.words import partitions_of
from biospark.session import scratch_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_TOKEN = 1
BLOCK = 4096
PERCENTILE = 95
# Tokens and documents of a segment; one longer document is a segment of its own.
SEGMENT_TOKENS = 1 << 20
SEGMENT_DOCS = 4096
# Words that an encoder remembers in each of its two generations, and new ones that it encodes as one line.
REMEMBERED = 250_000
LINE = 512
# Texts, and their characters, that are encoded together.
GROUP = 1024
GROUP_CHARS = 1 << 22

PLAIN = r"^[\t\n\x0b\x0c\r\x20-&(-~À-ÖØ-öø-ÿ]*$"
# What the tokenizer's pre-split makes of a plain text without white space.
PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
HEADER = struct.Struct("<IHBBH")
SEGMENT = "offset long, tokens long, ids array<long>, lengths array<long>, payload binary, block_starts array<long>"


class Encoder:
    """Texts to packed little-endian unsigned 32-bit identifiers."""

    def __init__(self, path: str):
        # Spark runs one worker per core; threads of their own would only contend.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        # Which identifiers end a word; without a mark for it words are encoded one by one.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_parts(self, parts: list[str]) -> Iterator[bytes]:
        """The identifiers of each of ``parts``, words of the pre-split, from lines of many of them."""
        lines = [parts[i : i + LINE] for i in range(0, len(parts), LINE)]
        for line, ids in zip(lines, self._encode([" ".join(line) for line in lines])):
            numbers = np.frombuffer(ids, "<u4")
            stops = np.flatnonzero(self.ends[numbers]) + 1
            if len(stops) != len(line) or stops[-1] != len(numbers):
                yield from self._encode(line)
                continue
            edges = [0, *(4 * stops).tolist()]
            yield from map(ids.__getitem__, map(slice, edges, edges[1:]))

    def _look_up(self, needed: list[str]) -> list[bytes]:
        """The identifiers of distinct words. Those that the new generation lacks are brought into it: from the old one, put
        together from their parts, or from the tokenizer."""
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = list(map(new.get, needed))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        missing = []
        for i in lacking:
            word = needed[i]
            if (ids := old.get(word)) is None:
                missing.append(word)
            else:
                found[i] = new[word] = ids
        made = {w: PART.findall(w) for w in missing if not w.isalpha()}
        parts = [p for p in {w for w in missing if w not in made}.union(*made.values()) if p not in new]
        new.update({p: old[p] for p in parts if p in old})
        unknown = [p for p in parts if p not in old]
        new.update(zip(unknown, self._encode_parts(unknown)))
        for word, own in made.items():
            new[word] = b"".join([new[p] for p in own])
        for i in lacking:
            if found[i] is None:
                found[i] = new[needed[i]]
        return found

    def _plain_words(self, texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """Which texts are plain, and the words of those, in lower case."""
        # The tokenizer lowers letters one by one, as Arrow does for these alphabets.
        lowered = pc.utf8_lower(texts)
        plain = pc.match_substring_regex(texts, PLAIN)
        for content in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(lowered, content)))
        return plain.to_numpy(zero_copy_only=False), pc.ascii_split_whitespace(lowered.filter(plain))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """``texts`` are few, so that their words fit in memory. Words are looked up once each; numbers do the rest."""
        plain, words = self._plain_words(pa.array(texts, pa.string()))
        coded = words.flatten().dictionary_encode()
        # By way of NumPy, which makes strings without an Arrow scalar for each.
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        packed = self._look_up(distinct)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        own = sizes[at]
        stops = np.append(0, np.cumsum(own))
        # Where each token of each word lies among the distinct words' tokens.
        source = np.repeat(starts[at] - stops[:-1], own) + np.arange(stops[-1])
        tokens = np.frombuffer(b"".join(packed), "<u4")[source].tobytes()
        edges = 4 * stops[np.append(0, np.cumsum(words.value_lengths().to_numpy()))]
        ranges = iter(zip(edges[:-1].tolist(), edges[1:].tolist()))
        for text, is_plain in zip(texts, plain.tolist()):
            if is_plain:
                low, high = next(ranges)
                yield tokens[low:high]
            else:
                yield self._encode([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack_block(tokens: np.ndarray) -> bytes:
    """One block of at most 65,535 tokens."""
    low = int(tokens.min())
    values = tokens.astype(np.uint64) - np.uint64(low)
    rank = max(0, -(-len(values) * PERCENTILE // 100) - 1)
    width = int(np.partition(values, rank)[rank]).bit_length()
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=width or 1, bitorder="little")
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes() if width else b""
    at = np.flatnonzero(values >> np.uint64(width))
    high = (values[at] >> np.uint64(width)).astype("<u8")
    size = (int(high.max()).bit_length() + 7) // 8 if len(at) else 0
    patches = np.ascontiguousarray(high.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes() if len(at) else b""
    return HEADER.pack(low, len(values), width, size, len(at)) + packed + at.astype("<u2").tobytes() + patches


def unpack_block(data: bytes, start: int) -> np.ndarray:
    low, n, width, size, patches = HEADER.unpack_from(data, start)
    at = start + HEADER.size
    values = np.zeros(n, dtype=np.uint64)
    if width:
        stored = np.frombuffer(data, np.uint8, -(-n * width // 8), at)
        bits = np.unpackbits(stored, count=n * width, bitorder="little").reshape(n, width)
        whole = np.zeros((n, 64), np.uint8)
        whole[:, :width] = bits
        values = np.packbits(whole, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
        at += len(stored)
    if patches:
        positions = np.frombuffer(data, "<u2", patches, at).astype(np.int64)
        raw = np.zeros((patches, 8), np.uint8)
        raw[:, :size] = np.frombuffer(data, np.uint8, patches * size, at + 2 * patches).reshape(patches, size)
        values[positions] |= raw.view("<u8").ravel() << np.uint64(width)
    return (values + np.uint64(low)).astype("<u4")


def pack_segment(ids: list, coded: list[bytes], offset: int) -> dict:
    """A segment from documents' identifiers and packed tokens."""
    tokens = np.frombuffer(b"".join(coded), "<u4")
    blocks = [pack_block(tokens[i : i + BLOCK]) for i in range(0, len(tokens), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks[:-1])]) if blocks else []
    return {
        "offset": offset, "tokens": len(tokens), "ids": ids, "lengths": [len(c) // 4 for c in coded], "payload": b"".join(blocks), "block_starts": [int(s) for s in starts],
    }


def unpack_documents(lengths, payload: bytes, block_starts) -> Iterator[bytes]:
    """The packed tokens of each document of a segment; one block is unpacked at a time."""
    blocks = (unpack_block(payload, int(s)).tobytes() for s in block_starts)
    rest = b""
    for length in lengths:
        parts, have = [rest], len(rest)
        while have < 4 * length:
            parts.append(next(blocks))
            have += len(parts[-1])
        joined = b"".join(parts)
        yield joined[: 4 * length]
        rest = joined[4 * length :]


def _groups(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS or i + 1 - low >= GROUP:
            yield ids[low : i + 1], texts[low : i + 1]
            low, size = i + 1, 0
    if low < len(texts):
        yield ids[low:], texts[low:]


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end_token: int | None = END_TOKEN,
) -> None:
    """Write the tokens of all documents in ascending order of the identifier under ``path``.

    Parquet columns: shard, the number of the range, and those of a segment.
    """
    end = b"" if end_token is None else np.array([end_token], "<u4").tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ids, coded, size, offset = encoder(vocabulary), [], [], 0, 0
        for batch in batches:
            for keys, texts in _groups(batch["id"].tolist(), batch["text"].tolist()):
                for key, tokens in zip(keys, own.encode(texts)):
                    ids.append(None if key is None else int(key))
                    coded.append(tokens + end)
                    size += len(coded[-1]) // 4
                    if size >= SEGMENT_TOKENS or len(ids) >= SEGMENT_DOCS:
                        yield pd.DataFrame([pack_segment(ids, coded, offset)])
                        ids, coded, size, offset = [], [], 0, offset + size
        if ids:
            yield pd.DataFrame([pack_segment(ids, coded, offset)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Beginnings of texts part the rows of an identifier that repeats very often.
    dealt = rows.repartitionByRange(partitions_of(docs), "id", F.substring("text", 1, 24)).sortWithinPartitions("id", "text")
    # As text, because pandas has no whole numbers with gaps.
    segments = dealt.withColumn("id", F.col("id").cast("string")).mapInPandas(encode, SEGMENT)
    segments.withColumn("shard", F.spark_partition_id()).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The stored segments with ``before``, the number of tokens of all segments before."""
    stored = spark.read.parquet(path)
    totals = stored.groupBy("shard").agg(F.sum("tokens").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0).cast("long")).alias("shard_before"))
    # One row per range of the writer, at most its number of shuffle partitions.
    return stored.join(F.broadcast(shards), "shard").withColumn("before", F.col("shard_before") + F.col("offset"))


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per stored document: identifier, start (tokens before it), n_tokens, ids (packed)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                start = int(row.before)
                rows, held = [], 0
                for key, tokens in zip(row.ids, unpack_documents(row.lengths, row.payload, row.block_starts)):
                    rows.append((None if key is None else int(key), start, len(tokens) // 4, tokens))
                    start, held = start + len(tokens) // 4, held + len(tokens)
                    if held > 1 << 22:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["id", "start", "n_tokens", "ids"])
        return out.astype({"id": "Int64"})

    keys = F.col("ids").cast("array<string>").alias("ids")
    segments = read_segments(spark, path).select("before", keys, "lengths", "payload", "block_starts")
    unpacked = segments.mapInPandas(unpack, "id long, start long, n_tokens long, ids binary")
    return unpacked.withColumnRenamed("id", id_col)


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The rows of ``read_tokens`` without start for one identifier; only the blocks that hold its tokens are unpacked."""

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.asarray(row.lengths, np.int64)
                stops = np.cumsum(lengths)
                for at in np.flatnonzero(np.asarray(row.own, bool)):
                    low, high = int(stops[at] - lengths[at]), int(stops[at])
                    blocks = row.block_starts[low // BLOCK : -(-high // BLOCK)]
                    found = b"".join(unpack_block(row.payload, int(s)).tobytes() for s in blocks)
                    skip = 4 * (low % BLOCK)
                    yield _found(doc_id, high - low, found[skip : skip + 4 * (high - low)])

    def _found(key: int, n: int, ids: bytes) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key], "n_tokens": [n], "ids": [ids]})

    held = spark.read.parquet(path).filter(F.array_contains("ids", F.lit(doc_id).cast("long")))
    own = F.transform("ids", lambda i: i.eqNullSafe(F.lit(doc_id).cast("long"))).alias("own")
    return held.select(own, "lengths", "payload", "block_starts").mapInPandas(seek, "doc_id long, n_tokens long, ids binary")


def token_report(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the tokens (by default under the shared folder), read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, **options)
    id_col = options.get("id_col", "doc_id")
    read = read_tokens(spark, path, id_col)
    return read.select(id_col, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
