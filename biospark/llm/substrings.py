"""Removal of word runs that an earlier document has, with a count-min prefilter.

A window is ``min_words`` consecutive words of one document. A word goes if a window covers it whose word sequence also
starts in a document with a smaller identifier.

1. Each partition sketches its documents. A window is known by the keys of its two halves; the key of a half is the smallest
   hash of the word grams inside it, so equal windows have equal keys, neighbouring ones mostly share them, and the sketch
   holds a small part of the windows' number. Each document counts a key once. Partition sketches are merged in slices;
   the lower count of a window's keys is never below the number of documents with the window.
2. A second pass takes only windows that are estimated to be in two documents and groups them exactly, by 128-bit BLAKE2
   digests of their words: sampled splitters range-partition them by digest and identifier, each partition is sorted and
   read as a stream, and all rows of a group whose identifier is not the first one's are repeats. Of a group that
   goes on in the next partition the first identifier is handed on, one row per partition.

A whole text is one more key of the sketch. Of texts estimated to be repeated only a digest goes on; those that a smaller
identifier has word for word lose all their words, the others are taken up as in step 2. A window that one document
repeats is one row. A passage that very many documents share is spread over partitions by their identifiers.

The sketch has about one counter per ``BYTES_PER_CELL`` bytes of text and row, ``MOST_BITS`` at most, of which one bit
each is sent to the workers (``ROWS * 2 ** MOST_BITS / 8`` bytes, 96 MiB, at most). Beyond that size estimates get looser
and more windows are grouped exactly; none is lost.

Defined cases: a null or empty text has no words; a text below ``min_words`` words loses none; rows that repeat an identifier
do not take from each other, whatever their texts; a row with a null identifier takes nothing and loses nothing; an empty
table gives an empty result. Other input columns are not read. Very long texts are hashed in stretches; their words are
held as one list only while words are being removed from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biospark.llm import sketch
from biospark.llm.words import partitions_of, ship_package, word_chunks
from biospark.session import stage

MIN_WORDS = 50
ROWS = 3
BYTES_PER_CELL = 32
LEAST_BITS, MOST_BITS = 16, 28
# Documents whose rows are built at once, and keys that a partition holds before it hands on their counters.
GROUP = 256
HELD_KEYS = 1 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)


def _span(size: int) -> int:
    """How many grams of ``size`` words their key is the smallest of; a power of two."""
    return 1 << max(0, (2 * size // 3).bit_length() - 1)


def _half(min_words: int) -> int:
    """Words of each half; the halves of a window overlap by one word if it has an odd number."""
    return -(-min_words // 2)


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes, from hashes of runs whose lengths are powers of two."""
    count, whole, start, part, width = len(words) - size + 1, None, 0, words, 1
    while width <= size:
        if size & width:
            piece = part[start : start + count]
            whole = piece if whole is None else sketch.mixed(whole * STEP + piece)
            start += width
        if 2 * width <= size:
            part = sketch.mixed(part[:-width] * STEP + part[width:])
        width *= 2
    return whole


def run_keys(words: list[bytes], size: int) -> np.ndarray:
    """The key of the ``size`` words from each word on."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = _span(size)
    keys, width = sketch.mixed(_gram_hashes(hashes, size - span + 1)), 1
    while width < span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return keys


def _stretches(data: bytes, min_words: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first word's number, words) such that every window is in exactly one of them, all words are in some."""
    tail, first = [], 0
    for words in word_chunks(data):
        words = tail + words
        yield first, words
        tail = words[max(0, len(words) - min_words + 1) :] if min_words > 1 else []
        first += len(words) - len(tail)


def _digest_numbers(digest: bytes) -> np.ndarray:
    return np.frombuffer(digest, "<i8")


class _Text:
    """What both passes read off a text: its words' number, the digest of its words, its keys."""

    def __init__(self, text: str | None, min_words: int):
        self.data = (text or "").encode()
        self.runs, self.n_words = [], 0
        whole = blake2b(digest_size=16)
        for first, words in _stretches(self.data, min_words):
            fresh = words[self.n_words - first :]
            whole.update(b" ".join(fresh) + b" ")
            self.n_words = first + len(words)
            keys = run_keys(words, _half(min_words)) if len(words) >= min_words else np.zeros(0, np.uint64)
            # A key mostly stays for many places; only its first one and its value are kept.
            starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            self.runs.append((keys[starts], np.diff(starts, append=len(keys))))
        self.whole = whole.digest()
        number = np.frombuffer(self.whole, "<u8")[:1]
        self.whole_key = sketch.mixed(number ^ STEP) if self.n_words >= min_words else number[:0]

    def keys(self) -> np.ndarray:
        return np.unique(np.concatenate([self.whole_key, *[k for k, _ in self.runs]]))

    def candidates(self, table: np.ndarray, shape: sketch.Shape, min_words: int) -> dict[bytes, list[int]]:
        """Digest of each window whose keys pass, with the places where it starts."""
        found: dict[bytes, list[int]] = {}
        chosen = [sketch.passes(table, shape, keys) for keys, _ in self.runs]
        if not any(c.any() for c in chosen):
            return found
        for (first, words), (_, sizes), passing in zip(_stretches(self.data, min_words), self.runs, chosen):
            halves = np.repeat(passing, sizes)
            last = len(halves) - (min_words - _half(min_words))
            places = np.flatnonzero(halves[: max(last, 0)] & halves[min_words - _half(min_words) :]).tolist()
            if not places:
                continue
            view = memoryview(b" ".join(words))
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            stops = np.cumsum(lengths + 1) - 1
            begins, stops = (stops - lengths).tolist(), stops.tolist()
            for at in places:
                digest = blake2b(view[begins[at] : stops[at + min_words - 1]], digest_size=16).digest()
                found.setdefault(digest, []).append(first + at)
        return found


def _partial(docs: DataFrame, shape: sketch.Shape, min_words: int) -> DataFrame:
    """The counters of each partition, in slices."""

    def flush(held: list[np.ndarray]) -> pd.DataFrame:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        counts = np.minimum(counts, shape.limit)
        cells = np.concatenate(list(shape.cells(keys)))
        order = np.argsort(cells)
        cells, counts = cells[order], np.tile(counts, shape.rows)[order]
        starts = np.flatnonzero(np.diff(cells, prepend=-1))
        return sketch.parts(cells[starts], np.minimum(np.add.reduceat(counts, starts), shape.limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, GROUP):
                for text in batch.slice(low, GROUP).column("text").to_pylist():
                    keys = _Text(text, min_words).keys()
                    if len(keys):
                        held.append(keys)
                        size += len(keys)
                if size >= HELD_KEYS:
                    yield pa.RecordBatch.from_pandas(flush(held), preserve_index=False)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pandas(flush(held), preserve_index=False)

    return docs.select("text").mapInArrow(run, sketch.PART)


def _kept(data: bytes, digest: bool) -> str:
    if not digest:
        return b" ".join(data.split()).decode()
    whole, between = sha256(), b""
    for words in word_chunks(data):
        whole.update(between + b" ".join(words))
        between = b" "
    return whole.hexdigest()


def _scan(
    docs: DataFrame, bits: Broadcast, shape: sketch.Shape, min_words: int, digest: bool, texts_repeat: bool
) -> DataFrame:
    """One row per row of ``docs(rid, id, text)``: n_words, the digest of the words (w1, w2), and

    - if the whole text may be repeated (and ``texts_repeat``): twin and text;
    - else windows, digests and places of the windows that may be repeated, and text if there are any;
    - else kept, the words or their digest.
    """
    kind = docs.schema["id"].dataType.simpleString()
    window = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.binary())])

    def rows(sub: pa.RecordBatch) -> pa.RecordBatch:
        n_words, whole, twin, texts, kept = [], [], [], [], []
        offsets, digests, places = [0], [], []
        for text in sub.column("text").to_pylist():
            read = _Text(text, min_words)
            repeated = bool(texts_repeat and len(read.whole_key) and sketch.passes(bits.value, shape, read.whole_key)[0])
            found = {} if repeated else read.candidates(bits.value, shape, min_words)
            n_words.append(read.n_words)
            whole.append(read.whole)
            twin.append(repeated)
            texts.append(text if repeated or found else None)
            kept.append(None if repeated or found else _kept(read.data, digest))
            digests += found
            places += [np.array(at, "<i4").tobytes() for at in found.values()]
            offsets.append(len(digests))
        numbers, wholes = _digest_numbers(b"".join(digests)).reshape(-1, 2), _digest_numbers(b"".join(whole)).reshape(-1, 2)
        windows = pa.StructArray.from_arrays(
            [pa.array(numbers[:, 0]), pa.array(numbers[:, 1]), pa.array(places, pa.binary())], fields=list(window)
        )
        return pa.RecordBatch.from_arrays(
            [
                sub.column("rid"), sub.column("id"), pa.array(n_words, pa.int64()),
                pa.array(wholes[:, 0]), pa.array(wholes[:, 1]), pa.array(twin), pa.array(texts, pa.string()),
                pa.array(kept, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), windows),
            ],
            names=["rid", "id", "n_words", "w1", "w2", "twin", "text", "kept", "windows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, GROUP):
                yield rows(batch.slice(low, GROUP))

    schema = (
        f"rid long, id {kind}, n_words long, w1 long, w2 long, twin boolean, text string, kept string, "
        "windows array<struct<h1: long, h2: long, at: binary>>"
    )
    return docs.select("rid", "id", "text").mapInArrow(run, schema)


def _later(windows: DataFrame) -> DataFrame:
    """rid, at for the ``windows(h1, h2, id, rid, at)`` whose digest a smaller identifier has."""
    kind = windows.schema["id"].dataType.simpleString()
    order = ["h1", "h2", "id"]
    names = ["kind", "h1", "h2", "id", "rid", "at"]
    repeat, open_row, head = 0, 1, 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, groups = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, ids = batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), batch.column("id")
            fresh = np.append(group != (h1[0], h2[0]), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            number = groups + np.cumsum(fresh)
            # The first identifier of each row's group; that of a group from the batch before stands in front.
            firsts = pa.concat_arrays([ids.slice(0, 1) if first is None else first, ids])
            own_first = firsts.take(pa.array(np.maximum.accumulate(np.where(fresh, np.arange(1, len(h1) + 1), 0))))
            later = pc.not_equal(ids, own_first).to_numpy(zero_copy_only=False)
            unsure = ~later & (number == 1)
            for flags, value in ((later, repeat), (unsure, open_row)):
                at = pa.array(np.flatnonzero(flags))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), value, np.int32)), *[batch.column(c).take(at) for c in names[1:]]], names=names
                    )
            group, first, groups = (h1[-1], h2[-1]), own_first.slice(len(own_first) - 1), int(number[-1])
        if group is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([head], pa.int32()), pa.array([group[0]]), pa.array([group[1]]), first,
                    pa.array([None], pa.int64()), pa.array([None], pa.binary()),
                ],
                names=names,
            )

    placed = windows.repartitionByRange(partitions_of(windows), *order).sortWithinPartitions(*order).select(*names[1:])
    found = stage(placed.mapInArrow(run, f"kind int, h1 long, h2 long, id {kind}, rid long, at binary"))
    # At most one row per partition.
    heads = found.filter(F.col("kind") == head).groupBy("h1", "h2").agg(F.min("id").alias("first"))
    unsure = found.filter(F.col("kind") == open_row).join(heads, ["h1", "h2"]).filter("id > first")
    return found.filter(F.col("kind") == repeat).select("rid", "at").unionByName(unsure.select("rid", "at"))


def _removed(df: DataFrame, min_words: int, digest: bool) -> DataFrame:
    """id, n_words, n_removed, kept for rows (id, n_words, text, gone): ``gone`` are places of windows to remove."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, GROUP):
                sub = batch.slice(low, GROUP)
                n_removed, kept = [], []
                for text, gone in zip(sub.column("text").to_pylist(), sub.column("gone").to_pylist()):
                    words = text.encode().split()
                    edges = np.zeros(len(words) + 1, np.int64)
                    starts = np.frombuffer(b"".join(gone or ()), "<i4")
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + min_words, -1)
                    covered = np.cumsum(edges)[:-1] > 0
                    left = b" ".join([words[i] for i in np.flatnonzero(~covered)])
                    n_removed.append(int(covered.sum()))
                    kept.append(sha256(left).hexdigest() if digest else left.decode())
                yield pa.RecordBatch.from_arrays(
                    [sub.column("id"), sub.column("n_words"), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["id", "n_words", "n_removed", "kept"],
                )

    return df.select("id", "n_words", "text", "gone").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, digest: bool = False
) -> DataFrame:
    """One row per row of ``docs``: identifier, n_words, n_removed, kept (the remaining words, joined by one space).

    With ``digest``, kept is their SHA-256 instead, so that texts that lose nothing need not be stored.
    """
    if min_words < 1:
        raise ValueError(f"min_words must be positive, not {min_words}")
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = sketch.Shape(ROWS, sketch.bits_for(size / BYTES_PER_CELL, LEAST_BITS, MOST_BITS), 2)
    bits = sketch.reached(_partial(rows, shape, min_words), shape)

    scanned = stage(_scan(rows, bits, shape, min_words, digest, texts_repeat=True))
    twins = scanned.filter("twin")
    earliest = stage(twins.groupBy("w1", "w2").agg(F.min("id").alias("first")))
    judged = stage(twins.select("rid", "id", "n_words", "w1", "w2").join(earliest, ["w1", "w2"]))
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    copies, others = judged.filter(later), judged.filter(~later).select("rid")
    again = stage(_scan(twins.join(others, "rid", "left_semi"), bits, shape, min_words, digest, texts_repeat=False))

    left = scanned.filter("not twin").unionByName(again)
    windows = left.filter("kept is null and id is not null").select("rid", "id", F.inline("windows"))
    gone = _later(windows).groupBy("rid").agg(F.collect_list("at").alias("gone"))
    touched = left.filter("kept is null").select("rid", "id", "n_words", "text").join(gone, "rid", "left")

    found = (
        left.filter("kept is not null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
        .unionByName(copies.select("id", "n_words", F.col("n_words").alias("n_removed"), F.lit(_kept(b"", digest)).alias("kept")))
        .unionByName(_removed(touched, min_words, digest))
    )
    return found.withColumnRenamed("id", id_col)
