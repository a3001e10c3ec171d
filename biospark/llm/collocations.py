"""Phrase collocations by prefix-free parsing.

1. Parsing. A text becomes pieces (split at punctuation and line ends) of words. A word whose hash together with those of the
   next ``longest - 2`` words is zero modulo ``MODULUS`` is a trigger: the text is cut there, and the part before it keeps the
   trigger's ``longest - 1`` words, so neighbouring parts overlap by them. Cuts depend on content alone, so equal passages
   fall into equal parts wherever they stand. The distinct parts of each language with the number of their occurrences
   are the dictionary.
2. Counting. Phrases are counted inside the distinct parts only, each weighted by its part's frequency. A phrase that starts in
   the overlap at a part's end is counted in the next part, where it starts again; only the last part of a
   text counts those as well. A first pass over the dictionary sketches words and pairs of words; a second one counts exactly
   the phrases all of whose pairs the sketch lets reach the least frequency. Estimates are never too low and no phrase
   is more frequent than its pairs, so no frequent phrase is lost.
3. Scoring, in joins over the frequent phrases. Every part of a frequent phrase is frequent too, so all counts that scores need
   are there.

The sketch has a counter per ``BYTES_PER_CELL`` bytes of the dictionary, ``2 ** MOST_BITS`` at most, of which one bit each
is sent to the workers (32 MiB at most). Beyond that size estimates get looser and more phrases are counted exactly.

Defined cases: a null text is empty; a null language is ``und``; rows that repeat count as often as they stand there; a
long text without a trigger is one part; ties in rank cannot remain, as phrases differ; an empty table
gives an empty result. Other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biospark.llm import sketch
from biospark.llm.words import ship_package
from biospark.session import stage

LONGEST = 5
LEAST = 100
TOP = 2000
MODULUS = 64
ROWS, BYTES_PER_CELL, LEAST_BITS, MOST_BITS = 1, 32, 16, 28
# Cells that a partition holds before it hands on their counters.
HELD_CELLS = 1 << 22
# Bytes of text, and rows, that are parsed or counted together.
BATCH = 1 << 21
ROWS_AT_ONCE = 512
SALTS = 32
STEP = np.uint64(0x9E3779B97F4A7C15)
_FROM = bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d\t"
_TO = bytes(range(97, 123)) + b"\n" * 10 + b" "
_TABLE = bytes.maketrans(_FROM, _TO)


def pieces(text: str | None) -> list[bytes]:
    """The pieces that have a word, lower-cased, with one space between words."""
    lines = (text or "").encode().translate(_TABLE).split(b"\n")
    return [b" ".join(words) for line in lines if (words := line.split())]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def parse(texts: list[str | None], longest: int = LONGEST, modulus: int = MODULUS) -> tuple[list[int], list[bytes], list[bool]]:
    """(text's number, part, whether it is the text's last) for every part; pieces are separated by line feeds."""
    lines = [b"\n".join(pieces(t)) for t in texts]
    owners, parts, lasts = [], [], []
    words = b"\n".join(lines).split()
    if not words:
        return owners, parts, lasts
    overlap = longest - 1
    hashes, rolled = _hashes(words), None
    for k in range(overlap):
        ahead = hashes[k : len(hashes) - overlap + k + 1]
        rolled = ahead if rolled is None else rolled * STEP + ahead
    triggers = np.flatnonzero(sketch.mixed(rolled) % np.uint64(modulus) == 0) if len(hashes) >= overlap else np.zeros(0, int)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = 0
    for number, line in enumerate(lines):
        count = line.count(b" ") + line.count(b"\n") + 1 if line else 0
        low, high = np.searchsorted(triggers, [first + 1, first + count - overlap + 1])
        cuts = (triggers[low:high] - first).tolist()
        stops = np.cumsum(sizes[first : first + count])
        for start, stop in zip([0, *cuts], [*cuts, None] if count else []):
            begin = int(stops[start - 1]) if start else 0
            part = line[begin:] if stop is None else line[begin : int(stops[stop + overlap - 1]) - 1]
            owners.append(number)
            parts.append(part)
            lasts.append(stop is None)
        first += count
    return owners, parts, lasts


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(low, ROWS_AT_ONCE)


def _grouped(lengths: list[int], most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with about ``most`` bytes."""
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if size or start < len(lengths):
        yield start, len(lengths)


def dictionary(docs: DataFrame, longest: int = LONGEST, modulus: int = MODULUS) -> DataFrame:
    """Distinct parts of ``docs(lang, text)`` with their frequency: lang, part, last, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            langs, texts = some.column("lang"), some.column("text").to_pylist()
            for low, high in _grouped([len(t or "") for t in texts]):
                owners, parts, lasts = parse(texts[low:high], longest, modulus)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array([low + o for o in owners], pa.int64())), pa.array(parts, pa.binary()).cast(pa.string()), pa.array(lasts, pa.bool_())],
                    names=["lang", "part", "last"],
                )

    parsed = docs.select("lang", "text").mapInArrow(run, "lang string, part string, last boolean")
    return parsed.groupBy("lang", "part", "last").agg(F.count("*").alias("n"))


class _Counted:
    """The phrases of a batch of dictionary rows: hashes, weights and places."""

    def __init__(self, langs: list[str], parts: list[str], lasts: np.ndarray, n: np.ndarray, longest: int):
        self.langs, self.longest = langs, longest
        lines = [p.encode() for p in parts]
        self.text = b"\n".join(lines)
        self.words = self.text.split()
        size = len(self.words)
        marks = np.frombuffer(self.text, np.uint8)
        gaps = np.flatnonzero((marks == 32) | (marks == 10))
        self.begins = np.append(0, gaps + 1)
        self.stops = np.append(gaps, len(self.text))
        # Whether a word ends its piece or its part.
        self.ends = np.append(marks[gaps] == 10, True)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
        last_words = np.searchsorted(self.begins, np.cumsum(sizes) - 1, side="left") - 1
        counts = np.diff(last_words, prepend=-1)
        self.row = np.repeat(np.arange(len(lines)), counts)
        place_from_end = np.repeat(last_words, counts) - np.arange(size)
        self.own = np.repeat(lasts, counts) | (place_from_end >= longest - 1)
        self.weight = np.repeat(n, counts)
        names = {lang: sketch.mixed(np.array([xxhash.xxh64_intdigest(lang.encode())], np.uint64))[0] for lang in set(langs)}
        self.seed = np.repeat(np.array([names[lang] for lang in langs], np.uint64), counts)
        self.hashes = _hashes(self.words)

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, whether a phrase of it starts at a word, its hashes) for the first words of all phrases."""
        whole, valid = self.hashes, np.ones(len(self.hashes), bool)
        for length in range(1, longest + 1):
            if length > 1:
                whole = sketch.mixed(whole[:-1] * STEP + self.hashes[length - 1 :])
                valid = valid[:-1] & ~self.ends[length - 2 : len(self.ends) - 1]
            yield length, valid, sketch.mixed(whole ^ self.seed[: len(whole)] ^ np.uint64(length))


def _batches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[_Counted]:
    """Dictionary rows of about ``BATCH`` bytes at a time."""
    held: list[tuple] = []
    size = 0
    for some in _slices(batches):
        for row in zip(*(some.column(c).to_pylist() for c in ("lang", "part", "last", "n"))):
            held.append(row)
            size += len(row[1])
            if size >= BATCH:
                yield _counted(held, longest)
                held, size = [], 0
    if held:
        yield _counted(held, longest)


def _counted(held: list[tuple], longest: int) -> _Counted:
    langs, parts, lasts, n = zip(*held)
    return _Counted(list(langs), list(parts), np.array(lasts, bool), np.array(n, np.int64), longest)


def _sums(cells: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cells)
    cells, counts = cells[order], counts[order]
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[starts], np.minimum(np.add.reduceat(counts, starts), limit) if len(starts) else counts


def _sketched(parts: DataFrame, shape: sketch.Shape, longest: int) -> DataFrame:
    """The counters of words and pairs, per partition and in slices."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        cells, counts = _sums(*(np.concatenate(h) for h in zip(*held)), shape.limit)
        return pa.RecordBatch.from_pandas(sketch.parts(cells, counts), preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for counted in _batches(batches, longest):
            for _, valid, keys in counted.phrases(2):
                at = np.flatnonzero(valid & counted.own[: len(valid)])
                weight = np.minimum(counted.weight[at], shape.limit)
                for cells in shape.cells(keys[at]):
                    cells, sums = _sums(cells, weight, shape.limit)
                    held.append((cells, sums.astype(np.int16)))
                    size += len(cells)
            if size >= HELD_CELLS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return parts.select("lang", "part", "last", "n").mapInArrow(run, sketch.PART)


def _exact(parts: DataFrame, bits: Broadcast, shape: sketch.Shape, longest: int) -> DataFrame:
    """lang, phrase, n for the phrases that may be frequent, added up per batch; the empty phrase has all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counted in _batches(batches, longest):
            langs, phrases, sums = [], [], []
            pairs = may = None
            for length, valid, keys in counted.phrases(longest):
                own = valid & counted.own[: len(valid)]
                if length == 1:
                    per_row = np.bincount(counted.row[own], counted.weight[own], len(counted.langs)).astype(np.int64)
                    all_words: dict[str, int] = {}
                    for lang, n in zip(counted.langs, per_row.tolist()):
                        all_words[lang] = all_words.get(lang, 0) + n
                    langs += all_words
                    phrases += [b""] * len(all_words)
                    sums += all_words.values()
                if length <= 2:
                    pairs = may = sketch.passes(bits.value, shape, keys)
                else:
                    may = may[:-1] & pairs[length - 2 :]
                at = np.flatnonzero(own & may)
                if not len(at):
                    continue
                keys = keys[at]
                order = np.argsort(keys, kind="stable")
                at, keys = at[order], keys[order]
                starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                added = np.add.reduceat(counted.weight[at], starts)
                first = at[starts]
                begins, stops = counted.begins[first].tolist(), counted.stops[first + length - 1].tolist()
                langs += [counted.langs[i] for i in counted.row[first].tolist()]
                phrases += [counted.text[b:e] for b, e in zip(begins, stops)]
                sums += added.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sums, pa.int64())],
                names=["lang", "phrase", "n"],
            )

    return parts.select("lang", "part", "last", "n").mapInArrow(run, "lang string, phrase string, n long")


def phrase_counts(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, modulus: int = MODULUS
) -> DataFrame:
    """lang, phrase, a for all phrases of up to ``longest`` words that occur ``least`` times or more, and the number of
    all words as the empty phrase's."""
    if not 2 <= longest <= 16 or not 1 <= least <= 255:
        raise ValueError("longest must be between 2 and 16, least between 1 and 255")
    ship_package(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    parts = stage(dictionary(texts, longest, modulus))
    size = parts.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    shape = sketch.Shape(ROWS, sketch.bits_for(size / BYTES_PER_CELL, LEAST_BITS, MOST_BITS), least)
    bits = sketch.reached(_sketched(parts, shape, longest), shape)
    counted = _exact(parts, bits, shape, longest).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    return stage(counted.filter((F.col("a") >= least) | (F.col("phrase") == "")))


def _run(words: Column | str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST,
    top: int = TOP, modulus: int = MODULUS,
) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A cut after a phrase's first k words scores floor(1000 a n / (l r)), the lowest cut counts, the smallest k of equal ones.
    Phrases that lie inside a longer frequent one with the same count are left out.
    """
    frequent = phrase_counts(docs, lang_col, text_col, longest, least, modulus)
    totals = frequent.filter("phrase = ''").select("lang", F.col("a").alias("n"))
    words = F.split("phrase", " ")
    found = frequent.filter("phrase like '% %'").withColumns({"words": words, "m": F.size(words)})

    # Of each phrase the shorter ones inside it, with the highest count of a phrase around them.
    lengths = F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size")
    inner = found.filter("m > 2").select("lang", "a", "words", "m", lengths)
    inner = inner.select("lang", "a", "words", "size", F.explode(F.expr("sequence(1, m - size + 1)")).alias("at"))
    around = inner.select("lang", "a", _run("words", F.col("at"), F.col("size")).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = found.join(around, ["lang", "phrase"], "left").filter("around is null or around < a").select("lang", "phrase", "a", "words", "m")

    cuts = left.select("*", F.explode(F.expr("sequence(1, m - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k",
        _run("words", F.lit(1), F.col("k")).alias("head"), _run("words", F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"),
    )
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = frequent.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    sized = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    score = sized.withColumns({f"w_{c}": v for c, v in wide.items()}).withColumn(
        "score", F.expr("(cast(1000 * w_a as decimal(19,0)) * w_n) div (w_l * w_r)")
    )
    best = score.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))

    # A language may have most phrases: its first ones are first chosen among parts of them.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = best.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    some = some.filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
