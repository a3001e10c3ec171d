"""Line deduplication by winnowing.

Lines without a word are left out of the sequence and stay. For every line s of a document the forward window is s and
the lines after it until the window holds ``min_words`` words, the backward window is s and the lines before it until it
does (a document's last or first lines may hold too few and have no such window). A line goes if it lies in a run of at
least ``min_words`` words that also stands at any earlier place: the forward window of such a run's first line and the
backward windows of the lines after that one's end lie inside the run and cover it, so all lines of windows whose
contents stand at an earlier place are deleted, and no others. Earlier is the order of document identifiers, then of lines.

Winnowing keeps the line with the smallest hash of each window: places that share a window share its kept line. Windows
whose kept line's hash is kept at one place only are dropped. The others are joined by their contents with the earliest
place of the same contents.

A passage that very many documents share is one group of places. Its earliest place is a minimum that is combined
before the shuffle, and the way back is a join on stored tables whose skewed keys adaptive execution splits; places
are never paired with each other.

Defined cases: a null text is empty; rows that repeat an identifier and a text are one document, judged alike; rows that
repeat an identifier with other texts are ordered by the hash of their texts; null identifiers come first; an empty table
gives an empty result. Input columns beside identifier and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biospark.llm.words import WORD_CLASS, whole_text, words_of
from biospark.session import stage

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: id, key, at (its place among all lines), h (its hash), w (its words)."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    present = F.filter(numbered, lambda x: x["line"].rlike(WORD_CLASS))
    sized = F.transform(
        present,
        lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("h"), F.size(words_of(x["line"])).alias("w")),
    )
    distinct = docs.select("id", "key", sized.alias("lines")).groupBy("id", "key").agg(F.first("lines").alias("lines"))
    return distinct.select("id", "key", F.inline("lines"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """One row per window: id, key, at (its first line), ats (the places of its lines), content (two hashes of its lines),
    mark (their smallest hash), kept (its place)."""
    document = Window.partitionBy("id", "key")
    placed = lines.withColumn("stop", F.sum("w").over(document.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("start", F.col("stop") - F.col("w"))
    # Every line has a word, so starts and stops grow and a frame of words is a bounded list of lines.
    item = F.struct("at", "h", "start", "stop")
    listed = placed.select(
        "id", "key", "start", "stop",
        F.collect_list(item).over(document.orderBy("start").rangeBetween(0, min_words - 1)).alias("after"),
        F.collect_list(item).over(document.orderBy("stop").rangeBetween(1 - min_words, 0)).alias("before"),
    )
    forward = F.when(F.element_at("after", -1)["stop"] - F.col("start") >= min_words, F.col("after"))
    # One that holds enough words only with its last line is the forward window of its first line.
    first = F.col("before")[0]["start"]
    backward = F.when(
        (F.col("stop") - first >= min_words) & (F.element_at("before", -1)["start"] - first >= min_words), F.col("before")
    )
    found = listed.select("id", "key", F.explode(F.array(forward, backward)).alias("own")).filter("own is not null")
    hs = found.select("id", "key", F.col("own.at").alias("ats"), F.col("own.h").alias("hs"))
    marked = hs.withColumns({
        "at": F.col("ats")[0],
        "content": F.struct(F.xxhash64("hs", F.size("hs")).alias("a"), F.xxhash64(F.lit(1), "hs").alias("b")),
        "mark": F.array_min("hs"),
    })
    return marked.withColumn("kept", F.element_at("ats", F.array_position("hs", F.col("mark")).cast("int"))).drop("hs")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For ``docs(id, key, text)``: id, key and ``deleted``, the places of the lines to delete, where there are any."""
    windows = stage(_windows(_lines(docs), min_words))
    place = F.struct("id", "key", "kept")
    marks = windows.groupBy("mark").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    shared = stage(marks.filter("low <> high").select("mark"))
    candidates = stage(windows.join(shared, "mark", "left_semi").select("content", "id", "key", "at", "ats"))
    place = F.struct("id", "key", "at")
    earliest = stage(
        candidates.groupBy("content").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f <> l").select("content", "f")
    )
    later = candidates.join(earliest, "content").filter(
        ~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("key") == F.col("f.key")) & (F.col("at") == F.col("f.at")))
    )
    return later.select("id", "key", F.explode("ats").alias("at")).groupBy("id", "key").agg(F.collect_set("at").alias("deleted"))


def deduplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per row of ``docs``: identifier, clean_text, n_lines, n_deleted (lines)."""
    keyed = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    found = repeated_lines(keyed, min_words).select(F.col("id").alias("found_id"), F.col("key").alias("found_key"), "deleted")
    joined = keyed.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    lines = joined.select("id", F.split("text", "\n").alias("lines"), F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"))
    left = lines.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "deleted"))
    return left.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform("left", lambda i: F.get(F.col("lines"), i)), "\n").alias("clean_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("deleted").cast("long").alias("n_deleted"),
    )
