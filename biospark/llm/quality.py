"""Quality rules: clean lines first, then reject documents that lose too much text.

Each line is tested by rules on punctuation, navigation and boilerplate; lines that fail are removed. A
document is rejected when the removed lines hold more than ``max_loss`` of its words, or by the base rules
on its length and its repeated five-word windows. Everything is a column expression over one row, so there
is no shuffle, and rows that repeat are judged alike.

Defined cases: a null text has no words and fails the base rules; a line without a word is neither
tested nor counted; an empty table gives an empty result. Input columns beside identifier and text
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biospark.llm.words import GAP_CLASS, WORD_CLASS, whole_text, word_count, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"

# The line rules, in the notation that Java and DuckDB share.
ENDS_SENTENCE = r"[.!?…:;][)\]\"'”’»]*" + GAP_CLASS + r"*\z"
LONG_LINE = f"^{GAP_CLASS}*(?:{WORD_CLASS}+{GAP_CLASS}+){{29}}{WORD_CLASS}"
SYMBOL_RUNS = r"(?:[#*$%&<>=_~^]{2,}[^#*$%&<>=_~^]*){3}"
SHOUT_RUNS = r"(?:[!?]{2,}[^!?]*){3}"
SEPARATORS = r"(?:[|»›•·→][^|»›•·→]*){3}"
MENU_WORD = (
    r"(?:home|menu|log ?in|log ?out|sign ?in|sign ?up|register|contact(?: us)?|about(?: us)?|search|site ?map|next"
    r"|previous|back to top|skip to content|share|tweet|faq|help|news|shop|cart|my account)"
)
MENU = rf"(?i)^{GAP_CLASS}*{MENU_WORD}(?:{GAP_CLASS}*[|/,>»·•-]*{GAP_CLASS}*{MENU_WORD})*[.!]?{GAP_CLASS}*\z"
BOILERPLATE = (
    r"(?i)all rights reserved|copyright \(c\)|©|privacy policy|terms of (?:use|service)|cookie policy|we use cookies"
    r"|accept cookies|enable javascript|subscribe to our|sign up for our|powered by|lorem ipsum|licen[sc]ed under"
    r"|released under the|click here|read more about|follow us on"
)
PUNCTUATION_RULES = (SYMBOL_RUNS, SHOUT_RUNS)
NAVIGATION_RULES = (SEPARATORS, MENU)
BOILERPLATE_RULES = (BOILERPLATE,)


def line_fails(line: Column) -> Column:
    """True for a line that a rule removes.

    Punctuation: a line of fewer than 30 words that does not end a sentence, or runs of symbols or of exclamation
    marks. Navigation: four or more parts between separators, or nothing but menu entries. Boilerplate: notices.
    """
    unfinished = ~line.rlike(ENDS_SENTENCE) & ~line.rlike(LONG_LINE)
    fails = unfinished
    for rule in (*PUNCTUATION_RULES, *NAVIGATION_RULES, *BOILERPLATE_RULES):
        fails = fails | line.rlike(rule)
    return fails


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 10,
    max_repeated: int = 20,
    max_loss: float = 0.5,
) -> DataFrame:
    """One row per document: identifier, clean_text, the base counts, n_kept_words, base_failed and kept.

    ``max_repeated`` is the percentage of words that may lie in five-word windows found twice or more.
    """
    text, words, grams, ranked = (F.col(c) for c in ("text", "words", "grams", "ranked"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    base = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).select(
        "id", "text", words_of(text).alias("words"), lines.alias("lines")
    )
    # One hash per window; the positions are only sorted where some hash occurs twice.
    hashed = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = base.select(
        "id", "text", "lines", F.size(words).cast("long").alias("n_words"), hashed.alias("grams")
    )
    repeated = F.size(F.array_distinct(grams)) < F.size(grams)
    placed = counted.select(
        "id", "text", "lines", "n_words",
        F.when(repeated, F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("ranked"),
    )
    twice = F.transform(
        ranked,
        lambda x, i: F.when(
            (F.get(ranked, i - 1)["h"] == x["h"]) | (F.get(ranked, i + 1)["h"] == x["h"]), x["p"]
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        F.col("starts"),
        start,
        lambda acc, p: F.struct(
            (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum"), p.alias("last")
        ),
    )["sum"]
    kept_lines = F.filter(F.col("lines"), lambda x: ~line_fails(x))
    measured = placed.select(
        "id", "text", "lines", "n_words", F.sort_array(F.filter(twice, lambda p: p.isNotNull())).alias("starts")
    ).select(
        "id", "n_words",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.array_join(kept_lines, "\n").alias("clean_text"),
    )
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    lost = F.col("n_words") - F.col("n_kept_words")
    return (
        measured.withColumn("n_kept_words", word_count(F.col("clean_text")))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~base_failed & (lost <= max_loss * F.col("n_words")))
        .withColumnRenamed("id", id_col)
    )
