"""What a word is, the same for column expressions and for Python code inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biospark.session import ship_package

# White space between words: the six ASCII characters, in the notation that Java and DuckDB share.
GAP_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
WORD = WORD_CLASS + "+"

_GAP = re.compile(rb"[\x20\x09-\x0D]")
# Bytes of text that are split into a Python list at once.
CHUNK = 1 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words (long); 0 for null."""
    return F.coalesce(F.size(words_of(text)), F.lit(0)).cast("long")


def whole_text(column: str = "text") -> Column:
    """The text as a string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_chunks(data: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``size`` bytes, so that a very long text needs no list of all its words.

    ``bytes.split`` splits at the six ASCII white space characters and at nothing else.
    """
    start = 0
    while start < len(data):
        cut = _GAP.search(data, start + size) if len(data) - start > size else None
        end = cut.start() if cut else len(data)
        if words := data[start:end].split():
            yield words
        start = end


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions_of(df: DataFrame) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
