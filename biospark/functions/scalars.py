"""Scalar column expressions and option parsing."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biospark.contracts import LABEL_CLASSES, OTHER_LABEL, UNKNOWN


def duration_micros(text: str | None) -> int | None:
    """``'5s'``, ``'30 min'``, ``'1 hour'`` as microseconds; None or empty means no limit."""
    if not text:
        return None
    micros = int(pd.Timedelta(re.sub(r"\s+", " ", text.strip())).value // 1000)
    if micros <= 0:
        raise ValueError(f"duration must be positive: {text!r}")
    return micros


def label_class(label: Column) -> Column:
    """Raw label in any letter case to one of the four classes."""
    pairs = [F.lit(x) for pair in LABEL_CLASSES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.lower(label.cast("string"))], F.lit(OTHER_LABEL))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null throughout: turn NaN into null in every floating column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def window_id(subject: Column, start: Column, size: int) -> Column:
    """``subject_start_end`` with six-digit positions (longer numbers are kept whole)."""
    return F.format_string("%s_%06d_%06d", subject, start, start + F.lit(size))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    """Length of the acceleration vector; null when an axis is null."""
    return F.sqrt(x * x + y * y + z * z)


def file_stem(name: Column) -> Column:
    """File name up to the first dot."""
    return F.split(name, r"\.", 2)[0]


def subject_from_file(name: Column) -> Column:
    """First ``f`` + digits in a file name, else ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(f\d+)", 1), F.lit("")), F.lit(UNKNOWN))


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns], F.lit(False))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]
