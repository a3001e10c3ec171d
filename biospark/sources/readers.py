"""Read recordings and feature tables."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biospark.contracts import CONTRACT, SOURCE_COLUMNS, UNKNOWN
from biospark.functions.scalars import file_stem, nan_to_null, subject_from_file
from biospark.operators.harmonize import harmonize_columns, pair_modalities, with_dataset

# Name parts that mark the two modalities of a recording directory.
ECG_FILES = "*[eE][cC][gG]*.csv"
EDA_FILES = "*[eE][dD][aA]*.csv"
MODALITY = r"[_\-. ]*(?i:ecg|eda)[_\-. ]*"


# Types of the columns that the contract or a source names; other columns of a CSV file are inferred.
KNOWN_TYPES = {f.name: f.dataType for f in CONTRACT.fields}
KNOWN_TYPES |= {raw: KNOWN_TYPES[name] for names in SOURCE_COLUMNS.values() for raw, name in names.items()}


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, file_name: str | None = None
) -> DataFrame:
    """CSV with a header for ``.csv`` paths, otherwise Parquet; ``file_name`` names a column for the file's name."""
    if path.lower().rstrip("/").endswith(".csv"):
        return read_csv(spark, path, schema, file_name=file_name)
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if file_name is None else with_file_name(df, file_name)


def header_groups(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> list[tuple[list[str], list[str]]]:
    """(columns, files) for each header that occurs in the CSV files under ``path``.

    The headers are found in one scan of the lines, without parsing; a file's first line is the first row of the
    split that starts it. Only file names and headers reach the driver, which lists the files anyway.
    """
    reader = spark.read if pattern is None else spark.read.option("pathGlobFilter", pattern)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value"
    )
    first = lines.filter("at = 0").groupBy("file").agg(F.first("value").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        groups.setdefault(row["header"].removeprefix("\ufeff").rstrip("\r"), []).append(unquote(row["file"]))
    return [(next(csv.reader([header])), files) for header, files in groups.items()]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    pattern: str | None = None,
    file_name: str | None = None,
) -> DataFrame:
    """Headered CSV files as one table, their columns matched by name.

    Files with different headers are read separately and united by name; a column that a file lacks is null
    there. Types come from ``schema``, else from the contract and the source maps. Only columns that
    neither names are inferred, which reads the files a second time. No files give an error.
    """
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = KNOWN_TYPES if given is None else {f.name: f.dataType for f in given.fields}
    parts = []
    for columns, files in header_groups(spark, path, pattern):
        missing = [c for c in columns if c not in types]
        if given is not None:
            inferred = dict.fromkeys(missing, T.StringType())
        elif missing:
            seen = spark.read.option("header", True).option("inferSchema", True).csv(files)
            inferred = {f.name: f.dataType for f in seen.schema.fields}
        else:
            inferred = {}
        own = T.StructType([T.StructField(c, types.get(c) or inferred.get(c, T.StringType())) for c in columns])
        # A header that disagrees with the schema is an error, never a column read by its position.
        df = spark.read.option("header", True).option("enforceSchema", False).schema(own).csv(files)
        parts.append(df if file_name is None else with_file_name(df, file_name))
    if not parts:
        raise FileNotFoundError(f"No CSV file with a header matches {path}" + (f" ({pattern})" if pattern else ""))
    united = _common_types(parts)
    table = united[0]
    for part in united[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    if given is None:
        return table
    kept = [F.col(f.name) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in given.fields]
    return table.select(*kept, *([file_name] if file_name else []))


def _common_types(parts: list[DataFrame]) -> list[DataFrame]:
    """The parts with columns whose inferred types differ as doubles where all are numbers, else as text."""
    kinds: dict[str, set] = {}
    for part in parts:
        for f in part.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType)
    mixed = {c: "double" if all(isinstance(k, T.NumericType) for k in ks) else "string" for c, ks in kinds.items() if len(ks) > 1}
    return [p.withColumns({c: F.col(c).cast(t) for c, t in mixed.items() if c in p.columns}) for p in parts]


def with_file_name(df: DataFrame, name: str = "__file") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_name"))


def load_hongn_data(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    subject: str | None = None,
    subject_prefix: str | None = "f",
) -> DataFrame:
    """First source: contract columns of the subjects whose name begins with ``subject_prefix`` (None: of all).

    The subject comes from a ``subject`` column, else ``subject_id``, else the file name. ``rows_by_prefix``
    counts what the prefix leaves out.
    """
    df = _with_subject(read_table(spark, path, schema, "__file"), ("subject", "subject_id"), subject)
    if subject_prefix is not None:
        df = df.filter(F.col("subject").startswith(subject_prefix))
    return with_dataset(harmonize_columns(df, "hongn"), "hongn")


def rows_by_prefix(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, subject_prefix: str = "f"
) -> DataFrame:
    """One row: how many rows of the first source the loader's prefix keeps and leaves out."""
    df = _with_subject(read_table(spark, path, schema, "__file"), ("subject", "subject_id"), None)
    kept = F.coalesce(F.col("subject").startswith(subject_prefix), F.lit(False))
    return df.agg(F.count(F.when(kept, 1)).alias("kept_rows"), F.count(F.when(~kept, 1)).alias("left_out_rows"))


def load_swell_data(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Second source: contract columns of all subjects."""
    df = _with_subject(read_table(spark, path, schema, "__file"), ("subject", "participant_id"), None)
    return with_dataset(harmonize_columns(df, "swell"), "swell")


def load_wesad_data(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, subject: str | None = None
) -> DataFrame:
    """Third source, which has no subject column of its own."""
    df = _with_subject(read_table(spark, path, schema, "__file"), ("subject",), subject, F.split("__file", r"\.")[0])
    return with_dataset(harmonize_columns(df, "wesad"), "wesad")


def _with_subject(df: DataFrame, candidates: tuple[str, ...], given: str | None, from_file=None) -> DataFrame:
    found = next((c for c in candidates if c in df.columns), None)
    if given is not None:
        value = F.lit(given)
    elif found:
        value = F.col(found).cast("string")
    else:
        value = subject_from_file(F.col("__file")) if from_file is None else F.coalesce(from_file, F.lit(UNKNOWN))
    others = [c for c in df.columns if c not in {*candidates, "__file"}]
    return df.select(*others, value.alias("subject"))


def read_recordings(spark: SparkSession, directory: str, pattern: str, schema=None) -> DataFrame | None:
    """All files of one modality in a directory as one table with a ``subject`` column; None without such files.

    The subject is the file name up to the first dot, less the modality. A folder that does not exist and files
    without a ``timestamp`` column are errors, not missing recordings.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select("path")
    if listed.isEmpty():
        return None
    df = read_csv(spark, directory, schema, pattern, "__file")
    untimed = [files for columns, files in header_groups(spark, directory, pattern) if "timestamp" not in columns]
    if untimed:
        raise ValueError(f"No column 'timestamp' in {untimed[0][:3]}")
    stem = F.regexp_replace(file_stem(F.col("__file")), MODALITY, "")
    df = df.withColumn("subject", F.when(stem != "", stem).otherwise(F.lit(UNKNOWN))).drop("__file")
    return nan_to_null(df.withColumn("timestamp", F.col("timestamp").cast("timestamp")))


def extract_swell(spark: SparkSession, directory: str, ecg_schema=None, eda_schema=None) -> DataFrame | None:
    """ECG and EDA files of a directory joined per subject on exact timestamps."""
    ecg = read_recordings(spark, directory, ECG_FILES, ecg_schema)
    if ecg is None:
        return None
    eda = read_recordings(spark, directory, EDA_FILES, eda_schema)
    return ecg.na.drop("any") if eda is None else pair_modalities(ecg, eda)


def extract_wesad(bvp: DataFrame, temp: DataFrame, label: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Wrist tables (timestamp and value each) as rows of timestamp, hr, temp, label.

    The pulse signal becomes its one-second mean; only instants present in all three tables stay.
    """
    keys = list(keys)
    second = F.window("timestamp", "1 second").start
    hr = (
        bvp.filter(F.col("timestamp").isNotNull())
        .groupBy(*keys, second.alias("timestamp"))
        .agg(F.avg("hr").alias("hr"))
    )
    on = [*keys, "timestamp"]
    return (
        hr.join(temp.select(*on, "temp"), on).join(label.select(*on, "label"), on)
        .select(*on, "hr", "temp", "label")
        .na.drop("any")
    )


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, test) of a stored window table; val may have no rows, train and test must have some."""
    table = spark.read.parquet(path)
    train, val, test = (table.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test"))
    for name, part in (("train", train), ("test", test)):
        if part.isEmpty():
            raise ValueError(f"No {name} split in {path}")
    return train, val, test


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
