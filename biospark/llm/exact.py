"""Exact deduplication by sorting whole texts.

Sampled splitters (Spark's range partitioning) deal the texts out by their first bytes and a content
hash, each partition is sorted externally by whole text, and neighbours with equal texts form a run.
Within a run the row with the largest (or smallest) identifier stays.

A text that holds more rows than an average partition is dealt to several partitions by a slot that
depends on the identifier; what its slots have in common (identifier to keep, number of rows) comes from
an aggregation that is combined before its shuffle. There are fewer such texts than partitions, which
bounds the two broadcasts.

Defined cases: a null text counts as empty; rows that repeat a text and an identifier are separate rows of
which one at most stays; a null identifier stays only if its group has no other; an empty table gives
an empty result. Input columns may have any names: they travel inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biospark.llm.words import partitions_of
from biospark.session import stage

# Bytes of a text in a splitter; longer equal beginnings are told apart by the content hash.
PREFIX_BYTES = 24


def _judged(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise, rest: Column) -> DataFrame:
    """id, text, rest, keep_id, group_size, kept, text_sha256 for every row."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    parts = partitions_of(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("given"), rest.alias("rest"),
        (normalise(text) if normalise else text).alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    fair = max(1, rows.count() // parts)
    hot = rows.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > fair)
    hot = F.broadcast(stage(hot.select("hash", F.ceil(F.col("n") / fair).cast("long").alias("slots"))))

    dealt = (
        rows.join(hot, "hash", "left")
        .withColumn("slots", F.coalesce("slots", F.lit(1)))
        .withColumn("slot", F.pmod(F.xxhash64("id", F.lit(7)), F.col("slots")))
        .withColumn("prefix", F.substring(F.col("text").cast("binary"), 1, PREFIX_BYTES))
        .repartitionByRange(parts, "prefix", "hash", "slot")
    )
    order = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    run = Window.partitionBy("prefix", "hash", "slot", "text")
    sorted_run = run.orderBy(order)
    local = dealt.select(
        "id", "given", "rest", "hash", "slots",
        F.row_number().over(sorted_run).alias("place"),
        F.first("id").over(sorted_run).alias("local_keep"),
        F.count("*").over(run).alias("local_size"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )

    best = F.max("id") if keep == "largest" else F.min("id")
    whole = (
        rows.join(hot, "hash")
        .groupBy("hash", "text")
        .agg(best.alias("whole_keep"), F.count("*").alias("whole_size"))
        .select(
            F.col("hash").alias("whole_hash"), F.sha2(F.col("text").cast("binary"), 256).alias("whole_sha256"),
            "whole_keep", "whole_size",
        )
    )
    joined = local.join(
        F.broadcast(whole),
        (F.col("slots") > 1) & (F.col("hash") == F.col("whole_hash")) & (F.col("text_sha256") == F.col("whole_sha256")),
        "left",
    )
    keep_id = F.when(F.col("slots") > 1, F.col("whole_keep")).otherwise(F.col("local_keep"))
    return joined.select(
        "id", "given", "rest",
        keep_id.alias("keep_id"),
        F.coalesce("whole_size", "local_size").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise=None
) -> DataFrame:
    """One row per row of ``docs``: identifier, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to the column that is compared; by default texts are equal when
    they are identical.
    """
    judged = _judged(docs, id_col, text_col, keep, normalise, F.lit(None))
    return judged.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise=None
) -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    kept = _judged(docs, id_col, text_col, keep, normalise, rest).filter("kept")
    place = {id_col: F.col("id"), text_col: F.col("given")} | {c: F.col("rest").getField(c) for c in others}
    return kept.select(*[place[c].alias(c) for c in docs.columns])
