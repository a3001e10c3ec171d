"""Mixing sources to target weights with fixed-length blocks.

1. The words of a source are one stream, documents in a pseudorandom order; block i is words [i B, (i + 1) B).
2. Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words by weight;
   a target stops at ``max_epochs`` times the source's words and the excess is shared by weight again.
3. The output is shards of K slots. A shard's source counts are drawn from a multinomial distribution with
   the targets as probabilities: the whole part of K p is given to each source, the remaining slots are
   drawn one by one from the fractions, which has the same means and a smaller spread.
4. The j-th slot of a source takes block perm(j mod N) of pass j div N, where N is the number of its blocks and perm
   a pseudorandom permutation of 0..N-1 (swap-or-not rounds) that depends on seed, source and pass.
5. Slots and the pieces of documents that lie in a block are joined by (source, block).

A slot whose source has no block left in its last allowed pass stays empty, so no document is used more than
``max_epochs`` times. All draws are hashes of seed and position: reruns agree.

A source of any size is cut into blocks and buckets of documents, so none is gathered. What is kept per source
(its words, target and fractions) is one row; one window orders these rows. The only broadcast is the
layout of one shard, of K rows.

Defined cases: a null text has no words; a null source is a source of its own; rows that repeat are
separate documents; without any word targets are 0 and nothing is taken; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biospark.llm.words import GAP_CLASS, WORD, whole_text, word_count
from biospark.operators.ordered import row_positions, running_sums
from biospark.session import stage

# Documents of a source are summed in buckets of about this many rows.
BUCKET_ROWS = 1024
# Cells of [0, 1) that narrow the search for the fraction that a draw falls in.
CELLS = 1024
ROUNDS = 12


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_epochs: int = 3
    block_words: int = 64
    shard_slots: int = 1024
    seed: int = 42


def source_targets(sized: DataFrame, options: MixOptions) -> DataFrame:
    """One row per source: source, sid (its position), source_size, blocks, target (words)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in options.weights])
    named = totals.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weighed = named.withColumn("weight", F.get(cycle, F.pmod(F.col("sid") - 1, F.lit(len(options.weights))).cast("int")))
    # Sources reach their ceiling in the order of ceiling / weight; the rest shares what is left by weight.
    weighed = weighed.withColumn("cap", F.col("source_size") * float(options.max_epochs))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighed.withColumn("level", level)
    # The level rises up to the first source that its ceiling does not hold back, and falls after it.
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    leveled = leveled.withColumn("level", F.coalesce(F.max(free).over(everything), F.lit(float("inf"))))
    return leveled.select(
        "source", "sid", "source_size",
        F.ceil(F.col("source_size") / options.block_words).cast("long").alias("blocks"),
        F.least("cap", F.col("level") * F.col("weight")).cast("double").alias("target"),
    )


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def permuted(index: Column, size: Column, *keys: Column) -> Column:
    """The image of ``index`` in 0..size-1 under a permutation that ``keys`` choose.

    Swap-or-not: in each round x and its mirror image (r - x) mod size change places or not, as a hash
    of the larger one says. Every round is its own inverse, whatever the size.
    """

    def turn(x: Column, k: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*keys, k), size) - x, size)
        swap = F.xxhash64(*keys, k + ROUNDS, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), index, turn)


def _shares(sources: DataFrame, slots: int, name: str) -> DataFrame:
    """For shards of ``slots`` slots: per source the whole slots, where they start, and its part of [0, 1)."""
    everything = Window.partitionBy(F.lit(0))
    in_order = everything.orderBy("sid")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    exact = sources.withColumn("x", F.col("p") * slots)
    exact = exact.withColumn("whole", F.floor(F.col("x") + 1e-9).cast("long"))
    exact = exact.withColumn("fraction", F.greatest(F.col("x") - F.col("whole"), F.lit(0.0)))
    total = F.sum("fraction").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    low = F.coalesce(F.sum("fraction").over(before), F.lit(0.0)) / F.when(total > 0, total)
    exact = exact.withColumn("low", F.coalesce(low, F.lit(0.0))).withColumn("open", F.coalesce(total, F.lit(0.0)) > 0)
    return exact.select(
        F.lit(name).alias("kind"), "sid", "whole",
        F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("first"), "low",
        # Each part ends where the next one starts, so every draw falls in exactly one.
        F.when(F.col("open"), F.lead("low", 1, 1.0).over(in_order)).otherwise(F.col("low")).alias("high"),
    )


def slots_of(sources: DataFrame, options: MixOptions) -> DataFrame:
    """One row per filled slot: shard, slot, sid, epoch, block. ``sources`` is stored."""
    spark = sources.sparkSession
    # Slots that a source needs on average; its last block may be short.
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0)
    sources = sources.withColumn("wanted", wanted)
    # Summed in a fixed order, as the last digits decide draws.
    in_order = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = sources.select(F.sum("wanted").over(in_order).alias("n")).first()
    needed = first["n"] if first else 0.0
    total, k = round(needed), options.shard_slots
    full = total // k
    rest = total - full * k
    sources = sources.withColumn("p", F.col("wanted") / max(needed, 1e-300))
    shares = _shares(sources, k, "full").union(_shares(sources, rest, "rest")).filter("whole > 0 or high > low")
    shares = stage(shares)
    base = shares.groupBy("sid").agg(
        F.sum(F.col("whole") * F.when(F.col("kind") == "full", F.lit(full)).otherwise(F.lit(1))).alias("base")
    )
    limits = stage(sources.join(base, "sid").select("sid", "blocks", "base"))

    layout = shares.select("kind", "sid", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("i"), "first")
    layout = layout.filter("i < whole").select("kind", (F.col("first") + F.col("i")).cast("long").alias("slot"), "sid", "i", "whole")
    slots = spark.range(total).select(
        F.floor(F.col("id") / k).cast("long").alias("shard"), F.pmod("id", F.lit(k)).alias("slot")
    ).withColumn("kind", F.when(F.col("shard") < full, "full").otherwise("rest"))
    # At most 2 K rows, whatever the input.
    given = slots.join(F.broadcast(layout), ["kind", "slot"], "left")
    # In the shards before, each full, a source has had whole slots of its own; those of the last shard follow.
    per_full = shares.filter("kind = 'full'").select("sid", F.col("whole").alias("per_full"))
    fixed = (
        given.filter("sid is not null")
        .join(per_full, "sid", "left")
        .withColumn("j", F.col("shard") * F.coalesce("per_full", F.lit(0)) + F.col("i"))
        .select("shard", "slot", "sid", "j")
    )
    drawn = given.filter("sid is null").select(
        "kind", "shard", "slot", _uniform(F.lit(options.seed), F.col("shard"), F.col("slot")).alias("u")
    ).withColumn("cell", F.floor(F.col("u") * CELLS).cast("long"))
    low, high = F.col("low"), F.col("high")
    parts = shares.filter("high > low").withColumn(
        "cell", F.explode(F.sequence(F.floor(low * CELLS).cast("long"), F.least(F.floor(high * CELLS), F.lit(CELLS - 1)).cast("long")))
    )
    picked = drawn.join(parts, ["kind", "cell"]).filter((F.col("u") >= low) & (F.col("u") < high))
    ranked = row_positions(
        stage(picked.select("shard", "slot", "sid")), ["sid"], F.floor(F.col("shard") / BUCKET_ROWS).cast("long"), ["shard", "slot"]
    )
    extra = ranked.join(limits.select("sid", "base"), "sid").select(
        "shard", "slot", "sid", (F.col("base") + F.col("position")).alias("j")
    )
    placed = (
        fixed.union(extra)
        .join(limits.select("sid", "blocks"), "sid")
        .filter(F.col("j") < options.max_epochs * F.col("blocks"))
        .withColumn("epoch", F.floor(F.col("j") / F.col("blocks")).cast("long"))
        .withColumn("turn", F.pmod("j", F.col("blocks")))
    )
    block = permuted(F.col("turn"), F.col("blocks"), F.lit(options.seed), F.col("sid"), F.col("epoch"))
    return placed.select("shard", "slot", "sid", "epoch", block.alias("block"))


def pieces_of(sized: DataFrame, sources: DataFrame, options: MixOptions) -> DataFrame:
    """One row per document and block it touches: rid, sid, block, first and last word (exclusive) in the document."""
    b = options.block_words
    rows = sized.filter("size > 0").join(
        sources.select(F.col("source").alias("s"), "sid"), F.col("source").eqNullSafe(F.col("s"))
    ).withColumn("key", F.xxhash64("doc_id", F.lit(options.seed)))
    bits = max(0, (sized.count() // BUCKET_ROWS).bit_length())
    bucket = F.shiftright(F.col("key"), 64 - bits) if bits else F.lit(0).cast("long")
    running = running_sums(
        rows.select("rid", "size", "sid", "key", bucket.cast("long").alias("bucket")),
        ["sid"], "bucket", ["key", "rid"], {"end": F.col("size")},
    )
    at = running.withColumn("start", F.col("end") - F.col("size"))
    block = F.explode(F.sequence(F.floor(F.col("start") / b).cast("long"), F.floor((F.col("end") - 1) / b).cast("long")))
    return at.withColumn("block", block).select(
        "rid", "sid", "block",
        (F.greatest("start", F.col("block") * b) - F.col("start")).alias("from_word"),
        (F.least("end", (F.col("block") + 1) * b) - F.col("start")).alias("to_word"),
    )


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Stored: rid (one per row), doc_id, source, size."""
    return stage(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        )
    )


def mix_report(docs: DataFrame, options: MixOptions = MixOptions(), **columns: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words the mix takes)."""
    sized = sized_documents(docs, **columns)
    sources = stage(source_targets(sized, options))
    # How often a block is used; each pass uses it once at most.
    used = slots_of(sources, options).groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = (
        pieces_of(sized, sources, options)
        .join(used, ["sid", "block"])
        .groupBy("rid")
        .agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken"))
    )
    named = sources.select(F.col("source").alias("s"), "source_size", "target")
    return (
        sized.join(taken, "rid", "left")
        .join(named, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


def mixed_spans(docs: DataFrame, options: MixOptions = MixOptions(), **columns: str) -> tuple[DataFrame, DataFrame]:
    """The sized documents, and one row per slot and piece: shard, slot, epoch, rid, from_word, to_word."""
    sized = sized_documents(docs, **columns)
    sources = stage(source_targets(sized, options))
    spans = pieces_of(sized, sources, options).join(slots_of(sources, options), ["sid", "block"])
    return sized, spans.select("shard", "slot", "epoch", "rid", "from_word", "to_word")


def mixed_documents(docs: DataFrame, options: MixOptions = MixOptions(), **columns: str) -> DataFrame:
    """The mix as documents: for each document and pass in which it is used one row with all columns of ``docs``.

    Its text is the words taken in that pass, in their order, with the white space that follows each;
    ``n_chars``, if there is such a column, is counted anew.
    """
    text_col = columns.get("text_col", "text")
    kept = stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    flat = kept.select(
        "rid", *[F.col("doc").getField(columns.get(k, d)).alias(d) for k, d in (("id_col", "doc_id"), ("source_col", "source"))],
        word_count(F.col("doc").getField(text_col)).alias("size"),
    )
    sized = stage(flat)
    sources = stage(source_targets(sized, options))
    spans = pieces_of(sized, sources, options).join(slots_of(sources, options), ["sid", "block"])
    copies = spans.groupBy("rid", "epoch").agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("spans"))
    places = F.flatten(
        F.transform("spans", lambda s: F.sequence(s["from_word"].cast("int"), s["to_word"].cast("int") - 1))
    )
    word_with_gap = F.lit(f"{WORD}{GAP_CLASS}*")
    cut = (
        kept.join(copies, "rid")
        .select("doc", "spans", F.regexp_extract_all(F.col("doc").getField(text_col), word_with_gap, F.lit(0)).alias("words"))
        .select(
            "doc",
            # Word by word: a slice would copy all words for every span. The words are named twice, so that Spark keeps them as
            # a column instead of splitting the text for every word.
            F.when(
                F.size("words") > 0,
                F.array_join(F.transform(places, lambda i: F.get(F.col("words"), i)), ""),
            ).alias("mixed"),
        )
    )
    out = {c: F.col("doc").getField(c) for c in docs.columns} | {text_col: F.col("mixed")}
    if "n_chars" in out:
        out["n_chars"] = F.length("mixed").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[out[c].alias(c) for c in docs.columns])
