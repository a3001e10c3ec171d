"""Ordered computations over long series without ever holding a whole series in one task.

A series (one subject, one class, or the whole table) may be a large part of all rows. Each
function therefore works on (series, bucket) groups, where a bucket is a short stretch of the
order, and passes only one small row per bucket from one bucket to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets summed together in the first of the two prefix steps.
FAN_IN = 1024
# Rows that a value range should hold, and the most ranges whose bounds one row can carry.
ROWS_PER_BUCKET = 65536
MOST_BUCKETS = 10_000
# Leading binary digits that tell the bins of whole numbers apart.
VALUE_BITS = 12


def hash_bucket(text: Column, hex_digits: int = 3) -> Column:
    """Order-preserving bucket of an md5 text: its first digits as a number."""
    return F.conv(F.substring(text, 1, hex_digits), 16, 10).cast("long")


def time_bucket(ts: Column, width_us: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(width_us)).cast("long")


def bucket_offsets(totals: DataFrame, keys: list[str], bucket: str, sums: list[str]) -> DataFrame:
    """Sum of all earlier buckets of the same key, for one row per (key, bucket).

    Two steps, so that a key with very many buckets is not sorted row by row in one task: FAN_IN
    neighbouring buckets are packed into one row, the packed rows get their offset, then the buckets
    inside each of them do.
    """
    packed = totals.groupBy(*keys, F.floor(F.col(bucket) / FAN_IN).alias("__group")).agg(
        F.collect_list(F.struct(bucket, *sums)).alias("__buckets"), *[F.sum(s).alias(f"__g_{s}") for s in sums]
    )
    earlier_groups = _partition(keys).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    offset = {f"__g_{s}": F.coalesce(F.sum(f"__g_{s}").over(earlier_groups), F.lit(0)) for s in sums}
    unpacked = packed.withColumns(offset).select(*keys, "__group", *offset, F.inline("__buckets"))
    earlier = Window.partitionBy(*keys, "__group").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return unpacked.select(
        *keys, bucket,
        *[(F.col(f"__g_{s}") + F.coalesce(F.sum(s).over(earlier), F.lit(0))).alias(f"__before_{s}") for s in sums],
    )


def running_sums(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column | str], sums: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums along (bucket, order), restarting for each key.

    ``bucket`` is an integer column that never decreases along the order.
    """
    parts = {f"__part_{name}": expr for name, expr in sums.items()}
    df = df.withColumns(parts)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(p).alias(p) for p in parts])
    offsets = bucket_offsets(totals, keys, bucket, list(parts))
    here = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, [*keys, bucket])
    return joined.withColumns(
        {name: F.col(f"__before___part_{name}") + F.sum(f"__part_{name}").over(here) for name in sums}
    ).drop(*parts, *[f"__before_{p}" for p in parts])


def row_positions(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], name: str = "position"
) -> DataFrame:
    """Add the 0-based row number of each row inside its series."""
    numbered = running_sums(
        df.withColumn("__bucket", bucket), keys, "__bucket", order, {name: F.lit(1).cast("long")}
    )
    return numbered.withColumn(name, F.col(name) - 1).drop("__bucket")


def previous_value(
    df: DataFrame, keys: list[str], bucket: Column, order: str, value: str | None = None, name: str = "previous"
) -> DataFrame:
    """Add ``value`` (by default ``order`` itself) of the preceding row of the series; null in the first row.

    The last value of each bucket is carried to the next one in two steps, like ``bucket_offsets``.
    """
    value = value or order
    df = df.withColumn("__bucket", bucket).repartition(*keys, "__bucket")
    last = df.groupBy(*keys, "__bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("__last"))
    packed = last.groupBy(*keys, F.floor(F.col("__bucket") / FAN_IN).alias("__group")).agg(
        F.collect_list(F.struct("__bucket", "__last")).alias("__buckets"), F.max_by("__last", "__bucket").alias("__end")
    )
    entered = packed.withColumn("__entry", F.lag("__end").over(_partition(keys).orderBy("__group"))).select(
        *keys, "__group", "__entry", F.inline("__buckets")
    )
    inside = Window.partitionBy(*keys, "__group").orderBy("__bucket")
    carried = entered.select(*keys, "__bucket", F.coalesce(F.lag("__last").over(inside), "__entry").alias("__carry"))
    here = Window.partitionBy(*keys, "__bucket").orderBy(order)
    return (
        df.join(carried, [*keys, "__bucket"])
        .withColumn("__row", F.row_number().over(here))
        .withColumn(name, F.when(F.col("__row") == 1, F.col("__carry.v")).otherwise(F.lag(value).over(here)))
        .drop("__bucket", "__carry", "__row")
    )


def quantile_bucket(df: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """Add ``__bucket``: which of about equally full value ranges the row falls in.

    Without ``buckets`` their number follows the number of rows (ROWS_PER_BUCKET each, MOST_BUCKETS at most).
    """
    if buckets is None:
        buckets = max(1, min(MOST_BUCKETS, df.count() // ROWS_PER_BUCKET))
    if buckets == 1:
        return df.withColumn("__bucket", F.lit(0).cast("long"))
    points = F.expr(f"array({', '.join(f'{i / buckets!r}D' for i in range(1, buckets))})")
    bounds = df.agg(F.percentile_approx(value, points, F.lit(10 * buckets)).alias("b")).scalar()
    bounded = df.withColumn("__bounds", bounds)

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        below = F.get("__bounds", middle) < F.col(value)
        return (
            F.when(at["low"] >= at["high"], at)
            .when(below, F.struct((middle + 1).alias("low"), at["high"].alias("high")))
            .otherwise(F.struct(at["low"].alias("low"), middle.alias("high")))
        )

    # Binary search for the number of bounds below the value.
    steps = F.array(*[F.lit(0)] * buckets.bit_length())
    start = F.struct(F.lit(0).alias("low"), F.coalesce(F.size("__bounds"), F.lit(0)).alias("high"))
    return bounded.withColumn("__bucket", F.aggregate(steps, start, halve)["low"].cast("long")).drop("__bounds")


def median_of_counts(counted: DataFrame, keys: list[str], value: str, copies: str, name: str = "median") -> DataFrame:
    """Exact median per key of non-negative whole numbers, given as rows (key, value) with their number of ``copies``.

    Values are dealt to fixed bins that get wider with the value, VALUE_BITS leading binary digits each. A key has some
    2^VALUE_BITS bins for every doubling at most, and a bin of numbers of b digits 2^(b - VALUE_BITS) values, so both the
    ranking of bins and that of the values in the middle ones are bounded, however many rows there are.
    """
    digits = F.length(F.bin(F.col(value)))
    dropped = F.greatest(digits - VALUE_BITS, F.lit(0)).cast("int")
    leading = F.call_function("shiftright", F.col(value).cast("long"), dropped)
    binned = counted.filter(F.col(value).isNotNull()).withColumn(
        "__bin", F.shiftleft(dropped.cast("long"), VALUE_BITS) + leading
    )
    sizes = binned.groupBy(*keys, "__bin").agg(F.sum(copies).alias("__size"))
    upto = _partition(keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = sizes.withColumns({"__end": F.sum("__size").over(upto), "__total": F.sum("__size").over(_partition(keys))})
    lower, upper = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    ends = ends.withColumn("__before", F.col("__end") - F.col("__size"))
    middle = ends.filter((F.col("__before") <= upper) & (F.col("__end") > lower))
    middle = middle.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bin").alias("__b"), "__before", "__total")
    on = F.col("__bin") == F.col("__b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    inside = Window.partitionBy(*keys, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.join(middle, on).withColumn("__upto", F.col("__before") + F.sum(copies).over(inside))
    least = [F.min(F.when(F.col("__upto") > rank, F.col(value))) for rank in (lower, upper)]
    return ranked.groupBy(*keys).agg(((least[0] + least[1]) / 2).alias(name))


def _partition(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
