"""Alignment of recordings to a regular grid with bounded gap filling.

Plan of ``align_to_grid``: one shuffle of the samples, made before they become dense, no join
and no broadcast.

1. Per series: first and last instant (partial aggregation), turned into one marker row per
   chunk, a chunk being a fixed stretch of absolute time.
2. Samples go to the chunk of their instant. Those within ``limit`` grid steps of a chunk border
   go to both chunks, which is all that a fillable run can see. Samples and markers
   meet in one shuffle by (series, chunk), where the marker hands the grid anchor to the samples.
3. Within (series, chunk): samples off the grid drop out, previous and next known sample per column,
   then ``explode`` to the dense positions and plain arithmetic.

A chunk spans a fixed number of grid points, so the longest recording is spread like all others.
Values that must travel further than a chunk border (text, or numbers without a gap limit) are
reduced to one row per chunk and carried on the marker rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biospark.contracts import series_keys
from biospark.functions.scalars import duration_micros, micros, nan_to_null, numeric_columns, text_columns

METHODS = ("linear", "forward", "backward")
DUPLICATE_POLICIES = ("reject_subject", "error", "first", "unchecked")
CHUNK_POSITIONS = 8192
# Rows that one task sorts or groups after the grid has become dense.
ROWS_PER_TASK = 262_144


@dataclass(frozen=True)
class GridOptions:
    """How to align: key columns, grid step, fill method, gap limit, duplicate policy."""

    keys: tuple[str, ...] | None = None
    timestamp: str = "timestamp"
    step: str = "1s"
    method: str = "linear"
    max_gap: str | None = "5s"
    on_duplicate: str = "reject_subject"
    tie_breaker: str | None = None
    grid: str = "exact"
    chunk: int = CHUNK_POSITIONS

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"Unknown fill method: {self.method}")
        if self.on_duplicate not in DUPLICATE_POLICIES:
            raise ValueError(f"Unknown duplicate policy: {self.on_duplicate}")
        if self.grid not in ("exact", "bucket_mean"):
            raise ValueError(f"Unknown grid: {self.grid}")
        if self.on_duplicate == "first" and not self.tie_breaker:
            raise ValueError("on_duplicate='first' needs a tie_breaker column")

    @property
    def step_us(self) -> int:
        return duration_micros(self.step)

    @property
    def limit(self) -> int | None:
        """Longest run of missing grid points that is filled."""
        gap = duration_micros(self.max_gap)
        return None if gap is None else gap // self.step_us


def align_to_1hz(
    df: DataFrame, timestamp_col: str = "timestamp", method: str = "linear", max_gap: str | None = "5s", **options
) -> DataFrame:
    """Each recording on its own 1 Hz grid, anchored on its first sample."""
    return align_to_grid(df, GridOptions(timestamp=timestamp_col, method=method, max_gap=max_gap, **options))


def align_to_grid(df: DataFrame, options: GridOptions = GridOptions()) -> DataFrame:
    """Each recording on a regular grid; output columns are those of ``df``."""
    return dense_chunks(df, options, size=options.chunk).select(*df.columns)


def duplicate_subjects(df: DataFrame, keys: list[str] | None = None, timestamp: str = "timestamp") -> DataFrame:
    """Series that hold an instant twice, with the reason: the ones the aligner leaves out."""
    keys = keys or series_keys(df.columns)
    per_instant = _usable(df, keys, timestamp).groupBy(*keys, timestamp).agg(F.count("*").alias("__n"))
    return (
        per_instant.groupBy(*keys)
        .agg(F.count(F.when(F.col("__n") > 1, 1)).alias("duplicate_instants"))
        .filter("duplicate_instants > 0")
        .withColumn("reason", F.lit("duplicate timestamp"))
    )


def tumbling_mean(df: DataFrame, keys: list[str], timestamp: str, width: str) -> DataFrame:
    """Mean of every numeric column per tumbling time bucket; the most frequent text per bucket."""
    us = F.lit(duration_micros(width))
    start = F.timestamp_micros(F.floor(micros(F.col(timestamp)) / us).cast("long") * us)
    means = [F.avg(c).alias(c) for c in numeric_columns(df) if c not in keys]
    texts = [F.mode(F.col(c), True).alias(c) for c in text_columns(df) if c not in keys]
    grouped = df.filter(F.col(timestamp).isNotNull()).withColumn("__start", start).groupBy(*keys, "__start")
    return grouped.agg(*means, *texts).withColumnRenamed("__start", timestamp)


def dense_chunks(
    df: DataFrame, options: GridOptions, size: int, overlap: int = 0, copies: int | None = None
) -> DataFrame:
    """Dense, filled rows by chunk: the columns of ``df`` plus ``__chunk`` and positions.

    A chunk holds the grid points of ``size`` steps of time and of ``overlap`` further steps, so
    rows in the overlap belong to both neighbours. ``__pos`` counts grid points from the start of the
    series; ``__own_first`` and ``__own_last`` bound the chunk without its overlap. Rows stay
    partitioned by (keys, ``__chunk``).

    ``copies`` is for callers that sort or group the dense rows: how many rows they make of each. Spark sizes the
    partitions of a shuffle by its bytes, here those of the sparse samples; with ``copies`` their number follows the grid
    points instead, which a job of its own counts first, so that a task's rows do not grow with the table.
    """
    ts = options.timestamp
    if ts not in df.columns:
        raise ValueError(f"Timestamp column '{ts}' not found")
    df = nan_to_null(df)
    columns = df.columns
    keys = list(options.keys) if options.keys is not None else series_keys(columns)
    series = keys or ["__series"]
    df = df if keys else df.withColumn("__series", F.lit(0))
    if options.grid == "bucket_mean":
        known = {ts, *keys, *numeric_columns(df), *text_columns(df)}
        if others := [c for c in columns if c not in known]:
            raise ValueError(f"grid='bucket_mean' has no mean for columns {others}, which are neither numbers nor text")
        df = tumbling_mean(df, series, ts, options.step).select(*columns, *([] if keys else series))

    values = [c for c in columns if c not in {ts, *keys}]
    # A tie breaker is an identifier: grid points without a sample have none.
    numeric = [c for c in numeric_columns(df) if c in values and c != options.tie_breaker]
    text = [c for c in text_columns(df) if c in values]
    # A limit beyond the chunk would copy most rows; then borders are crossed by carried values.
    halo = options.limit if options.limit is not None and options.limit <= size // 4 else None
    span = size * options.step_us
    margin = (halo or 0) * options.step_us
    reach = overlap * options.step_us + margin

    rows = _usable(df, series, ts).withColumn("__us", micros(F.col(ts)))

    marks = _markers(_bounds(rows, series, options), series, span, margin, options.step_us)
    carried = text + (numeric if halo is None else [])
    if carried:
        single = _first_of_instant(rows, [*series, "__us"], options.tie_breaker) if options.on_duplicate == "first" else rows
        marks = _with_carried(marks, single, series, carried, text, span, options.step_us)
    chunks = F.sequence(_floor_div(F.col("__us") - reach, span), _floor_div(F.col("__us") + margin, span))
    samples = rows.withColumn("__chunk", F.explode(chunks)).withColumn("__sample", F.lit(True))
    partitions = [] if copies is None else [_partitions(rows, series, options.step_us, copies)]
    chunked = samples.unionByName(marks, allowMissingColumns=True).repartition(*partitions, *series, "__chunk")
    return _densify(chunked, series, columns, ts, numeric, text, options, span, overlap, halo)


def _first_of_instant(rows: DataFrame, instant: list[str], tie_breaker: str) -> DataFrame:
    first = Window.partitionBy(*instant).orderBy(tie_breaker)
    return rows.withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").drop("__rank")


def _usable(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    for c in [*keys, ts]:
        df = df.filter(F.col(c).isNotNull())
    return df


def _floor_div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("long")


def _bounds(rows: DataFrame, series: list[str], options: GridOptions) -> DataFrame:
    """Per series: grid anchor and number of grid points; series with a repeated instant may be left out."""
    if options.on_duplicate == "reject_subject":
        instants = rows.groupBy(*series, "__us").agg(F.count("*").alias("__copies"))
        bounds = instants.groupBy(*series).agg(
            F.min("__us").alias("__anchor"), F.max("__us").alias("__last"), F.max("__copies").alias("__copies")
        ).filter("__copies = 1")
    else:
        bounds = rows.groupBy(*series).agg(F.min("__us").alias("__anchor"), F.max("__us").alias("__last"))
    points = _floor_div(F.col("__last") - F.col("__anchor"), options.step_us) + 1
    return bounds.select(*series, "__anchor", points.alias("__n"))


def _partitions(rows: DataFrame, series: list[str], step: int, copies: int) -> int:
    """Partitions that keep a task at about ROWS_PER_TASK rows, if each grid point becomes ``copies`` rows."""
    spans = rows.groupBy(*series).agg((F.max("__us") - F.min("__us")).alias("__span"))
    points = spans.agg(F.sum(_floor_div(F.col("__span"), step) + 1)).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, tasks_for(points * copies))


def tasks_for(rows: int) -> int:
    """Tasks of about ROWS_PER_TASK rows."""
    return -(-rows // ROWS_PER_TASK)


def _markers(bounds: DataFrame, series: list[str], span: int, margin: int, step: int) -> DataFrame:
    """One row per chunk of each series, sorting before every sample that the chunk can see."""
    end = F.col("__anchor") + (F.col("__n") - 1) * step
    chunk = F.explode(F.sequence(_floor_div(F.col("__anchor"), span), _floor_div(end, span)))
    return bounds.withColumn("__chunk", chunk).withColumns(
        {"__us": F.col("__chunk") * span - margin - 1, "__sample": F.lit(False)}
    )


def _with_carried(
    marks: DataFrame, rows: DataFrame, series: list[str], carried: list[str], text: list[str], span: int, step: int
) -> DataFrame:
    """Add the values known before (text and numbers) and after (numbers) each chunk."""
    latest = {f"__before_{c}": F.max_by(_known(c), F.when(F.col(c).isNotNull(), F.col("__us"))) for c in carried}
    earliest = {
        f"__after_{c}": F.min_by(_known(c), F.when(F.col(c).isNotNull(), F.col("__us")))
        for c in carried if c not in text
    }
    # The phase tells grid samples from others without knowing the anchor yet.
    phase = F.pmod(F.col("__us"), F.lit(step))
    summary = rows.groupBy(*series, _floor_div(F.col("__us"), span).alias("__chunk"), phase.alias("__phase")).agg(
        *[e.alias(name) for name, e in (latest | earliest).items()]
    )
    on = [*series, "__chunk", "__phase"]
    marks = marks.withColumn("__phase", F.pmod(F.col("__anchor"), F.lit(step))).join(summary, on, "left")
    before = Window.partitionBy(*series).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    # The order is reversed for "after": a growing frame is linear, a shrinking one is not.
    after = Window.partitionBy(*series).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    return marks.withColumns(
        {name: F.last(name, True).over(before) for name in latest}
        | {name: F.last(name, True).over(after) for name in earliest}
    ).drop("__phase")


def _known(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.struct(F.col("__us").alias("us"), F.col(column).alias("v")))


def _densify(
    chunked: DataFrame,
    series: list[str],
    columns: list[str],
    ts: str,
    numeric: list[str],
    text: list[str],
    options: GridOptions,
    span: int,
    overlap: int,
    halo: int | None,
) -> DataFrame:
    step = options.step_us
    order = Window.partitionBy(*series, "__chunk").orderBy("__us", "__sample")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    over = f"over (partition by {', '.join(f'`{k}`' for k in series)}, __chunk order by __us, __sample)"

    if options.on_duplicate == "first":
        # Copies of an instant share a chunk, in whose partitioning and order this runs.
        chunked = _first_of_instant(chunked, [*series, "__chunk", "__us", "__sample"], options.tie_breaker)
    # The marker is the first row of its chunk. Chunks without one lie outside the series.
    attached = {c: F.first(c, True).over(so_far) for c in ("__anchor", "__n")}
    if options.on_duplicate == "error":
        # Copies of an instant share a chunk, so this needs no pass of its own.
        attached["__repeats"] = F.lag("__us").over(order) == F.col("__us")
    chunked = chunked.withColumns(attached).filter(F.col("__anchor").isNotNull())
    if options.on_duplicate == "error":
        message = F.concat_ws(" ", F.lit("duplicate timestamp in"), *[F.col(k) for k in series])
        failed = F.raise_error(message).cast("boolean")
        chunked = chunked.filter(F.when(F.col("__repeats"), failed).otherwise(True)).drop("__repeats")
    on_grid = F.pmod(F.col("__us") - F.col("__anchor"), F.lit(step)) == 0
    chunked = chunked.filter(~F.col("__sample") | on_grid)
    border = F.col("__chunk") * span - F.col("__anchor")
    first = F.greatest(F.ceil(border / step).cast("long"), F.lit(0).cast("long"))
    own_last = F.ceil((border + span) / step).cast("long") - 1
    last = F.least(own_last + overlap, F.col("__n") - 1)
    at_or_before = F.when(F.col("__sample"), _floor_div(F.col("__us") - F.col("__anchor"), step)).otherwise(first - 1)
    chunked = chunked.withColumns(
        {"__own_first": first, "__own_last": own_last, "__last": last, "__row_pos": at_or_before}
    )

    seen = {"__next_pos": F.coalesce(F.lead("__row_pos").over(order), F.col("__last") + 1)}
    unlimited = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = {}
    for c in numeric:
        here[f"__us_{c}"] = F.when(F.col(c).isNotNull(), F.col("__us"))
        here[f"__v_{c}"] = F.col(c)
        for part, name in (("us", f"__us_{c}"), ("v", f"__v_{c}")):
            following = F.expr(f"lead(`{name}`, 1) ignore nulls {over}")
            if halo is None:
                here[name] = F.coalesce(here[name], F.col(f"__before_{c}.{part}"))
                following = F.coalesce(following, F.first(F.col(f"__after_{c}.{part}"), True).over(unlimited))
            seen[f"__prev{name}"] = F.last(name, True).over(so_far)
            seen[f"__next{name}"] = following
    for c in text:
        seen[f"__text_{c}"] = F.last(F.coalesce(F.col(c), F.col(f"__before_{c}.v")), True).over(so_far)

    start = F.greatest(F.col("__row_pos"), F.col("__own_first"))
    stop = F.least(F.col("__next_pos") - 1, F.col("__last"))
    dense = (
        chunked.withColumns(here).withColumns(seen)
        .withColumns({"__from": start, "__to": stop})
        .filter("__from <= __to")
        .withColumn("__pos", F.explode(F.sequence("__from", "__to")))
    )
    is_sample = F.col("__sample") & (F.col("__pos") == F.col("__row_pos"))
    out = []
    types = {f.name: f.dataType for f in chunked.schema.fields}
    for c in columns:
        if c == ts:
            out.append(F.timestamp_micros(F.col("__anchor") + F.col("__pos") * step).cast(types[c]).alias(c))
        elif c in numeric:
            filled = _fill(c, options)
            out.append(F.when(is_sample & F.col(c).isNotNull(), F.col(c)).otherwise(filled).alias(c))
        elif c in text:
            out.append(F.col(f"__text_{c}").alias(c))
        elif c in series:
            out.append(F.col(c))
        else:
            out.append(F.when(is_sample, F.col(c)).alias(c))
    extra = [c for c in series if c not in columns]
    return dense.select(*out, *extra, "__chunk", "__pos", "__own_first", "__own_last")


def _fill(c: str, options: GridOptions) -> Column:
    """Value of a missing grid point from its known neighbours, if its run is short enough."""
    x0 = _floor_div(F.col(f"__prev__us_{c}") - F.col("__anchor"), options.step_us)
    x1 = _floor_div(F.col(f"__next__us_{c}") - F.col("__anchor"), options.step_us)
    y0, y1 = F.col(f"__prev__v_{c}"), F.col(f"__next__v_{c}")
    if options.method == "forward":
        value = y0
    elif options.method == "backward":
        value = y1
    else:
        value = F.coalesce((y1 - y0) / (x1 - x0) * (F.col("__pos") - x0) + y0, y0, y1)
    if options.limit is None:
        return value
    run = F.coalesce(x1, F.col("__n")) - F.coalesce(x0, F.lit(-1)) - 1
    return F.when(run <= options.limit, value)
