"""Overlapping windows by row position, and the feature table over them.

Windows start at positions 0, hop, 2 * hop, ... of a series and hold ``size`` rows; only full
windows count. Rows are scattered to chunks of whole window starts: a chunk holds all rows of
the windows that start in it, so a window never crosses a chunk and a long recording is many
groups. Everything after the scatter runs in the (keys, chunk) partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biospark.contracts import series_keys
from biospark.functions.scalars import duration_micros, nan_to_null, numeric_columns
from biospark.operators import align, features
from biospark.operators.ordered import row_positions, time_bucket


@dataclass(frozen=True)
class WindowOptions:
    """Window length and hop in seconds, sampling rate, validity threshold.

    ``ratio_columns``: columns whose non-null share decides whether a window is kept. None takes
    the numeric columns that hold any value at all, ``"all_numeric"`` every numeric column. ``tie_breaker`` orders
    samples of the same instant and is no signal.
    """

    window_size_sec: float = 60
    hop_size_sec: float = 30
    sampling_rate: float = 1.0
    min_valid_ratio: float = 0.8
    ratio_columns: str | tuple[str, ...] | None = None
    keys: tuple[str, ...] | None = None
    timestamp: str = "timestamp"
    tie_breaker: str | None = None
    bucket: str = "1 hour"
    chunk: int = align.CHUNK_POSITIONS

    def __post_init__(self):
        if self.size < 1 or self.hop < 1:
            raise ValueError("window and hop must hold at least one sample")

    @property
    def size(self) -> int:
        return int(self.window_size_sec * self.sampling_rate)

    @property
    def hop(self) -> int:
        return int(self.hop_size_sec * self.sampling_rate)

    @property
    def copies(self) -> int:
        """Windows that a row lies in."""
        return -(-self.size // self.hop)

    @property
    def chunk_size(self) -> int:
        """Positions per chunk: whole hops, at least one window."""
        return (max(self.chunk, self.size) // self.hop + 1) * self.hop


def extract_features_from_windows(df: DataFrame, options: WindowOptions = WindowOptions()) -> DataFrame:
    """One feature row per valid window of a recording table (gridded or not)."""
    df = nan_to_null(df)
    return window_features(window_rows(df, options), df, options)


def align_and_extract(
    df: DataFrame, grid: align.GridOptions = align.GridOptions(), options: WindowOptions = WindowOptions()
) -> DataFrame:
    """The aligner followed by the window features, in one shuffle of the samples."""
    # A row is sorted once for its neighbours, then once for each window that it lies in.
    dense = align.dense_chunks(df, grid, options.chunk_size, overlap=options.size - 1, copies=options.copies)
    return window_features(_explode_windows(dense, options), df, options)


def window_rows(df: DataFrame, options: WindowOptions) -> DataFrame:
    """Rows of all windows, full or not: the input columns plus ``__chunk``, ``__pos``, ``__k``.

    The rows of ``df`` are counted first, so store a table that is dear to compute.
    """
    ts = options.timestamp
    if ts not in df.columns:
        raise ValueError(f"DataFrame must have '{ts}' column")
    keys = window_keys(df, options)
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    order = [c for c in (ts, options.tie_breaker) if c]
    bucket = time_bucket(F.col(ts), duration_micros(options.bucket))
    present = df.filter(F.col(ts).isNotNull())
    numbered = row_positions(present, keys, bucket, order, "__pos")
    return _explode_windows(scatter(numbered, keys, options, present.count()), options)


def scatter(numbered: DataFrame, keys: list[str], options: WindowOptions, rows: int) -> DataFrame:
    """Send each of the ``rows`` rows to the chunks whose windows contain it.

    Spark sizes the partitions by the rows' bytes, which suits few rows; many would be copied per window in as few tasks.
    """
    tasks = align.tasks_for(rows * options.copies)
    partitions = [tasks] if tasks > numbered.sparkSession.sparkContext.defaultParallelism else []
    first, last = _window_range(options)
    starts = options.chunk_size // options.hop
    chunks = F.sequence(F.floor(first / starts), F.floor(last / starts))
    own_first = F.col("__chunk") * options.chunk_size
    return (
        numbered.filter(first <= last)
        .withColumn("__chunk", F.explode(chunks))
        .repartition(*partitions, *keys, "__chunk")
        .withColumns({"__own_first": own_first, "__own_last": own_first + (options.chunk_size - 1)})
    )


def _window_range(options: WindowOptions) -> tuple[Column, Column]:
    """Ordinals of the first and last window that contain position ``__pos``."""
    first = F.ceil((F.col("__pos") - (options.size - 1)) / options.hop).cast("long")
    return F.greatest(first, F.lit(0).cast("long")), F.floor(F.col("__pos") / options.hop).cast("long")


def _explode_windows(chunked: DataFrame, options: WindowOptions) -> DataFrame:
    """Add neighbour columns inside each chunk, then one row per (row, window starting in this chunk)."""
    keys = window_keys(chunked, options)
    chunked = features.with_neighbours(chunked, [*keys, "__chunk"], "__pos", options.sampling_rate)
    first, last = _window_range(options)
    first = F.greatest(first, F.ceil(F.col("__own_first") / options.hop).cast("long"))
    last = F.least(last, F.floor(F.col("__own_last") / options.hop).cast("long"))
    return (
        chunked.withColumns({"__k0": first, "__k1": last})
        .filter("__k0 <= __k1")
        .withColumn("__k", F.explode(F.sequence("__k0", "__k1")))
        .withColumn("__start", F.col("__k") * options.hop)
        .drop("__k0", "__k1", "__own_first", "__own_last")
    )


def window_keys(df: DataFrame, options: WindowOptions) -> list[str]:
    return list(options.keys) if options.keys is not None else series_keys(df.columns)


def window_features(rows: DataFrame, source: DataFrame, options: WindowOptions) -> DataFrame:
    """Aggregate window rows to the feature table; ``source`` decides which columns count as signals."""
    keys = window_keys(rows, options)
    signals = [c for c in numeric_columns(source) if c not in {*keys, options.tie_breaker}]
    checked = signals if options.ratio_columns in (None, "all_numeric") else list(options.ratio_columns)
    aggregated = features.aggregate_windows(
        rows, [*keys, "__chunk", "__k", "__start"], options.size, options.sampling_rate, options.timestamp, checked
    ).filter(F.col("window_length") == options.size)
    if checked:
        aggregated = aggregated.filter(_valid_share(source, checked, options) >= options.min_valid_ratio)
    identity = {
        "window_id": features.window_id_column(aggregated, options.size),
        "subject": F.col("subject") if "subject" in aggregated.columns else F.lit("unknown"),
    }
    extra = [k for k in keys if k != "subject"]
    return features.finish(aggregated.withColumns(identity), source.columns, options.sampling_rate, extra)


def _valid_share(source: DataFrame, checked: list[str], options: WindowOptions) -> Column:
    """Mean non-null share over the checked columns, for complete windows."""
    known = sum((F.col(f"__valid_{c}") for c in checked), F.lit(0))
    source = nan_to_null(source)
    if options.ratio_columns is None:
        holds_values = [F.coalesce(F.max(F.when(F.col(c).isNotNull(), 1)), F.lit(0)) for c in checked]
        columns = source.agg(sum(holds_values, F.lit(0)).alias("n")).scalar()
        # No column with any value: nothing to test, the window stays.
        return F.coalesce(F.try_divide(known, columns * options.size), F.lit(1.0))
    return known / F.lit(options.size * len(checked))
