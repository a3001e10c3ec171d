"""Window features of recordings that arrive as a stream of files.

Two operators. ``windowed_moments`` is a plain event-time aggregation. ``closed_windows`` keeps a short buffer per series
in state and hands on the gridded rows of every window that can no longer change, so that the features which need rows in
order come from the same expressions as in batch; ``start_ordered_features`` runs both together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from biospark.contracts import CONTRACT, series_keys
from biospark.functions.scalars import duration_micros, nan_to_null, numeric_columns, text_columns
from biospark.operators import features, windows
from biospark.operators.align import METHODS
from biospark.operators.windows import WindowOptions

TIE = "instant_tie"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class LiveOptions:
    """Windows, grid and patience of a stream.

    ``delay``: rows that come later than this behind the newest instant are dropped. ``idle``: a series without a sample for
    this long is over; its last full windows are handed on and its state is cleared.
    """

    windows: WindowOptions = field(default_factory=WindowOptions)
    step: str = "1s"
    method: str = "linear"
    max_gap: str = "5s"
    delay: str = "10s"
    idle: str = "1h"

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"Unknown fill method: {self.method}")
        if self.max_gap is None:
            raise ValueError("a stream needs a gap limit, because its state must be bounded")

    @property
    def step_us(self) -> int:
        return duration_micros(self.step)

    @property
    def limit(self) -> int:
        return duration_micros(self.max_gap) // self.step_us


def read_recordings(
    spark: SparkSession, folder: str, schema: T.StructType = CONTRACT, file_format: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """A folder of recording files as a stream; new files are read as they appear."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if file_format == "csv":
        reader = reader.option("header", "true")
    return reader.format(file_format).load(folder)


def _usable(df: DataFrame, keys: list[str], timestamp: str) -> DataFrame:
    df = nan_to_null(df)
    for c in [*keys, timestamp]:
        df = df.filter(F.col(c).isNotNull())
    return df


def _span(duration: str | None) -> str:
    return f"{duration_micros(duration) or 0} microseconds"


def windowed_moments(
    samples: DataFrame, window: str = "60s", hop: str = "30s", delay: str = "10s",
    size: int | None = None, keys: list[str] | None = None, timestamp: str = "timestamp", start: str | None = None,
) -> DataFrame:
    """Count, label and moments per event-time window; one row per window of ``samples``, a stream or a table.

    An instant that a series repeats counts once (the row that arrives first). ``size`` keeps only windows with that many rows,
    which on gridded data that starts at a multiple of the hop are the full windows of the batch operator; ``start``
    moves the windows of data that starts elsewhere. On a stream a window is final once ``delay`` has passed behind it.
    """
    keys = series_keys(samples.columns) if keys is None else keys
    known = _usable(samples, keys, timestamp)
    if samples.isStreaming:
        single = known.withWatermark(timestamp, _span(delay)).dropDuplicatesWithinWatermark([*keys, timestamp])
    else:
        single = known.dropDuplicates([*keys, timestamp])
    grouped = single.groupBy(*keys, F.window(timestamp, *map(_span, (window, hop, start))).alias("window"))
    stats = grouped.agg(*features.moment_aggregates(samples.columns, timestamp))
    if size is not None:
        stats = stats.filter(F.col("window_length") == size)
    named = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return stats.select(*keys, *named, *features.moment_columns(samples.columns))


@dataclass
class _Series:
    """The buffer of one series: samples by instant, the anchor of its grid, the next window to hand on."""

    anchor: int | None
    settled: bool
    next: int
    carried: list[str | None]
    timers: list[int]
    rows: dict[int, tuple]


class _Closer(StatefulProcessor):
    """Keeps, per series, the samples from ``limit`` grid steps before the next window on."""

    def __init__(self, options: LiveOptions, keys: list[str], numbers: list[str], texts: list[str], tie: bool = False):
        self.size, self.hop, self.limit = options.windows.size, options.windows.hop, options.limit
        self.step, self.method, self.idle = options.step_us, options.method, duration_micros(options.idle)
        self.keys, self.numbers, self.texts = keys, numbers, texts
        # The tie breaker is stored behind the signals.
        self.stored = [*numbers, TIE] if tie else numbers

    def state_schema(self) -> T.StructType:
        arrays = [T.StructField(f"n_{i}", T.ArrayType(T.DoubleType())) for i in range(len(self.stored))]
        arrays += [T.StructField(f"t_{i}", T.ArrayType(T.StringType())) for i in range(len(self.texts))]
        return T.StructType(
            [
                T.StructField("anchor", T.LongType()), T.StructField("settled", T.BooleanType()), T.StructField("next", T.LongType()),
                T.StructField("carried", T.ArrayType(T.StringType())), T.StructField("timers", T.ArrayType(T.LongType())),
                T.StructField("us", T.ArrayType(T.LongType())), *arrays,
            ]
        )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", self.state_schema())

    def close(self) -> None:
        pass

    def _load(self) -> _Series:
        if not self.state.exists():
            return _Series(None, False, 0, [None] * len(self.texts), [], {})
        anchor, settled, following, carried, timers, us, *columns = self.state.get()
        return _Series(anchor, settled, following, list(carried), list(timers), dict(zip(us, zip(*columns))))

    def _store(self, series: _Series) -> None:
        us = sorted(series.rows)
        columns = list(zip(*(series.rows[u] for u in us))) or [()] * (len(self.stored) + len(self.texts))
        self.state.update(
            (series.anchor, series.settled, series.next, series.carried, series.timers, us, *[list(c) for c in columns])
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        series = self._load()
        for batch in rows:
            numbers = [batch[c].astype(float).tolist() for c in self.stored]
            texts = [batch[c].tolist() for c in self.texts]
            for us, *values in zip(batch["instant_us"].tolist(), *numbers, *texts):
                if series.settled and us < series.anchor + (series.next * self.hop - self.limit - 1) * self.step:
                    continue
                clean = tuple(None if v is None or v != v else v for v in values)
                if us not in series.rows or self.stored is not self.numbers and self._tie(clean) < self._tie(series.rows[us]):
                    series.rows[us] = clean
        yield from self._advance(key, series, timerValues.getCurrentWatermarkInMs() * 1000)

    def _tie(self, row: tuple) -> float:
        value = row[len(self.numbers)]
        return float("inf") if value is None else value

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, self._load(), timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, series: _Series, watermark: int) -> Iterator[pd.DataFrame]:
        """Hand on what is final at this watermark, forget what no later window needs, set the next timers."""
        if not series.rows and not series.settled:
            return
        if not series.settled:
            # An earlier first sample may still come.
            series.anchor = min(series.rows)
            series.settled = series.anchor < watermark
        on_grid = [u for u in series.rows if (u - series.anchor) % self.step == 0]
        last = max(on_grid, default=series.anchor)
        over = watermark > last + self.idle
        if series.settled:
            newest = (min(watermark - 1, last) - series.anchor) // self.step
            out = self._windows(key, series, on_grid, newest, newest if over else newest - self.limit)
            if out is not None:
                yield out
        for timer in series.timers:
            if timer > watermark // 1000:
                self.handle.deleteTimer(timer)
        if over:
            self.state.clear()
            return
        # When the next window can be final, when the last sample is settled, when the series is over.
        following = series.anchor + (series.next * self.hop + self.size - 1 + self.limit) * self.step
        wanted = {at // 1000 + 1 for at in (min(following, last), last, last + self.idle)}
        series.timers = sorted(t for t in wanted if t > watermark // 1000)
        for timer in series.timers:
            self.handle.registerTimer(timer)
        self._store(series)

    def _windows(self, key, series: _Series, on_grid: list[int], newest: int, final: int) -> pd.DataFrame | None:
        """Rows of all windows that end at grid position ``final`` or before, filled from samples up to ``newest``."""
        first = series.next
        count = max(0, (final - self.size + 1) // self.hop + 1 - first) if final >= self.size - 1 else 0
        low = max(0, first * self.hop - self.limit - 1)
        out = self._filled(key, series, on_grid, low, newest, first, count) if count else None
        if count:
            series.next += count
            keep = series.next * self.hop - self.limit - 1
            gone = sorted(u for u in series.rows if u < series.anchor + keep * self.step)
            for u in gone:
                values = series.rows.pop(u)
                if (u - series.anchor) % self.step == 0:
                    texts = values[len(self.stored) :]
                    series.carried = [new if new is not None else old for new, old in zip(texts, series.carried)]
        return out

    def _filled(self, key, series, on_grid, low: int, newest: int, first: int, count: int) -> pd.DataFrame:
        length = newest - low + 1
        at = {(u - series.anchor) // self.step - low: series.rows[u] for u in on_grid}
        positions = np.arange(low, newest + 1)
        starts = np.arange(first, first + count) * self.hop
        take = (starts[:, None] + np.arange(self.size)[None, :] - low).ravel()
        out = {name: value for name, value in zip(self.keys, key)}
        out["__k"] = np.repeat(np.arange(first, first + count), self.size)
        out["__pos"] = positions[take]
        out["instant_us"] = series.anchor + out["__pos"] * self.step
        for i, name in enumerate(self.numbers):
            values = np.full(length, np.nan)
            for p, row in at.items():
                if 0 <= p < length and row[i] is not None:
                    values[p] = row[i]
            out[name] = self._fill(values, positions, newest)[take]
        for i, name in enumerate(self.texts):
            now, line = series.carried[i], []
            for p in range(length):
                row = at.get(p)
                now = row[len(self.stored) + i] if row and row[len(self.stored) + i] is not None else now
                line.append(now)
            out[name] = np.array(line, object)[take]
        return pd.DataFrame(out)

    def _fill(self, values: np.ndarray, positions: np.ndarray, newest: int) -> np.ndarray:
        """Runs of missing values no longer than the limit, from the known values around them."""
        known = ~np.isnan(values)
        none = len(values)
        place = np.arange(len(values))
        before = np.maximum.accumulate(np.where(known, place, -1))
        after = np.minimum.accumulate(np.where(known, place, none)[::-1])[::-1]
        x0 = np.where(before >= 0, positions[np.maximum(before, 0)], -1)
        x1 = np.where(after < none, positions[np.minimum(after, none - 1)], newest + 1)
        y0 = np.where(before >= 0, values[np.maximum(before, 0)], np.nan)
        y1 = np.where(after < none, values[np.minimum(after, none - 1)], np.nan)
        if self.method == "forward":
            value = y0
        elif self.method == "backward":
            value = y1
        else:
            with np.errstate(invalid="ignore", divide="ignore"):
                between = (y1 - y0) / (x1 - x0) * (positions - x0) + y0
            value = np.where(np.isnan(between), np.where(np.isnan(y0), y1, y0), between)
        return np.where(known, values, np.where(x1 - x0 - 1 <= self.limit, value, np.nan))


def closed_windows(samples: DataFrame, options: LiveOptions = LiveOptions()) -> DataFrame:
    """The gridded rows of every window of the stream ``samples`` that can no longer change.

    A series is laid on a grid from its first sample; samples off the grid drop out, an instant that is repeated counts
    once (by the windows' tie breaker, a whole number, else the row that arrives first), gaps up to the limit are filled, texts are carried forward. A window is handed on when the watermark and the series'
    own samples have passed it by the gap limit; then no row can change it, and it equals the batch aligner's. State per
    series is one window, the gap limit and what arrived within the delay; it is cleared after ``idle``.

    Columns: keys, numbers as doubles, texts, timestamp, ``__k`` (window), ``__start``, ``__pos``, ``__chunk``.
    """
    ts = options.windows.timestamp
    keys = windows.window_keys(samples, options.windows)
    if not keys:
        raise ValueError("a stream needs key columns")
    tie = options.windows.tie_breaker
    numbers = [c for c in numeric_columns(samples) if c not in keys and c != tie]
    texts = [c for c in text_columns(samples) if c not in keys]
    rows = _usable(samples, keys, ts).select(
        *keys, ts, F.unix_micros(ts).alias("instant_us"), *[F.col(c).cast("double").alias(c) for c in numbers], *texts,
        *([F.col(tie).cast("double").alias(TIE)] if tie else []),
    )
    schema = T.StructType(
        [
            *[samples.schema[k] for k in keys],
            *[T.StructField(c, T.LongType()) for c in ("__k", "__pos", "instant_us")],
            *[T.StructField(c, T.DoubleType()) for c in numbers],
            *[T.StructField(c, T.StringType()) for c in texts],
        ]
    )
    closed = (
        rows.withWatermark(ts, _span(options.delay))
        .groupBy(*keys)
        .transformWithStateInPandas(_Closer(options, keys, numbers, texts, bool(tie)), schema, "append", "eventTime")
    )
    return closed.select(
        *keys, *numbers, *texts, F.timestamp_micros("instant_us").alias(ts), "__k", (F.col("__k") * options.windows.hop).alias("__start"),
        "__pos", F.col("__k").alias("__chunk"),
    )


def features_of_closed(closed: DataFrame, options: LiveOptions) -> DataFrame:
    """The feature table of ``closed_windows``' rows, by the batch expressions."""
    if not isinstance(options.windows.ratio_columns, tuple):
        raise ValueError("a stream needs the names of the columns whose valid share counts")
    keys = windows.window_keys(closed, options.windows)
    rows = features.with_neighbours(closed, [*keys, "__chunk"], "__pos", options.windows.sampling_rate)
    source = closed.drop("__k", "__start", "__pos", "__chunk")
    return windows.window_features(rows, source, options.windows)


def start_ordered_features(
    samples: DataFrame, output: str, checkpoint: str, options: LiveOptions, once: bool = True
) -> StreamingQuery:
    """Write the feature table of every closed window to ``output``, one folder per micro-batch.

    A micro-batch that is run again after a failure replaces its folder, so no window is written twice. ``once`` reads what is
    there and ends; otherwise the query goes on. Needs the RocksDB state store (set here).
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(closed: DataFrame, number: int) -> None:
        features_of_closed(closed, options).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = closed_windows(samples, options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_moments(samples: DataFrame, output: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Write ``windowed_moments`` of a stream to Parquet files in ``output``, each window once it is final."""
    moments = windowed_moments(samples, **options)
    writer = moments.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(output)
