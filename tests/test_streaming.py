"""Streams against the batch operators: equality, late and repeated rows, restarts, bounded state."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from biospark.contracts import CONTRACT
from biospark.operators import align, windows
from biospark.operators.windows import WindowOptions
from biospark.plans import stream_windows
from biospark.streaming import live

BASE = datetime(2024, 3, 1, 12, 0, 0)
WINDOWS = WindowOptions(20, 10, ratio_columns=("hr", "eda_scl", "temp", "acc_mag"))
OPTIONS = live.LiveOptions(WINDOWS, delay="10s", idle="1h")


def recording(subject: str, seconds: int, seed: int = 0, gaps: float = 0.0, nulls: float = 0.0, first: int = 0):
    rng = random.Random(f"{subject}{seed}")

    def value(v):
        return None if rng.random() < nulls else v

    rows, at = [], first
    while at < first + seconds:
        if rng.random() < gaps:
            at += rng.randint(1, 9)
        rows.append(
            (
                BASE + timedelta(seconds=at), subject, value(60 + rng.random() * 30), None, None, value(rng.random() * 5), None,
                value(33 + rng.random()), value(rng.random()), value(rng.choice(["stress", "baseline"])),
            )
        )
        at += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, CONTRACT)


def arrive(spark, rows, folder):
    """Rows as one more file of the folder."""
    frame(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))


def plain(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


def table(df, columns=None):
    rows = df.select(*(columns or df.columns)).collect()
    return {(r["subject"], r["timestamp_start"]): tuple(plain(v) for v in r) for r in rows}


def ordered(spark, folder, place, options=OPTIONS, **read):
    samples = live.read_recordings(spark, str(folder), **read)
    live.start_ordered_features(samples, f"{place}/out", f"{place}/checkpoint", options).awaitTermination()
    return spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out/batch=*").drop("batch")


def batch(spark, rows, method="linear"):
    grid = align.GridOptions(on_duplicate="unchecked", method=method)
    return windows.align_and_extract(frame(spark, rows), grid, WINDOWS)


def end_of(rows):
    """A row that moves the watermark far beyond all others."""
    last = max(r[0] for r in rows)
    return [(last + timedelta(hours=3), "clock", 70.0, None, None, 1.0, None, 33.0, 0.1, "rest")]


@pytest.fixture()
def folder(tmp_path):
    return tmp_path / "in"


# Moments


def moments(spark, folder, place):
    query = stream_windows.run(
        spark, str(folder), f"{place}/out", f"{place}/checkpoint", 20, 10, "10s", features="moments", files_per_trigger=1
    )
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out")


def test_moments_equal_the_batch_windows(spark, folder, tmp_path):
    rows = recording("f1", 200, nulls=0.02) + recording("f2", 150, nulls=0.02)
    for low in range(0, 200, 50):
        arrive(spark, [r for r in rows if low <= (r[0] - BASE).seconds < low + 50], folder)
    arrive(spark, end_of(rows), folder)
    got = moments(spark, folder, tmp_path)
    shared = [c for c in windows.extract_features_from_windows(frame(spark, rows), WINDOWS).columns if c in got.columns]
    assert {"hrv_hr_mean", "eda_std", "temp_range", "acc_mag_max", "label", "window_length"} <= set(shared)
    # No window is left out for its nulls here.
    every = WindowOptions(20, 10, min_valid_ratio=0.0, ratio_columns=WINDOWS.ratio_columns)
    expected = windows.extract_features_from_windows(frame(spark, rows), every)
    assert table(got, shared) == table(expected, shared) and len(table(got)) == 19 + 14


def test_late_and_repeated_rows_of_moments(spark, folder, tmp_path):
    rows = recording("f1", 120)
    arrive(spark, rows[:60] + rows[10:30], folder)
    arrive(spark, rows[65:90], folder)
    # Five seconds behind the newest instant is in time.
    arrive(spark, rows[60:65] + rows[90:91], folder)
    arrive(spark, rows[91:], folder)
    # A hundred seconds behind is not: this row is lost.
    arrive(spark, [(BASE + timedelta(seconds=15, milliseconds=500), *rows[15][1:])], folder)
    arrive(spark, end_of(rows), folder)
    got = table(moments(spark, folder, tmp_path), ["subject", "timestamp_start", "window_length", "hrv_hr_mean"])
    assert all(v[2] == 20 for v in got.values()) and len(got) == 11
    hr = [r[2] for r in rows]
    assert got["f1", BASE + timedelta(seconds=50)][3] == pytest.approx(sum(hr[50:70]) / 20)


def test_moments_go_on_after_a_restart(spark, folder, tmp_path):
    rows = recording("f1", 100)
    arrive(spark, rows[:55], folder)
    first = table(moments(spark, folder, tmp_path))
    assert 0 < len(first) < 5
    arrive(spark, rows[55:], folder)
    arrive(spark, end_of(rows), folder)
    assert len(table(moments(spark, folder, tmp_path))) == 9


def test_static_moments(spark):
    rows = recording("f1", 100)
    got = live.windowed_moments(frame(spark, rows + rows[:20]), "20s", "10s", size=20)
    assert got.count() == 9


# Ordered features


@pytest.mark.parametrize("method", ["linear", "forward", "backward"])
def test_ordered_features_equal_the_batch(spark, folder, tmp_path, method):
    rows = recording("f1", 260, gaps=0.05, nulls=0.15) + recording("f2", 180, gaps=0.1, nulls=0.1, first=37)
    rows += recording("f3", 25)
    rng = random.Random(4)
    shuffled = sorted(rows, key=lambda r: (r[0] - BASE).seconds + rng.random() * 8)
    for low in range(0, len(shuffled), 120):
        arrive(spark, shuffled[low : low + 120], folder)
    arrive(spark, end_of(rows), folder)
    options = live.LiveOptions(WINDOWS, method=method, delay="10s")
    got = ordered(spark, folder, tmp_path, options, files_per_trigger=1 if method == "linear" else None)
    expected = batch(spark, rows, method)
    assert table(got, expected.columns) == table(expected) and len(table(expected)) > 20


def test_closed_windows_equal_the_batch_before_the_end(spark, folder, tmp_path):
    """Without a later clock only windows that can no longer change are there, and they are the batch's."""
    rows = recording("f1", 200, gaps=0.05, nulls=0.2)
    arrive(spark, rows[:100], folder)
    arrive(spark, rows[100:], folder)
    got, expected = table(ordered(spark, folder, tmp_path, files_per_trigger=1)), table(batch(spark, rows))
    assert 0 < len(got) <= len(expected) and all(expected[k] == v for k, v in got.items())


def test_repeated_and_late_rows_of_ordered_features(spark, folder, tmp_path):
    rows = recording("f1", 120)
    arrive(spark, rows[:70] + rows[20:40], folder)
    other = [(r[0], r[1], 1.0, *r[3:]) for r in rows[10:20]]
    arrive(spark, rows[60:], folder)
    # Long after their windows were handed on.
    arrive(spark, other + end_of(rows), folder)
    assert table(ordered(spark, folder, tmp_path, files_per_trigger=1)) == table(batch(spark, rows))


def test_ordered_features_go_on_after_a_restart(spark, folder, tmp_path):
    rows = recording("f1", 150, gaps=0.05) + recording("f2", 150, nulls=0.1)
    for low in (0, 50, 100):
        arrive(spark, [r for r in rows if low <= (r[0] - BASE).seconds < low + 50], folder)
        seen = table(ordered(spark, folder, tmp_path))
    assert seen
    arrive(spark, [r for r in rows if (r[0] - BASE).seconds >= 150] + end_of(rows), folder)
    assert table(ordered(spark, folder, tmp_path)) == table(batch(spark, rows))


class _Handle:
    """What a processor uses of Spark's handle: one value and timers."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_state_is_bounded():
    """A series of any length leaves a window, its hop, the gap limit, the delay and the newest file's rows in state."""
    closer = live._Closer(OPTIONS, ["subject"], ["hr"], ["label"])
    handle = _Handle()
    closer.init(handle)
    handed, held = 0, []
    for low in range(0, 3000, 30):
        rows = pd.DataFrame(
            {"instant_us": [(low + i) * 1_000_000 for i in range(30)], "hr": [70.0] * 30, "label": ["rest"] * 30}
        )
        watermark = _Watermark(max(0, (low - 1 - 10) * 1000))
        handed += sum(len(out) for out in closer.handleInputRows(("f1",), iter([rows]), watermark))
        for at in sorted(t for t in handle.timers if t <= watermark.at):
            handle.timers.discard(at)
            handed += sum(len(out) for out in closer.handleExpiredTimer(("f1",), watermark, None))
        held.append(len(handle.value[5]))
        assert len(handle.timers) <= 3
    assert max(held) <= 20 + 10 + 5 + 10 + 30 + 2 and held[-1] <= max(held[:10])
    assert handed > 280 * 20
    # The timers hand the rest on and clear the state.
    while handle.timers:
        at = min(handle.timers)
        handle.timers.discard(at)
        handed += sum(len(out) for out in closer.handleExpiredTimer(("f1",), _Watermark(at), None))
    assert handle.value is None and handed == 299 * 20


def test_state_is_cleared(spark, folder, tmp_path):
    rows = recording("f1", 90) + recording("f2", 90)
    arrive(spark, rows, folder)
    arrive(spark, end_of(rows), folder)
    samples = live.read_recordings(spark, str(folder), files_per_trigger=1)
    query = live.start_ordered_features(samples, f"{tmp_path}/out", f"{tmp_path}/checkpoint", OPTIONS)
    query.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    # The clock's series is left.
    assert max(kept) > kept[-1] and kept[-1] <= 8
    assert len(table(spark.read.parquet(f"{tmp_path}/out/batch=*"))) == 2 * 8


def test_streams_refuse_what_they_cannot_do(spark, folder, tmp_path):
    with pytest.raises(ValueError):
        live.LiveOptions(max_gap=None)
    with pytest.raises(ValueError):
        live.LiveOptions(method="spline")
    arrive(spark, recording("f1", 30), folder)
    samples = live.read_recordings(spark, str(folder))
    with pytest.raises(ValueError):
        live.closed_windows(samples.drop("subject"))
    with pytest.raises(ValueError):
        live.features_of_closed(live.closed_windows(samples), live.LiveOptions())
    with pytest.raises(ValueError):
        stream_windows.run(spark, str(folder), "out", "checkpoint", features="all")
