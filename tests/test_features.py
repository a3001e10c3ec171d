from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from biospark.contracts import FEATURE_TABLE_COLUMNS, HRV_COLUMNS, feature_columns
from biospark.functions.spectral import welch_psd
from biospark.operators import features
from biospark.operators.align import GridOptions, align_to_1hz
from biospark.operators.windows import WindowOptions, align_and_extract, extract_features_from_windows
from tests.conftest import samples

SIGNALS = "subject string, seconds double, hr double, eda_scl double, temp double, acc_mag double, label string"


def recording(spark, seed=3, subjects=("f01", "f02"), length=600, missing=0.1):
    rng = random.Random(seed)

    def value(lo, hi, digits):
        return None if rng.random() < missing else round(rng.uniform(lo, hi), digits)

    return samples(
        spark,
        [
            (s, float(i), value(55, 95, 1), value(1, 9, 0), value(30, 34, 2), value(0, 2, 2), rng.choice(["stress", "baseline"]))
            for s in subjects for i in range(length)
        ],
        SIGNALS,
    )


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def trapezoid(y):
    return float(sum((a + b) / 2 for a, b in zip(y, y[1:])))


def peak_positions(y):
    """Middle of each plateau that is higher than both of its neighbours."""
    found, i = [], 1
    while i < len(y) - 1:
        j = i
        while j < len(y) - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < len(y) - 1 and y[j + 1] < y[i]:
            found.append((i + j) // 2)
        i = j + 1
    return found


def plain_spectrum(rr):
    """LF and HF power through explicit DFT sums."""
    n = len(rr)
    dense = np.interp(np.linspace(0, n, 4 * n), np.linspace(0, n, n), rr)
    size = min(256, 2 * n)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    powers, t = [], np.arange(size)
    for start in range(0, len(dense) - size + 1, size - size // 2):
        piece = dense[start : start + size]
        piece = (piece - piece.mean()) * taper
        powers.append([
            (1 if b in (0, size / 2) else 2)
            * (np.sum(piece * np.cos(2 * np.pi * b * t / size)) ** 2 + np.sum(piece * np.sin(2 * np.pi * b * t / size)) ** 2)
            / (4 * np.sum(taper**2)) for b in range(size // 2 + 1)])
    psd, freq = np.mean(powers, axis=0), np.fft.rfftfreq(size, 0.25)
    return [trapezoid(psd[(freq >= lo) & (freq <= hi)]) for lo, hi in ((0.04, 0.15), (0.15, 0.4))]


def plain_features(rows):
    hr, eda, temp, acc = ([r[c] for r in rows if r[c] is not None] for c in ("hr", "eda_scl", "temp", "acc_mag"))
    rr = [60 / v for v in hr]
    jumps = [b - a for a, b in zip(rr, rr[1:])]
    lf, hf = plain_spectrum(rr) if len(rr) >= 10 else (None, None)
    limit = statistics.mean(eda) + 0.5 * statistics.stdev(eda)
    peaks = [p for p in peak_positions(eda) if eda[p] >= limit]
    active = statistics.mean(acc) + statistics.stdev(acc)
    return {
        "hrv_hr_mean": statistics.mean(hr), "hrv_hr_std": statistics.stdev(hr), "hrv_hr_range": max(hr) - min(hr),
        "hrv_rmssd": math.sqrt(statistics.mean(j * j for j in jumps)) * 1000, "hrv_sdnn": statistics.pstdev(rr) * 1000,
        "hrv_pnn50": 100 * sum(abs(j) > 0.05 for j in jumps) / len(jumps),
        "hrv_lf_power": lf, "hrv_hf_power": hf, "hrv_lf_hf_ratio": lf / hf,
        "eda_slope": float(np.polyfit(range(len(eda)), eda, 1)[0]), "eda_auc": trapezoid(eda),
        "eda_peak_count": len(peaks), "eda_peak_rate": len(peaks) / len(eda) * 60,
        "temp_slope": float(np.polyfit(range(len(temp)), temp, 1)[0]), "temp_delta": temp[-1] - temp[0],
        "acc_mag_std": statistics.stdev(acc), "acc_activity_count": sum(v > active for v in acc),
    }


@pytest.mark.parametrize("chunk", [40, 100, 8192])
def test_against_plain_rendering(spark, chunk):
    table = recording(spark, length=230)
    options = WindowOptions(40, 15, chunk=chunk, bucket="1 minute")
    got = {r.window_id: r for r in extract_features_from_windows(table, options).collect()}
    expected = {}
    for subject in ("f01", "f02"):
        rows = table.filter(F.col("subject") == subject).orderBy("timestamp").collect()
        for start in range(0, len(rows) - 40 + 1, 15):
            expected[f"{subject}_{start:06d}_{start + 40:06d}"] = plain_features(rows[start : start + 40])
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        for name, value in values.items():
            assert close(got[key][name], value), (key, name, got[key][name], value)


def test_demo_shape_and_columns(spark):
    out = extract_features_from_windows(recording(spark, missing=0.0))
    assert out.columns == FEATURE_TABLE_COLUMNS and len(feature_columns(out.columns)) == 34
    assert {r.subject: r["count"] for r in out.groupBy("subject").count().collect()} == {"f01": 19, "f02": 19}


@pytest.mark.parametrize("gap, chunk", [("5s", 8192), ("5s", 70), (None, 70)])
def test_fused_pass_equals_two_steps(spark, gap, chunk):
    table = recording(spark, length=400).filter("pmod(hash(timestamp), 5) != 0 or minute(timestamp) = 2")
    options = WindowOptions(60, 20, min_valid_ratio=0.3, chunk=chunk)
    grid = GridOptions(max_gap=gap, chunk=50)
    fused = {r.window_id: r.asDict() for r in align_and_extract(table, grid, options).collect()}
    steps = {r.window_id: r.asDict() for r in extract_features_from_windows(align_to_1hz(table, max_gap=gap), options).collect()}
    assert fused.keys() == steps.keys() and fused
    for key, row in steps.items():
        for name, value in row.items():
            same = close(fused[key][name], value) if isinstance(value, float) else fused[key][name] == value
            assert same, (key, name, fused[key][name], value)


def test_valid_share(spark):
    rows = [("a", float(i), 70.0 if i < 70 else None, 1.0, "x") for i in range(100)]
    table = samples(spark, rows, "subject string, seconds double, hr double, temp double, label string").withColumn("rmssd", F.lit(None).cast("double"))
    options = {"window_size_sec": 10, "hop_size_sec": 10}
    assert extract_features_from_windows(table, WindowOptions(**options)).count() == 7
    assert extract_features_from_windows(table, WindowOptions(**options, ratio_columns="all_numeric")).count() == 0
    assert extract_features_from_windows(table, WindowOptions(**options, ratio_columns=("temp",))).count() == 10
    assert extract_features_from_windows(table.select("subject", "timestamp", "label"), WindowOptions(**options)).count() == 10


def test_hrv_edge_cases(spark):
    rows = [("none", 0.0, None), ("one", 0.0, 70.0)] + [("flat", float(i), 70.0) for i in range(60)]
    got = {r.subject: r for r in features.compute_hrv_features(samples(spark, rows), ["subject"], "timestamp").collect()}
    for subject in ("none", "one"):
        assert all(got[subject][c] is None for c in HRV_COLUMNS)
    flat = got["flat"]
    assert flat.hrv_hr_mean == pytest.approx(70) and (flat.hrv_hr_std, flat.hrv_rmssd, flat.hrv_pnn50) == (0, 0, 0)
    assert flat.hrv_lf_hf_ratio is None


def test_temperature_rise(spark):
    rows = [("a", float(i), float(v)) for i, v in enumerate(np.linspace(32, 33, 100))]
    row = features.compute_temperature_features(samples(spark, rows), ["subject"], "timestamp", "hr").first()
    assert row.temp_slope == pytest.approx(1 / 99) and row.temp_delta == pytest.approx(1.0)


def test_slow_sampling_reports_no_peaks(spark):
    rows = [("a", 2.0 * i, float(i % 3)) for i in range(20)]
    row = features.compute_eda_features(samples(spark, rows), ["subject"], "timestamp", "hr", 0.5).first()
    assert (row.eda_peak_count, row.eda_peak_rate, row.eda_auc) == (0, 0, None) and row.eda_mean is not None


def test_axes_and_magnitude_paths(spark):
    rng = random.Random(1)
    rows = [("a", float(i), rng.gauss(0, 0.1), rng.gauss(0, 0.1), 1 + math.sin(2 * math.pi * i / 8)) for i in range(64)]
    table = samples(spark, rows, "subject string, seconds double, acc_x double, acc_y double, acc_z double")
    axes = features.compute_accelerometer_features(table, ["subject"], "timestamp").first()
    assert axes.acc_dominant_freq == pytest.approx(1 / 8) and axes.acc_activity_count > 0
    empty = table.select("subject", "timestamp", F.lit(None).cast("double").alias("acc_mag"))
    row = features.compute_window_features(empty, ["subject"]).first()
    assert (row.acc_mag_mean, row.acc_activity_count, row.acc_dominant_freq) == (None, 0, None)


def test_whole_window_with_nulls(spark):
    rows = [("f01", float(i), None if 10 <= i < 20 else 70.0 + i % 5, "stress" if i % 2 else "baseline") for i in range(60)]
    row = features.compute_window_features(
        samples(spark, rows, "subject string, seconds double, hr double, label string"), ["subject"]).first()
    assert (row.window_length, row.subject, row.label) == (60, "f01", "baseline") and row.hrv_hr_mean is not None
    assert "eda_mean" not in row.asDict()


def test_zero_heart_rate_is_no_interval(spark):
    rows = [("a", float(i), 0.0 if i == 5 else 60.0) for i in range(10)]
    row = features.compute_hrv_features(samples(spark, rows), ["subject"], "timestamp").first()
    assert row.hrv_hr_min == 0 and row.hrv_rmssd == 0


def test_unit_sine_has_half_power():
    t = np.arange(4000) / 4.0
    freq, psd = welch_psd(np.sin(2 * np.pi * 0.125 * t)[None, :], 4.0, 256)
    assert psd[0].sum() * freq[1] == pytest.approx(0.5, rel=1e-6) and freq[psd[0].argmax()] == 0.125


def plain_spaced(y, height, spacing):
    left = sorted((p for p in peak_positions(y) if y[p] >= height), key=lambda p: (y[p], p), reverse=True)
    kept = []
    for p in left:
        if all(abs(p - k) >= spacing for k in kept):
            kept.append(p)
    return len(kept)


@pytest.mark.parametrize("spacing", [2, 3, 7])
def test_spaced_peaks(spark, spacing):
    rng = np.random.default_rng(spacing)
    rows, expected = [], {}
    for i in range(150):
        y = rng.integers(0, 6, rng.integers(2, 40)).astype(float)
        rows += [(f"s{i:03d}", j / spacing, float(v)) for j, v in enumerate(y)]
        expected[f"s{i:03d}"] = plain_spaced(list(y), y.mean() + 0.5 * y.std(ddof=1), spacing)
    table = samples(spark, rows, "subject string, seconds double, eda_scl double")
    got = features.compute_eda_features(table, ["subject"], "timestamp", sampling_rate=float(spacing)).collect()
    assert {r.subject: r.eda_peak_count for r in got} == expected
    assert sum(expected.values()) > 100


def test_spaced_peaks_in_windows(spark):
    table = recording(spark, length=200, subjects=("f01",))
    options = WindowOptions(30, 15, 2.0, bucket="1 minute")
    got = {r.window_id: r for r in extract_features_from_windows(table, options).collect()}
    rows = table.orderBy("timestamp").collect()
    assert len(got) == (200 - 60) // 30 + 1
    for start in range(0, 141, 30):
        eda = [r.eda_scl for r in rows[start : start + 60] if r.eda_scl is not None]
        count = plain_spaced(eda, statistics.mean(eda) + 0.5 * statistics.stdev(eda), 2)
        row = got[f"f01_{start:06d}_{start + 60:06d}"]
        assert (row.eda_peak_count, row.eda_peak_rate) == (count, pytest.approx(count / (len(eda) / 2) * 60))


def test_band_powers_follow_the_sampling_rate(spark):
    """A breath every four seconds is high frequency, however often the heart rate is sampled."""
    from datetime import datetime, timedelta

    for rate in (1.0, 2.0, 4.0):
        n = int(120 * rate)
        beats = [60 / (0.8 + 0.05 * math.sin(2 * math.pi * 0.25 * i / rate)) for i in range(n)]
        start = datetime(2024, 1, 1)
        rows = [("w", start + timedelta(seconds=i / rate), b) for i, b in enumerate(beats)]
        df = spark.createDataFrame(rows, "window string, timestamp timestamp, hr double")
        got = features.compute_hrv_features(df, ["window"], "timestamp", sampling_rate=rate).first()
        assert got["hrv_hf_power"] > 10 * got["hrv_lf_power"]
