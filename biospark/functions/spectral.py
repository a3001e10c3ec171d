"""Welch spectra of whole windows, as vectorised Arrow functions over array columns.

Rows of one Arrow batch are grouped by array length, so each length is a single matrix
computation. The arrays hold one window each, hence at most the window length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# The functions travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Band edges in Hz (both ends belong to the band), upsampling, segment limit.
LF_BAND = (0.04, 0.15)
HF_BAND = (0.15, 0.4)
UPSAMPLING = 4
RESAMPLED_RATE = 4.0
MAX_SEGMENT = 256
MIN_SAMPLES = 10
# A constant series leaves rounding noise instead of zero power.
ZERO_POWER = 1e-18


def welch_psd(x: np.ndarray, rate: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density of each row of ``x``: periodic Hann, half overlap, mean removed."""
    step = segment - segment // 2
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment) if segment > 1 else np.ones(1)
    pieces = np.lib.stride_tricks.sliding_window_view(x, segment, axis=1)[:, ::step]
    pieces = pieces - pieces.mean(axis=2, keepdims=True)
    power = np.abs(np.fft.rfft(pieces * taper, axis=2)) ** 2 / (rate * np.sum(taper**2))
    power[:, :, 1 : None if segment % 2 else -1] *= 2
    return np.fft.rfftfreq(segment, 1 / rate), power.mean(axis=1)


def _unit_trapezoid(y: np.ndarray) -> np.ndarray:
    return ((y[:, 1:] + y[:, :-1]) / 2).sum(axis=1)


def _band_powers(rr: np.ndarray, rate: float) -> np.ndarray:
    n = rr.shape[1]
    at = np.linspace(0, n - 1, UPSAMPLING * n)
    left = np.minimum(at.astype(int), n - 2)
    dense = rr[:, left] + (rr[:, left + 1] - rr[:, left]) * (at - left)
    freq, psd = welch_psd(dense, rate, min(MAX_SEGMENT, dense.shape[1] // 2))
    bands = [psd[:, (freq >= lo) & (freq <= hi)] for lo, hi in (LF_BAND, HF_BAND)]
    return np.column_stack([_unit_trapezoid(b) for b in bands])


def _by_length(arrays: pd.Series, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for every array length of at least ``least``."""
    sizes = arrays.map(lambda a: 0 if a is None else len(a)).to_numpy()
    for size in np.unique(sizes[sizes >= least]):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.stack([np.asarray(a, dtype=float) for a in arrays.iloc[rows]])


def band_powers(rate: float = RESAMPLED_RATE):
    """Arrow function: array of RR seconds -> struct(lf, hf); null below MIN_SAMPLES."""

    def powers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for arrays in batches:
            out = np.full((len(arrays), 2), np.nan)
            for rows, rr in _by_length(arrays, MIN_SAMPLES):
                out[rows] = _band_powers(rr, rate)
            yield pd.DataFrame(out, columns=["lf", "hf"])

    powers.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(powers, "lf double, hf double")


def dominant_frequency(rate: float = 1.0):
    """Arrow function: array -> frequency of the largest Welch bin (the lowest one on ties)."""

    def peak(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            out = np.full(len(arrays), np.nan)
            for rows, x in _by_length(arrays, 2):
                freq, psd = welch_psd(x, rate, min(MAX_SEGMENT, x.shape[1] // 2))
                out[rows] = freq[np.argmax(psd, axis=1)]
            yield pd.Series(out)

    peak.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(peak, "double")
