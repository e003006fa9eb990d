"""From samples to spectra: frames that cover a whole signal, windowed transforms, band-limited resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least power on the decibel scale.
LEAST_POWER = 1e-10
#: Zero crossings of the sinc to either side, and the share of the lower band that is kept, when resampling.
CROSSINGS, ROLLOFF = 6, 0.99


def scaled(values: Column, old: tuple[float, float], new: tuple[float, float]) -> Column:
    """Values brought linearly from one range to another, as 16-bit samples to [-1, 1]; none is clamped."""
    return F.transform(values, lambda x: (x - old[0]) * ((new[1] - new[0]) / (old[1] - old[0])) + new[0])


def framed(signal: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames of `size` samples every `hop`, as many as cover the signal, which is padded with zeros on both sides alike, one more after it than before where they are odd."""
    n = len(signal)
    count = 1 if n <= size else 1 + -(-(n - size) // hop)
    lacking = (count - 1) * hop + size - n
    padded = np.concatenate([np.zeros(lacking // 2), signal, np.zeros(lacking - lacking // 2)]) if lacking > 0 else signal
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][:count]


def window(name: str | None, size: int) -> np.ndarray:
    """A periodic window: hann, hamming, or ones for None."""
    if name is None:
        return np.ones(size)
    shape = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46)}
    if name not in shape:
        raise ValueError(f"window must be one of {(*shape, None)}")
    a, b = shape[name]
    return a - b * np.cos(2 * np.pi * np.arange(size) / size)


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A matrix at another size, its corners kept."""

    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.arange(m) * ((n - 1) / (m - 1)) if m > 1 else np.zeros(1)
        low = np.minimum(x.astype(int), n - 1)
        return low, np.minimum(low + 1, n - 1), x - low

    (a, b, s), (c, d, t) = at(image.shape[0], height), at(image.shape[1], width)
    rows = image[a] * (1 - s)[:, None] + image[b] * s[:, None]
    return rows[:, c] * (1 - t) + rows[:, d] * t


def resampled(wave: np.ndarray, rate: int, to: int) -> np.ndarray:
    """A wave at another sample rate, free of what the lower rate can't hold: each sample a sum of its neighbours by a sinc under a Hann window."""
    if rate <= 0 or to <= 0:
        raise ValueError("sample rates must be positive")
    if rate == to or not len(wave):
        return np.asarray(wave, np.float64)
    band = min(rate, to) * ROLLOFF
    half = CROSSINGS * rate / band  # in samples of the old rate
    n = -(-len(wave) * to // rate)
    reach = int(np.ceil(half)) + 1
    padded = np.concatenate([np.zeros(reach), np.asarray(wave, np.float64), np.zeros(reach + 1)])
    out = np.empty(n)
    taps = np.arange(-reach, reach + 1)
    for first in range(0, n, 8192):
        at = np.arange(first, min(first + 8192, n)) * rate / to
        near = np.floor(at).astype(int)
        t = (taps[None, :] - (at - near)[:, None]) * band / rate
        weight = np.where(np.abs(t) < CROSSINGS, np.sinc(t) * np.cos(np.pi * t / (2 * CROSSINGS)) ** 2, 0.0) * (band / rate)
        out[first : first + len(at)] = (padded[near[:, None] + taps[None, :] + reach] * weight).sum(axis=1)
    return out


def power_spectra(rows: DataFrame, signal_col: str, size: int, hop: int, taper: str | None = "hann", decibels: bool = False, shape: tuple[int, int] | None = None, out_col: str = "spectrum") -> DataFrame:
    """rows with `spectrum`, array<array<double>>: for each frame of the signal the power of size // 2 + 1 frequencies, on request in
    decibels and brought to `shape` (frames, frequencies) before that. A null signal has none, an empty one a frame of zeros; null samples count as zero."""
    if size < 1 or hop < 1:
        raise ValueError("size and hop must be positive")
    taken = window(taper, size)

    def spectrum(signal: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.rfft(framed(signal, size, hop) * taken, axis=1)) ** 2
        if shape and shape != power.shape:
            power = bilinear(power, *shape)
        return 10 * np.log10(np.maximum(power, LEAST_POWER)) if decibels else power

    kept = [c for c in rows.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signals = batch.column(batch.num_columns - 1)
            found = [None if s.as_py() is None else spectrum(np.nan_to_num(np.array(s.as_py(), np.float64))).tolist() for s in signals]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.list_(pa.float64())))], [*kept, out_col])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, F.col(signal_col).cast("array<double>").alias("_signal")).mapInArrow(run, f"{schema}, `{out_col}` array<array<double>>")


def resample(rows: DataFrame, signal_col: str, rate_col: str, to: int, out_col: str = "wave") -> DataFrame:
    """rows with `wave`, the signal at `to` samples a second; rows without a signal or a positive rate have none."""
    kept = [c for c in rows.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signals, rates = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            waves = [None if s is None or not r or r <= 0 else resampled(np.nan_to_num(np.array(s, np.float64)), r, to).tolist() for s, r in zip(signals, rates, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(waves, pa.list_(pa.float64()))], [*kept, out_col])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, F.col(signal_col).cast("array<double>").alias("_signal"), F.col(rate_col).cast("int").alias("_rate")).mapInArrow(run, f"{schema}, `{out_col}` array<double>")
