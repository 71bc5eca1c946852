"""Audio operators: sample arithmetic as array expressions, spectral features in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def amplify(samples: Column, factor: float = 32768.0) -> Column:
    """Samples times 2**15: from the unit interval to 16-bit values."""
    return F.transform(samples, lambda x: x * F.lit(factor))


def shift_scale(features: Column, mean: Column, std: Column) -> Column:
    """(x + mean) / std by position: the mean comes negated, as in stored cepstral statistics."""
    return F.transform(features, lambda x, i: (x + F.get(mean, i)) / F.get(std, i))


def frames(samples: Column, size: int, step: int) -> Column:
    """Overlapping frames that fit whole."""
    n = F.floor((F.size(samples) - size) / step).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(samples, i * step + 1, size))).otherwise(F.filter(F.array(samples), lambda x: F.lit(False)))


def stack_frames(rows: Column, m: int = 7, n: int = 6) -> Column:
    """Low frame rate: every n-th frame with its neighbours, m in all, edges repeated."""
    left = (m - 1) // 2
    count = F.ceil(F.size(rows) / n).cast("int")
    at = lambda i: F.get(rows, F.least(F.greatest(i, F.lit(0)), F.size(rows) - 1))
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: at(k * n + j - left))))
    return F.when(F.size(rows) > 0, each).otherwise(F.filter(rows, lambda x: F.lit(False)))


def mel(f):
    """Hertz to mel."""
    return 1127.0 * np.log1p(np.asarray(f, float) / 700.0)


def mel_bank(bins: int, size: int, rate: float, low: float = 20.0, high: float = 0.0) -> np.ndarray:
    """Triangular filters over the bins of a real Fourier transform of ``size`` points; ``high`` up to 0 counts from half the rate."""
    top = high if high > 0 else rate / 2 + high
    edges = np.linspace(mel(low), mel(top), bins + 2)
    at = mel(np.arange(size // 2) * rate / size)
    up = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(
    x: np.ndarray, rate: float = 16000, bins: int = 23, length_ms: float = 25, step_ms: float = 10, emphasis: float = 0.97, dither: float = 0.0,
    seed: int = 0, energy: bool = False, subtract_mean: bool = False, low: float = 20.0, high: float = 0.0
) -> np.ndarray:
    """Log mel energies of whole frames: DC removed, pre-emphasised, Povey-windowed, power spectrum, mel filters."""
    size, step = int(rate * length_ms / 1000), int(rate * step_ms / 1000)
    if len(x) < size:
        return np.zeros((0, bins + energy))
    x = np.asarray(x, float)
    f = np.lib.stride_tricks.sliding_window_view(x, size)[::step].copy()
    if dither:
        f += dither * np.random.default_rng(seed).standard_normal(f.shape)
    f -= f.mean(1, keepdims=True)
    e = np.log(np.maximum((f**2).sum(1), np.finfo(np.float32).eps))
    f -= emphasis * np.c_[f[:, :1], f[:, :-1]]
    f *= (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85
    n = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(f, n)[:, : n // 2]) ** 2
    out = np.log(np.maximum(power @ mel_bank(bins, n, rate, low, high).T, np.finfo(np.float32).eps))
    if energy:
        out = np.c_[e, out]
    return out - out.mean(0) if subtract_mean else out


def filter_bank(samples: Column, **options) -> Column:
    """``log_mel`` on an array column."""

    @F.pandas_udf("array<array<double>>")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else log_mel(np.asarray(x), **options).tolist())

    return apply(samples)


def resampled(x: np.ndarray, rate: float, to: float = 16000, taps: int = 32) -> np.ndarray:
    """Band-limited resampling by a windowed sinc."""
    x = np.asarray(x, float)
    if rate == to or not len(x):
        return x
    n, ratio = int(np.ceil(len(x) * to / rate)), min(1.0, to / rate)
    t = np.arange(n) * rate / to
    k = np.floor(t)[:, None].astype(int) + np.arange(-taps + 1, taps + 1)
    d = t[:, None] - k
    w = ratio * np.sinc(ratio * d) * np.where(np.abs(d) < taps, 0.5 + 0.5 * np.cos(np.pi * d / taps), 0)
    return (np.where((k >= 0) & (k < len(x)), x[np.clip(k, 0, len(x) - 1)], 0) * w).sum(1)


def resample(samples: Column, rate: float, to: float = 16000) -> Column:
    """``resampled`` on an array column."""

    @F.pandas_udf("array<double>")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else resampled(np.asarray(x), rate, to).tolist())

    return apply(samples)
