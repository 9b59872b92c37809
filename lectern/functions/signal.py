"""Waveform expressions over arrays of samples; spectra run in numpy, a batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level of silence.
FLOOR_DB = -180.0
N_FFT, HOP = 1024, 256


def dbfs_of(rms: Column) -> Column:
    return F.when(rms.isNull() | (rms < 1e-9), FLOOR_DB).otherwise(20 * F.log10(rms))


def dbfs(samples: Column) -> Column:
    """Level of an array of samples."""
    energy = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return dbfs_of(F.when(F.size(samples) > 0, F.sqrt(energy / F.size(samples))))


def downmix(channels: Column) -> Column:
    """Mean over an array of channels."""
    n = F.size(channels)
    zero = F.transform(F.get(channels, 0), lambda x: F.lit(0.0))
    total = F.aggregate(channels, zero, lambda a, c: F.zip_with(a, c, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


def cut(samples: Column, start: Column, end: Column) -> Column:
    """Samples from start up to end, counted from 0."""
    return F.slice(samples, start + 1, F.greatest(end - start, F.lit(0)))


def clipping_percent(samples: Column, limit: float = 0.999) -> Column:
    return F.when(F.size(samples) > 0, 100.0 * F.size(F.filter(samples, lambda x: F.abs(x) >= limit)) / F.size(samples)).otherwise(0.0)


def speech_ratio(segments: Column, total: Column) -> Column:
    """Share of samples in segments (array of start, end)."""
    spoken = F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return F.when(total > 0, spoken / total).otherwise(0.0)


def faded(samples: Column, fade: int, n: Column | None = None) -> Column:
    """Linear ramps at both ends, at most half as long as the samples each; `n` is their number, if it is cheaper to have than their size."""
    n = F.size(samples) if n is None else n
    k = F.least(F.lit(fade), F.floor(n / 2))
    ramp = lambda i: F.when(k <= 1, F.lit(0.0)).otherwise(i / (k - 1))
    return F.transform(samples, lambda x, i: x * F.when(i < k, ramp(i)).when(i >= n - k, ramp(n - 1 - i)).otherwise(1.0))


def denoised(samples: Column, segments: Column, fade: int) -> Column:
    """Zero outside the segments (array of start, end; in order, disjoint), ramps at the ends of each.

    Segments and the zeros before them are cut out and put end to end: every sample is touched once.
    """
    n = F.size(samples)
    upto = lambda x: F.least(x, n).cast("int")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)

    def part(s: Column, i: Column) -> Column:
        before = upto(F.coalesce(F.get(segments, i - 1)["end"], F.lit(0)))
        size = upto(s["end"]) - upto(s["start"])
        return F.concat(zeros(upto(s["start"]) - before), faded(F.slice(samples, upto(s["start"]) + 1, size), fade, size))

    rest = n - upto(F.coalesce(F.try_element_at(segments, F.lit(-1))["end"], F.lit(0)))
    return F.concat(F.flatten(F.transform(segments, part)), zeros(rest))


def centroid_deviation(samples: np.ndarray, rate: int, n_fft: int = N_FFT, hop: int = HOP) -> float | None:
    """Sample standard deviation over frames of the spectral centroid; None for too few samples or frames."""
    if len(samples) < n_fft:
        return None
    padded = np.pad(np.asarray(samples, np.float64), n_fft // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    centroids = power @ (np.arange(n_fft // 2 + 1) * rate / n_fft) / (power.sum(1) + 1e-9)
    return float(centroids.std(ddof=1)) if len(centroids) > 1 else None


def spectral_deviation(samples: Column, rate: int, n_fft: int = N_FFT, hop: int = HOP) -> Column:
    @F.pandas_udf("double")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda x: centroid_deviation(x, rate, n_fft, hop), na_action="ignore").astype("Float64")

    return run(samples)


def energy_segments(samples: np.ndarray, frame: int, limit_db: float) -> list[tuple[int, int]]:
    """Stand-in for a speech detector: runs of frames above a level."""
    n = len(samples) // frame
    if not n:
        return []
    level = np.sqrt((np.asarray(samples[: n * frame], np.float64).reshape(n, frame) ** 2).mean(1))
    on = np.concatenate([[0], (20 * np.log10(np.maximum(level, 1e-9)) >= limit_db).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(on)) * frame
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
