"""Loudness of chunked waveforms, and gain to a level.

K-weighting is two recursive filters. Their state at the start of a chunk depends on all
before it, but linearly: a chunk filtered from rest leaves a state, and what it got before
is carried through by a power of one small matrix. So all chunks are filtered at once from
rest, the states of a clip's chunks are added up in order, four numbers a chunk, and a
second pass starts each chunk from its own. Energies of 100 ms go into blocks of 400 ms by
windows, gates by two means.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.options import PostOptions

# Gates, offset and filters of the published loudness measure, and its true peak limit here.
ABSOLUTE_GATE, RELATIVE_GATE, OFFSET = -70.0, -10.0, -0.691
SHELF = (1681.974450955533, 3.999843853973347, 0.7071752369554196)
HIGH_PASS = (38.13547087602444, 0.5003270373238773)
PEAK_DB = -2.0
#: Parts of a block of 400 ms.
PARTS = 4
#: Samples filtered together, and rows from which that is worth it.
AT_ONCE, LEAST_ROWS = 1 << 20, 32


def filters(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Coefficients (b, a) of the high shelf and the high pass at a rate."""
    f, gain, q = SHELF
    if rate <= 2 * f:
        raise ValueError(f"rate {rate} has no place for a shelf at {f:.0f} Hz")
    k, vh = math.tan(math.pi * f / rate), 10 ** (gain / 20)
    vb, n = vh**0.4996667741545416, 1 + k / q + k * k
    shelf = np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / n, np.array([1, 2 * (k * k - 1) / n, (1 - k / q + k * k) / n])
    f, q = HIGH_PASS
    k = math.tan(math.pi * f / rate)
    n = 1 + k / q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / n, (1 - k / q + k * k) / n]))]


def step_matrix(rate: int) -> np.ndarray:
    """What one sample of zero makes of the four states of both filters."""
    (b1, a1), (b2, a2) = filters(rate)
    one = lambda b, a: np.array([[-a[1], 1.0], [-a[2], 0.0]])
    m = np.zeros((4, 4))
    m[:2, :2], m[2:, 2:] = one(b1, a1), one(b2, a2)
    m[2:, 0] = [b2[1] - a2[1] * b2[0], b2[2] - a2[2] * b2[0]]  # the first filter's output, its first state, goes into the second
    return m


def weighted(x: np.ndarray, rate: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x through both filters from a state (transposed direct form), and the state after it."""
    out, state = np.asarray(x, np.float64), np.array(state, np.float64)
    for k, (b, a) in enumerate(filters(rate)):
        s1, s2 = state[2 * k], state[2 * k + 1]
        b0, b1, b2, a1, a2 = *b.tolist(), *a[1:].tolist()
        y = []
        for v in out.tolist():
            r = b0 * v + s1
            s1, s2 = b1 * v - a1 * r + s2, b2 * v - a2 * r
            y.append(r)
        out, state[2 * k], state[2 * k + 1] = np.array(y), s1, s2
    return out, state


def weighted_rows(x: np.ndarray, rate: int, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """weighted() of many signals of one length, a row each, sample after sample for all rows at once: the same operations in the same order."""
    out, states = np.array(x.T, np.float64), np.array(states, np.float64)
    for k, (b, a) in enumerate(filters(rate)):
        s1, s2 = states[:, 2 * k].copy(), states[:, 2 * k + 1].copy()
        b0, b1, b2, a1, a2 = *b.tolist(), *a[1:].tolist()
        for t, v in enumerate(out):
            r = b0 * v + s1
            s1, s2 = b1 * v - a1 * r + s2, b2 * v - a2 * r
            out[t] = r
        states[:, 2 * k], states[:, 2 * k + 1] = s1, s2
    return out.T, states


def weighted_batch(xs: list[np.ndarray], rate: int, states: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, filtered samples and state after them of each signal: those of one length together, AT_ONCE samples or less."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(xs):
        places.setdefault(len(x), []).append(i)
    for n, found in places.items():
        per = max(1, AT_ONCE // max(1, n))
        for at in range(0, len(found), per):
            some = found[at : at + per]
            if len(some) < LEAST_ROWS:
                made = [weighted(xs[i], rate, states[i]) for i in some]
            else:
                made = zip(*weighted_rows(np.stack([xs[i] for i in some]), rate, states[some]))
            yield from ((i, *m) for i, m in zip(some, made))


def _samples(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) for x in batch.column("samples")]


def _ends(batches: Iterator[pa.RecordBatch], rate: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xs = _samples(b)
        ends = [[]] * len(xs)
        for i, _, state in weighted_batch(xs, rate, np.zeros((len(xs), 4))):
            ends[i] = state.tolist()
        yield pa.record_batch([b.column("clip_id"), b.column("chunk"), pa.array([len(x) for x in b.column("samples")], pa.int64()), pa.array(ends, pa.list_(pa.float64()))], names=["clip_id", "chunk", "n", "state"])


def _carried(batches: Iterator[pa.RecordBatch], rate: int) -> Iterator[pa.RecordBatch]:
    """Clips with the ends of their chunks: the state that each chunk starts from."""
    one = step_matrix(rate)
    powers: dict[int, np.ndarray] = {}
    for b in batches:
        for clip, chunks in zip(b.column("clip_id"), b.column("ends").to_pylist()):
            state, rows, at = np.zeros(4), [], 0
            for c in chunks:
                rows.append((c["chunk"], at, state.tolist()))
                if c["n"] not in powers:
                    powers[c["n"]] = np.linalg.matrix_power(one, c["n"])
                state, at = powers[c["n"]] @ state + np.array(c["state"]), at + c["n"]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.record_batch([pa.array([clip.as_py()] * len(rows), b.column("clip_id").type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["clip_id", "chunk", "base", "state"])


def _energies(batches: Iterator[pa.RecordBatch], rate: int) -> Iterator[pa.RecordBatch]:
    """Energy of the weighted samples of each 100 ms that a chunk meets, and its highest sample."""
    for b in batches:
        xs, clips, bases, rows = _samples(b), b.column("clip_id"), b.column("base").to_pylist(), []
        for i, y, _ in weighted_batch(xs, rate, np.array(b.column("state").to_pylist()).reshape(-1, 4)):
            part = (bases[i] + np.arange(len(y))) * 10 // rate
            first = int(part[0]) if len(part) else 0
            e = np.bincount(part - first, y * y) if len(part) else np.zeros(0)
            rows.append((np.full(len(e), i), first + np.arange(len(e)), e, np.bincount(part - first) if len(part) else np.zeros(0, np.int64), np.full(len(e), np.abs(xs[i]).max(initial=0.0))))
        if rows:
            at, *columns = (np.concatenate(c) for c in zip(*rows))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.record_batch([clips.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["clip_id", "part", "e", "n", "peak"])


def loudness(chunks: DataFrame, rate: int) -> DataFrame:
    """clip_id, loudness (null for a clip without a block of 400 ms above the absolute gate), peak, of chunks (clip_id, chunk, samples); `rate` is a multiple of 10."""
    if rate % 10:
        raise ValueError(f"rate {rate} is no multiple of 10")
    kind = chunks.schema["clip_id"].dataType.simpleString()
    ends = chunks.mapInArrow(lambda b: _ends(b, rate), f"clip_id {kind}, chunk long, n long, state array<double>")
    ends = ends.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "n", "state"))).alias("ends"))  # four numbers a chunk
    begins = ends.mapInArrow(lambda b: _carried(b, rate), f"clip_id {kind}, chunk long, base long, state array<double>")
    held = chunks.join(begins, ["clip_id", "chunk"]).select("clip_id", "samples", "base", "state")
    parts = held.mapInArrow(lambda b: _energies(b, rate), f"clip_id {kind}, part long, e double, n long, peak double")
    peaks = parts.groupBy("clip_id", "part").agg(F.sum("e").alias("e"), F.sum("n").alias("n"), F.max("peak").alias("peak"))
    frame = Window.partitionBy("clip_id").orderBy("part").rowsBetween(1 - PARTS, 0)
    blocks = peaks.select("clip_id", "peak", F.sum("e").over(frame).alias("e"), F.sum("n").over(frame).alias("n")).withColumn("whole", F.col("n") == PARTS * rate // 10)
    mean = F.col("e") / F.col("n")
    level = lambda m: OFFSET + 10 * F.log10(m)
    blocks = blocks.withColumn("m", F.when(F.col("whole") & (mean > 0), mean))
    loud = blocks.where(level(F.col("m")) > ABSOLUTE_GATE)
    gate = loud.groupBy("clip_id").agg((level(F.avg("m")) + RELATIVE_GATE).alias("gate"))
    found = loud.join(gate, "clip_id").where(level(F.col("m")) > F.col("gate")).groupBy("clip_id").agg(level(F.avg("m")).alias("loudness"))
    return blocks.groupBy("clip_id").agg(F.max("peak").alias("peak")).join(found, "clip_id", "left").select("clip_id", "loudness", "peak")


def normalized(chunks: DataFrame, rate: int, o: PostOptions) -> DataFrame:
    """Chunks at normalize_level: by loudness (`ebu`; no sample goes beyond PEAK_DB) or with the highest sample at PEAK_DB (`peak`).

    Clips without a loudness, and silent ones, stay as they are; all do without normalize_audio.
    """
    if not o.normalize_audio:
        return chunks
    ceiling = 10 ** (PEAK_DB / 20)
    to_peak = F.when(F.col("peak") > 0, ceiling / F.col("peak")).otherwise(1.0)
    to_level = F.coalesce(F.pow(F.lit(10.0), (o.normalize_level - F.col("loudness")) / 20), F.lit(1.0))
    gain = to_peak if o.normalize_method == "peak" else F.when(F.col("loudness").isNull(), 1.0).otherwise(F.least(to_level, to_peak))
    gains = loudness(chunks, rate).select("clip_id", gain.alias("gain"))
    return chunks.join(gains, "clip_id").select("clip_id", "chunk", F.transform("samples", lambda x: x * F.col("gain")).alias("samples"))
