"""Speech from frame probabilities by rules, and resampling.

The model that gives a frame its probability is a boundary; what makes segments of
frames is here: a state with hysteresis, least silence, least speech, padding. All are
windows over a clip's frames or segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.options import PostOptions

#: Rate that speech is sought at, and samples of a frame there.
SPEECH_RATE, FRAME = 16_000, 512
#: A state ends below the threshold less this.
HYSTERESIS = 0.15
#: Zero crossings of the resampling kernel to each side, and its cut-off as a share of the lower rate's.
WIDTH, ROLLOFF = 6, 0.99


def frame_probabilities(chunks: DataFrame, frame: int = FRAME, reference: float = 0.1) -> DataFrame:
    """Stand-in for a model: clip_id, frame, p = rms / (rms + reference), of chunks whose size is a multiple of `frame`; the last frame may be short."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / frame).cast("int")), lambda k: F.slice("samples", k * frame + 1, F.lit(frame)))
    rms = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))
    held = chunks.where(F.size("samples") > 0).select("clip_id", "chunk", F.posexplode(F.transform(parts, rms)).alias("k", "rms"), F.lit(1).alias("one"))
    whole = chunks.agg(F.max(F.size("samples")).alias("size"))
    per = F.ceil(F.col("size") / frame)
    return held.join(F.broadcast(whole)).select("clip_id", (F.col("chunk") * per + F.col("k")).cast("long").alias("frame"), (F.col("rms") / (F.col("rms") + reference)).alias("p"))


def speech_segments(frames: DataFrame, lengths: DataFrame, o: PostOptions, rate: int = SPEECH_RATE, frame: int = FRAME, to_rate: int | None = None) -> DataFrame:
    """clip_id, seg_idx, start, end of speech in frames (clip_id, frame, p) of clips (clip_id, total: samples).

    Speech begins at vad_threshold and may end once below it by HYSTERESIS; it does where
    later frames so low come vad_min_silence_ms after the first, before the next at the
    threshold. What lasts vad_min_speech_ms or less is no speech. Segments get
    vad_speech_pad_ms at both ends, or half the gap where two would meet. Times in samples
    of `rate` are scaled to `to_rate` by truncation.
    """
    of = lambda ms: rate * ms / 1000
    clip = Window.partitionBy("clip_id").orderBy("frame")
    upto, earlier = clip.rowsBetween(Window.unboundedPreceding, 0), clip.rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("p") >= o.vad_threshold, 1).when(F.col("p") < o.vad_threshold - HYSTERESIS, 0)
    held = frames.withColumn("mark", state).withColumn("on", F.coalesce(F.last("mark", True).over(upto), F.lit(0)))
    runs = held.withColumn("r", F.sum((F.col("on") != F.coalesce(F.lag("on").over(clip), F.lit(0))).cast("int")).over(upto))
    low = F.max(F.when(F.col("mark") == 0, F.col("frame")))
    runs = runs.groupBy("clip_id", "r").agg(F.min("on").alias("on"), F.min("frame").alias("first"), F.max("frame").alias("last"), low.alias("low"))
    # a silence that is long enough ends speech, a shorter one (and one at the end of the clip) does not
    ends = (F.col("on") == 0) & ((F.col("low") - F.col("first")) * frame >= of(o.vad_min_silence_ms))
    order = Window.partitionBy("clip_id").orderBy("r")
    runs = runs.withColumn("g", F.coalesce(F.sum(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spoken = runs.withColumn("stop", F.when(ends, F.col("first") * frame)).groupBy("clip_id", "g").agg(F.min(F.when(F.col("on") == 1, F.col("first") * frame)).alias("start"), F.max("stop").alias("end"))
    spoken = spoken.where("start is not null").join(lengths.select("clip_id", "total"), "clip_id").withColumn("end", F.coalesce("end", "total"))
    spoken = spoken.where(F.col("end") - F.col("start") > of(o.vad_min_speech_ms))
    order = Window.partitionBy("clip_id").orderBy("start")
    pad = int(of(o.vad_speech_pad_ms))
    before, after = F.col("start") - F.lag("end").over(order), F.lead("start").over(order) - F.col("end")
    room = lambda gap: F.when(gap < 2 * pad, F.floor(gap / 2)).otherwise(pad)
    start = F.greatest(F.lit(0), F.col("start") - F.coalesce(room(before), F.lit(pad)))
    end = F.least(F.col("total"), F.col("end") + F.coalesce(room(after), F.lit(pad)))
    scaled = lambda c: (c * (F.lit(float(to_rate or rate)) / rate)).cast("long")
    return spoken.select("clip_id", (F.row_number().over(order) - 1).alias("seg_idx"), scaled(start).alias("start"), scaled(end).alias("end"))


def kernel(up: int, down: int) -> np.ndarray:
    """A row of taps for each of the `up` phases: a windowed sinc, WIDTH crossings to each side."""
    base = min(up, down) * ROLLOFF
    reach = math.ceil(WIDTH * down / base)
    t = np.arange(-reach, down + reach)[None] / down - np.arange(up)[:, None] / up
    t = np.clip(t * base, -WIDTH, WIDTH)
    return np.sinc(t) * np.cos(t * np.pi / WIDTH / 2) ** 2 * base / down


def resampled_array(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """A whole signal at another rate, with zeros beyond its ends: ceil(n * to / rate) samples."""
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    return _phases(np.asarray(x, np.float64), 0, len(x), 0, up, down) if up != down else np.asarray(x, np.float64)


def _phases(x: np.ndarray, base: int, total: int, first: int, up: int, down: int, stop: int | None = None) -> np.ndarray:
    """Output samples first up to stop (all, if None) from x, whose first sample is at `base` of a signal of `total`."""
    taps = kernel(up, down)
    reach = (taps.shape[1] - down) // 2
    m = np.arange(first, -(-total * up // down) if stop is None else stop)
    at = (m // up * down - reach - base)[:, None] + np.arange(taps.shape[1])[None]
    inside = (at >= 0) & (at < len(x))
    return (np.where(inside, x[np.clip(at, 0, max(0, len(x) - 1))], 0.0) * taps[m % up]).sum(axis=1) if len(x) else np.zeros(len(m))


def resampled(chunks: DataFrame, rate: int, to: int, size: int) -> DataFrame:
    """Chunks (clip_id, chunk, samples) of `size` samples at another rate: clip_id, chunk, samples.

    A chunk gives the output samples that begin in it; what its kernel needs beyond comes
    from its neighbours, as many samples as the kernel reaches. `size` is a multiple of
    the input's step (rate / gcd), so chunks of the output have one size too.
    """
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    if size % down:
        raise ValueError(f"chunks of {size} samples: a multiple of {down} is needed")
    reach = kernel(up, down).shape[1] - down  # both sides
    if reach > size:
        raise ValueError(f"chunks of {size} samples: the kernel needs {reach}")
    order = Window.partitionBy("clip_id").orderBy("chunk")
    tail = F.lag(F.slice("samples", F.greatest(F.lit(1), F.size("samples") - reach + 1), F.lit(reach))).over(order)
    head = F.lead(F.slice("samples", 1, reach)).over(order)
    none = F.array().cast("array<double>")
    held = chunks.select("clip_id", "chunk", F.coalesce(tail, none).alias("tail"), "samples", F.coalesce(head, none).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tail_, own, head_ in zip(*(b.column(c) for c in ("tail", "samples", "head"))):
                tail_, own, head_ = (np.asarray(v.values, np.float64) for v in (tail_, own, head_))
                out.append(_phases(np.concatenate([tail_, own, head_]), -len(tail_), len(own), 0, up, down))
            yield pa.record_batch([b.column("clip_id"), b.column("chunk"), pa.array(out, pa.list_(pa.float64()))], names=["clip_id", "chunk", "samples"])

    return held.mapInArrow(run, f"clip_id {chunks.schema['clip_id'].dataType.simpleString()}, chunk long, samples array<double>")
