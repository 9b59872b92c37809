"""Waveforms as chunks: rows (clip_id, chunk, samples) of a fixed number of samples, the last of a clip shorter.

No row holds a clip. A prefix-sum index over the chunks makes level and clipping of any
segment two look-ups, whatever its length: what the first and the last chunk it meets
have of it, and the difference of the sums before them, which are decimals and so exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.signal import dbfs_of

#: Samples of a chunk.
CHUNK = 1 << 16


def chunked(samples: DataFrame, size: int = CHUNK, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Chunks of rows (keys, pos, x); positions count from 0 without gaps."""
    chunk = F.floor(F.col("pos") / size).alias("chunk")
    held = samples.groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("x").cast("double").alias("x")))).alias("s"))
    return held.select(*keys, "chunk", F.transform("s", lambda s: s["x"]).alias("samples"))


def rechunked(chunks: DataFrame, size: int, to: int, keys: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Chunks of `size` samples as chunks of `to`."""
    base = F.col("chunk") * size
    met = chunks.withColumn("out", F.explode(F.sequence(F.floor(base / to), F.floor((base + F.size("samples") - 1) / to))))
    begin = F.greatest(base, F.col("out") * to)
    part = F.slice("samples", (begin - base + 1).cast("int"), (F.least(base + F.size("samples"), (F.col("out") + 1) * to) - begin).cast("int"))
    held = met.where(F.size("samples") > 0).groupBy(*keys, "out").agg(F.array_sort(F.collect_list(F.struct("chunk", part.alias("x")))).alias("parts"))
    return held.select(*keys, F.col("out").alias("chunk"), F.flatten(F.transform("parts", lambda p: p["x"])).alias("samples"))


def _energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def _clipped(x: Column, limit: float) -> Column:
    return F.size(F.filter(x, lambda v: F.abs(v) >= limit)).cast("long")


def sample_index(chunks: DataFrame, limit: float = 0.999) -> DataFrame:
    """Chunks with n, energy and clipped of their own, and before_energy and before_clipped of the clip's earlier ones."""
    exact = lambda e: e.cast("decimal(38,18)")
    own = chunks.withColumns({"n": F.size("samples").cast("long"), "energy": exact(_energy(F.col("samples"))), "clipped": _clipped(F.col("samples"), limit)})
    earlier = Window.partitionBy("clip_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(exact(F.sum(c).over(earlier)), exact(F.lit(0)))
    return own.withColumns({"before_energy": total("energy"), "before_clipped": F.coalesce(F.sum("clipped").over(earlier), F.lit(0))})


def clip_levels(index: DataFrame) -> DataFrame:
    """clip_id, total (samples), db of whole clips."""
    held = index.groupBy("clip_id").agg(F.sum("n").alias("total"), F.sum("energy").cast("double").alias("e"))
    return held.select("clip_id", "total", dbfs_of(F.when(F.col("total") > 0, F.sqrt(F.col("e") / F.col("total")))).alias("db"))


def segment_levels(segments: DataFrame, index: DataFrame, totals: DataFrame, size: int = CHUNK, limit: float = 0.999) -> DataFrame:
    """Segments (clip_id, seg_idx, start, end) with n (samples that the clip has of them), clipped and db.

    `totals` has clip_id and total; a segment, or what of it lies beyond the clip's end, has no samples there.
    """
    held = segments.join(totals.select("clip_id", "total"), "clip_id", "left")
    a = F.greatest(F.lit(0), F.least("start", F.coalesce("total", F.lit(0)))).cast("long")
    held = held.withColumn("a", a).withColumn("b", F.greatest(F.col("a"), F.least("end", F.coalesce("total", F.lit(0)))).cast("long"))
    first, last = F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size)
    ends = F.array_distinct(F.array(F.struct(first.alias("chunk"), F.lit(True).alias("opens")), F.struct(last.alias("chunk"), (first == last).alias("opens"))))
    look = held.where("b > a").select("clip_id", "seg_idx", "a", "b", (first != last).alias("long"), F.explode(ends).alias("e")).select("*", "e.chunk", "e.opens").drop("e")
    found = look.join(index, ["clip_id", "chunk"])
    at = F.greatest(F.lit(0), F.col("a") - F.col("chunk") * size).cast("int")
    part = F.slice("samples", at + 1, F.least(F.col("b") - F.col("chunk") * size, F.lit(size)).cast("int") - at)
    between = lambda before, own: F.when(F.col("long"), F.when(F.col("opens"), -(F.col(before) + F.col(own))).otherwise(F.col(before))).otherwise(0)
    found = found.select("clip_id", "seg_idx", _energy(part).alias("e"), between("before_energy", "energy").alias("m"), (_clipped(part, limit) + between("before_clipped", "clipped")).alias("c"))
    sums = found.groupBy("clip_id", "seg_idx").agg((F.sum("e") + F.sum("m").cast("double")).alias("e"), F.sum("c").alias("c"))
    n = F.col("b") - F.col("a")
    level = dbfs_of(F.when(n > 0, F.sqrt(F.col("e") / n)))
    return held.join(sums, ["clip_id", "seg_idx"], "left").select("clip_id", "seg_idx", "start", "end", n.alias("n"), F.coalesce("c", F.lit(0)).cast("long").alias("clipped"), level.alias("db"))


def voiced_samples(segments: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """clip_id, samples: the segments' samples (clip_id, seg_idx, start, end) end to end; a row holds a clip's speech."""
    met = segments.where("end > start").select("clip_id", "seg_idx", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("chunk"))
    at = F.greatest(F.lit(0), F.col("start") - F.col("chunk") * size).cast("int")
    part = F.slice("samples", at + 1, F.least(F.col("end") - F.col("chunk") * size, F.lit(size)).cast("int") - at)
    held = met.join(chunks, ["clip_id", "chunk"]).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "chunk", part.alias("x")))).alias("parts"))
    return held.select("clip_id", F.flatten(F.transform("parts", lambda p: p["x"])).alias("samples"))


def joined_chunks(placed: DataFrame, chunks: DataFrame, size: int = CHUNK, by: str = "doc_id") -> DataFrame:
    """The output of a timeline as chunks (by, chunk, samples): slices of segments, silence between them.

    `placed` has by, idx, slice_start, slice_end, out_start and out_total, in samples (see
    jobs.placed_samples); `chunks` has by, idx, chunk, samples of the segments. A chunk of
    a segment meets two chunks of the output at most; it is cut for them and goes where
    they are made, so no row holds a document or a segment.
    """
    base = F.col("chunk") * size
    a, b = F.greatest("slice_start", base), F.least("slice_end", base + F.size("samples"))
    cut = chunks.join(placed, [by, "idx"]).withColumns({"a": a, "b": b, "base": base}).where("b > a")
    cut = cut.withColumn("o", F.col("out_start") + F.col("a") - F.col("slice_start"))
    cut = cut.withColumn("out", F.explode(F.sequence(F.floor(F.col("o") / size), F.floor((F.col("o") + F.col("b") - F.col("a") - 1) / size))))
    begin = F.greatest("o", F.col("out") * size)
    end = F.least(F.col("o") + F.col("b") - F.col("a"), (F.col("out") + 1) * size)
    x = F.slice("samples", (begin - F.col("o") + F.col("a") - F.col("base") + 1).cast("int"), (end - begin).cast("int"))
    parts = cut.select(by, "out", F.struct((begin - F.col("out") * size).cast("int").alias("at"), x.alias("x")).alias("p")).groupBy(by, "out").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    # a row for each chunk of the output, those of silence too
    every = placed.groupBy(by).agg(F.max("out_total").alias("t")).where("t > 0").select(by, "t", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t") - 1) / size))).alias("out"))
    held = every.join(parts, [by, "out"], "left").withColumn("parts", F.coalesce("parts", F.expr("cast(array() as array<struct<at: int, x: array<double>>>)")))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    ends = lambda p: F.coalesce(p["at"] + F.size(p["x"]), F.lit(0))
    filled = F.flatten(F.transform("parts", lambda p, i: F.concat(zeros(p["at"] - ends(F.get("parts", i - 1))), p["x"])))
    long = F.least(F.col("t") - F.col("out") * size, F.lit(size)).cast("int")
    return held.select(by, F.col("out").alias("chunk"), F.concat(filled, zeros(long - ends(F.try_element_at("parts", F.lit(-1))))).alias("samples"))
