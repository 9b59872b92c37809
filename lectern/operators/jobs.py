"""Generation jobs: the grid, seeds, retries, the best candidate, and the assembled timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.options import PostOptions


def job_grid(segments: DataFrame, best_of: int) -> DataFrame:
    """Each segment once for each candidate; no shuffle."""
    return segments.withColumn("candidate_idx", F.explode(F.sequence(F.lit(0), F.lit(best_of - 1))))


def random_seed(*keys: Column) -> Column:
    """A seed of 1 to 2^31 - 1 that is the same whenever Spark computes it again."""
    return F.pmod(F.xxhash64(*keys), F.lit(2**31 - 1)) + 1


def assign_seeds(jobs: DataFrame, seed: int | list[int], *keys: str) -> DataFrame:
    """Seed of each candidate: base + 1000 times the candidate, or by place in a list; 0 or none is random."""
    c = F.col("candidate_idx")
    chance = random_seed(*map(F.col, keys), c, F.lit("seed"))
    if isinstance(seed, int):
        return jobs.withColumn("seed", chance if seed == 0 else (F.lit(seed) + 1000 * c).cast("long"))
    given = F.get(F.array(*[F.lit(int(s)).cast("long") for s in seed]) if seed else F.array().cast("array<long>"), c)
    return jobs.withColumn("seed", F.when(F.coalesce(given, F.lit(0)) == 0, chance).otherwise(given))


def retry_seeds(jobs: DataFrame, *keys: str) -> DataFrame:
    """Seed of each later attempt, shared by all segments of the candidate; the first attempt keeps its own."""
    again = random_seed(*map(F.col, keys), F.col("attempt"), F.col("candidate_idx"), F.lit("retry"))
    return jobs.withColumn("seed", F.when(F.col("attempt") == 0, F.col("seed")).otherwise(again))


def seed_batches(jobs: DataFrame) -> DataFrame:
    """seed, n: jobs that one generation call can take together."""
    return jobs.groupBy("seed").agg(F.count("*").alias("n"))


def settled(attempts: DataFrame) -> DataFrame:
    """One row for each job (segment_idx, candidate_idx): its first passing attempt, else its last, with status."""
    keys = ["segment_idx", "candidate_idx"]
    first = Window.partitionBy(*keys).orderBy(F.col("ok").desc(), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt")))
    held = attempts.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    return held.withColumn("status", F.when(F.col("ok"), "SUCCESS").otherwise("FAILED_FINAL"))


def job_score(words: DataFrame, speech_ratio: DataFrame, aligned: bool) -> DataFrame:
    """clip_id, score: mean of known word scores (0 without any), or the share of speech."""
    if not aligned:
        return speech_ratio.select("clip_id", F.col("ratio").alias("score"))
    return words.groupBy("clip_id").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"))


def best_candidates(jobs: DataFrame) -> DataFrame:
    """The successful job of each segment with the highest score; of equals the first candidate."""
    order = Window.partitionBy("segment_idx").orderBy(F.col("score").desc(), "candidate_idx")
    return jobs.where("ok").withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def failed_segments(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """segment_idx, text (100 characters), reason of its first failed job: segments without any success."""
    lost = segments.join(jobs.where("ok").select("segment_idx").distinct(), "segment_idx", "left_anti")
    why = jobs.where("not ok").groupBy("segment_idx").agg(F.min_by("reason", "candidate_idx").alias("reason"))
    return lost.join(why, "segment_idx", "left").select("segment_idx", F.substring("text", 1, 100).alias("text"), "reason")


def assemble(segments: DataFrame, o: PostOptions, by: str = "doc_id") -> DataFrame:
    """Where each segment lies in the output.

    Expects by, idx, boundary (after it), n (samples), rate, and in samples vad_start,
    vad_end, word_start, word_end, all nullable. Adds slice_start and slice_end, pause_ms
    before it, and offset_s at which its slice starts.
    """
    order = Window.partitionBy(by).orderBy("idx")
    first, last = F.lag("idx").over(order).isNull(), F.lead("idx").over(order).isNull()
    start = F.least(F.coalesce("vad_start", F.lit(0)), F.coalesce("word_start", "vad_start", F.lit(0)))
    end = F.greatest(F.coalesce("vad_end", "n"), F.coalesce("word_end", "vad_end", "n"))
    trim = F.lit(o.trim_segment_silence)
    begins = F.when(first, F.lit(o.lead_in_ms is not None)).otherwise(trim)
    ends = F.when(last, F.lit(o.lead_out_ms is not None)).otherwise(trim)
    after = F.lag("boundary").over(order)
    pause = F.when(after == "SENTENCE", o.silence_sentence_ms).when(after == "PARAGRAPH", o.silence_paragraph_ms).otherwise(o.silence_fallback_ms)
    held = segments.withColumns({"slice_start": F.when(begins, start).otherwise(F.lit(0)), "slice_end": F.least(F.when(ends, end).otherwise(F.col("n")), F.col("n")), "pause_ms": F.when(first, F.lit(o.lead_in_ms or 0)).otherwise(pause)})
    length = F.greatest(F.lit(0), F.col("slice_end") - F.col("slice_start")) / F.col("rate")
    total = F.sum(F.col("pause_ms") / 1000 + length).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("offset_s", total - length)


def placed_samples(segments: DataFrame, o: PostOptions, by: str = "doc_id") -> DataFrame:
    """assemble() in whole samples: also out_start, where a segment's slice begins in the output, and out_total, the output's length, silences before and after it included.

    Pauses are truncated to samples each; offset_s, in seconds, is not.
    """
    order = Window.partitionBy(by).orderBy("idx")
    pause = lambda ms: F.greatest(F.lit(0), (ms / 1000 * F.col("rate")).cast("long"))
    length = F.greatest(F.lit(0).cast("long"), F.col("slice_end") - F.col("slice_start"))
    held = assemble(segments, o, by)
    end = F.sum(pause(F.col("pause_ms")) + length).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("out_start", end - length).withColumn("out_end", end)
    return held.withColumn("out_total", F.max("out_end").over(Window.partitionBy(by)) + pause(F.lit(o.lead_out_ms or 0))).drop("out_end")


def shifted_words(words: DataFrame, placed: DataFrame, by: str = "doc_id") -> DataFrame:
    """Words (by, idx, word_idx, word, start, end in seconds) in output time; words without times are left out."""
    held = words.where("start is not null and end is not null").join(placed.select(by, "idx", "slice_start", "rate", "offset_s"), [by, "idx"])
    move = lambda c: F.greatest(F.lit(0.0), F.col(c) - F.col("slice_start") / F.col("rate")) + F.col("offset_s")
    return held.select(by, "idx", "word_idx", "word", move("start").alias("start"), move("end").alias("end"))


def joined_samples(parts: DataFrame, by: str = "doc_id") -> DataFrame:
    """Arrays of samples of each document put end to end in order of idx."""
    return parts.groupBy(by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "samples"))), lambda s: s["samples"])).alias("samples"))
