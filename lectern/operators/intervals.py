"""Ordered intervals per clip: merging, gaps, overlaps, levels. Rows are (clip_id, ..., start, end), half open.

Everything is partitioned by clip_id; nothing orders a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_samples(seconds: Column, rate: int) -> Column:
    """Sample number, truncated."""
    return (seconds * rate).cast("long")


def coalesce_intervals(intervals: DataFrame) -> DataFrame:
    """clip_id, start, end of merged intervals; those that touch merge."""
    order = Window.partitionBy("clip_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("opens", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    grouped = opened.withColumn("g", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("clip_id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def merge_speech(speech: DataFrame, words: DataFrame, rate: int) -> DataFrame:
    """Speech segments merged with the words' intervals; clips without timed words keep their speech as it is."""
    timed = words.where("start is not null and end is not null").select("clip_id", to_samples(F.col("start"), rate).alias("start"), to_samples(F.col("end"), rate).alias("end"))
    has = timed.select("clip_id").distinct()
    merged = coalesce_intervals(speech.select("clip_id", "start", "end").join(has, "clip_id", "left_semi").unionByName(timed))
    return merged.unionByName(speech.select("clip_id", "start", "end").join(has, "clip_id", "left_anti"))


def word_gaps(words: DataFrame, least_ms: float) -> DataFrame:
    """clip_id, idx, start, end (seconds) of gaps after a word of at least so many milliseconds."""
    order = Window.partitionBy("clip_id").orderBy("idx")
    held = words.where("start is not null and end is not null").withColumn("next", F.lead("start").over(order))
    gaps = held.select("clip_id", "idx", F.col("end").alias("start"), F.col("next").alias("end"))
    return gaps.where((F.col("end") > F.col("start")) & ((F.col("end") - F.col("start")) * 1000 >= least_ms))


def gap_speech(gaps: DataFrame, speech: DataFrame, rate: int) -> DataFrame:
    """clip_id, idx, speech: samples of speech inside each gap that has any.

    A sweep instead of a join: starts and ends of segments and the edges of gaps are one
    ordered stream of a clip. With running counts and sums of starts and ends, the speech
    up to t is t * (starts - ends) - (sum of starts - sum of ends); a gap has the
    difference between its edges. Segments that overlap count twice where they do.
    """
    none = F.lit(0).cast("long")
    edge = lambda df, t, n, at, idx, sign: df.select("clip_id", t.alias("t"), n.alias("n"), at.alias("at"), idx.alias("idx"), F.lit(sign).alias("sign"))
    a, b, idx = to_samples(F.col("start"), rate), to_samples(F.col("end"), rate), F.col("idx").cast("long")
    start, end, one = F.col("start").cast("long"), F.col("end").cast("long"), F.lit(1).cast("long")
    stream = edge(gaps, a, none, none, idx, -1).unionByName(edge(gaps, b, none, none, idx, 1))
    held = speech.where("end > start")
    stream = stream.unionByName(edge(held, start, one, start, F.lit(None).cast("long"), 0)).unionByName(edge(held, end, -one, -end, F.lit(None).cast("long"), 0))
    upto = Window.partitionBy("clip_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # edges at t add nothing up to t
    swept = stream.withColumn("f", F.col("t") * F.sum("n").over(upto) - F.sum("at").over(upto)).where("sign <> 0")
    kind = gaps.schema["idx"].dataType
    return swept.groupBy("clip_id", F.col("idx").cast(kind).alias("idx")).agg(F.sum(F.col("sign") * F.col("f")).alias("speech")).where("speech > 0")


def longest_silence(speech: DataFrame) -> DataFrame:
    """clip_id, silence: the longest gap before a segment, the one from 0 included, the one after the last not. Segments come by start, then end."""
    before = F.lag("end").over(Window.partitionBy("clip_id").orderBy("start", "end"))
    gaps = speech.withColumn("gap", F.greatest(F.lit(0), F.col("start") - F.coalesce(before, F.lit(0))))
    return gaps.groupBy("clip_id").agg(F.max("gap").alias("silence"))


def loud_segments(levels: DataFrame, range_db: float | None) -> DataFrame:
    """Rows (clip_id, ..., db) within `range_db` of the clip's loudest; all of a clip with fewer than two."""
    if range_db is None:
        return levels
    clip = Window.partitionBy("clip_id")
    held = levels.withColumn("__top", F.max("db").over(clip)).withColumn("__n", F.count("*").over(clip))
    return held.where((F.col("__n") < 2) | (F.col("db") >= F.col("__top") - range_db)).drop("__top", "__n")
