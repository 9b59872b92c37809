"""Word scores in order: severities, runs, dips and windows. Rows are (clip_id, idx, word, score).

Means are compared after rounding to nine places, so that the order of additions doesn't decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.lexical import is_numeric, trim_word
from lectern.options import AlignmentOptions

ISSUE = ("clip_id", "idx", "type", "word", "score")


def threshold(length: Column, table: dict[int, float]) -> Column:
    """Value of the largest key that is at most the length, else of the smallest key."""
    keys = sorted(table)
    out = F.lit(table[keys[0]])
    for k in keys[1:]:
        out = F.when(length >= k, table[k]).otherwise(out)
    return out


def severity(word: Column, score: Column, o: AlignmentOptions) -> Column:
    """3 critical, 2 poor, 1 weak, 0 fine; numbers are fine, a null score counts as 1."""
    length, score = F.length(word), F.coalesce(score, F.lit(1.0))
    out = F.when(score < threshold(length, o.critical), 3).when(score < threshold(length, o.poor), 2).when(score < threshold(length, o.weak), 1).otherwise(0)
    return F.when(is_numeric(word), 0).otherwise(out)


def cleaned_words(words: DataFrame) -> DataFrame:
    """Words without outer marks, empty ones left out, numbered anew; orig_idx keeps the place."""
    held = words.withColumn("word", trim_word(F.col("word"))).where("word <> ''").withColumnRenamed("idx", "orig_idx")
    return held.withColumn("idx", (F.row_number().over(Window.partitionBy("clip_id").orderBy("orig_idx")) - 1).cast("int"))


def with_severity(words: DataFrame, o: AlignmentOptions) -> DataFrame:
    return words.withColumn("severity", severity(F.col("word"), F.col("score"), o))


def immediate_fail(graded: DataFrame, level: int) -> DataFrame:
    """clip_id, stop: index of the first word of that severity or more."""
    return graded.where(F.col("severity") >= level).groupBy("clip_id").agg(F.min("idx").alias("stop"))


def run_hit(level: int, limit: int) -> Column:
    """Whether a run of words of that severity reaches the limit here, or a multiple of it; idx has no gaps."""
    before = F.max(F.when(F.col("severity") < level, F.col("idx"))).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return (F.col("severity") >= level) & ((F.col("idx") - F.coalesce(before, F.lit(-1))) % limit == 0)


def runs(graded: DataFrame, level: int, limit: int) -> DataFrame:
    """Rows at which a run of words of that severity reaches the limit; the count then starts anew."""
    return graded.withColumn("__hit", run_hit(level, limit)).where("__hit").drop("__hit")


def _order():
    return Window.partitionBy("clip_id").orderBy("idx")


def _frame(size: int):
    return _order().rowsBetween(-(size // 2), size - 1 - size // 2)


def word_weight(word: Column, base: float, per_char: float) -> Column:
    return base + F.length(word) * per_char


def dip_hit(size: int, limit: float, least_len: int) -> Column:
    """Whether the centre of a full window scores less than the mean of the others by more than the limit."""
    w, s = _frame(size), F.coalesce("score", F.lit(1.0))
    return (F.count("*").over(w) == size) & (F.length("word") >= least_len) & (F.round((F.sum(s).over(w) - s) / (size - 1) - s, 9) > limit)


def dips(graded: DataFrame, size: int, limit: float, least_len: int) -> DataFrame:
    """Words at which dip_hit() holds."""
    return graded.withColumn("__hit", dip_hit(size, limit, least_len)).where("__hit").drop("__hit")


def low_hit(size: int, limit: float, base: float, per_char: float) -> Column:
    """Whether the weighted mean score of a full window around the word is below the limit."""
    w, s, weight = _frame(size), F.coalesce("score", F.lit(1.0)), word_weight(F.col("word"), base, per_char)
    mean = F.sum(s * weight).over(w) / F.nullif(F.sum(weight).over(w), F.lit(0.0))
    return (F.count("*").over(w) == size) & F.coalesce(F.round(mean, 9) < limit, F.lit(False))


def low_windows(graded: DataFrame, size: int, limit: float, base: float, per_char: float) -> DataFrame:
    """Words at which low_hit() holds."""
    return graded.withColumn("__hit", low_hit(size, limit, base, per_char)).where("__hit").drop("__hit")


def issues(words: DataFrame, o: AlignmentOptions) -> DataFrame:
    """Every distinct issue: clip_id, idx, type, word, score. Nothing after an immediate failure counts.

    All checks are windows over one partitioning by clip, so words are shuffled once.
    """
    critical = F.col("severity") >= o.immediate_fail_severity
    stop = F.min(F.when(critical, F.col("idx"))).over(Window.partitionBy("clip_id"))
    early = F.col("__stop").isNull() | (F.col("idx") < F.col("__stop"))
    hits = {"critical": F.col("idx") == F.col("__stop")}
    if o.consecutive_poor_limit:
        hits["consecutive_poor"] = early & run_hit(2, o.consecutive_poor_limit)
    if o.consecutive_weak_limit:
        hits["consecutive_weak"] = early & run_hit(1, o.consecutive_weak_limit)
    if o.dip_threshold is not None:
        hits["dip"] = early & dip_hit(o.window_size, o.dip_threshold, o.dip_min_word_len)
    if o.window_average is not None:
        hits["window"] = early & low_hit(o.window_size, o.window_average, o.window_base_weight, o.window_weight_per_char)
    held = with_severity(cleaned_words(words), o).withColumn("__stop", stop)
    types = F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits.items()]), lambda t: t.isNotNull())
    return held.withColumn("__types", types).withColumn("type", F.explode("__types")).select(*ISSUE)


def first_issue(found: DataFrame) -> DataFrame:
    """The issue of each clip with the smallest index; ties by type."""
    return found.groupBy("clip_id").agg(F.min(F.struct("idx", "type", "word", "score")).alias("i")).select("clip_id", "i.*")
