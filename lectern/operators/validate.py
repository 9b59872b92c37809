"""Clip validation: each check is a failure condition and a reason; the first that fails decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.lexical import syllables, word_budget
from lectern.functions.signal import HOP, N_FFT, spectral_deviation
from lectern.operators.intervals import gap_speech, loud_segments, word_gaps
from lectern.operators.samples import CHUNK, clip_levels, sample_index, segment_levels, voiced_samples
from lectern.operators.words import first_issue, issues
from lectern.options import AlignmentOptions, PostOptions, ValidationOptions
from lectern.shared import shared_folder, written

Check = tuple[str, Column, Column]


def _check(name: str, fails: Column, *reason) -> Check:
    parts = [r.cast("string") if isinstance(r, Column) else F.lit(r) for r in reason]
    return name, F.coalesce(fails, F.lit(False)), F.concat(F.lit(f"{name}: "), *[F.coalesce(p, F.lit("")) for p in parts])


def silence_check(o: ValidationOptions) -> list[Check]:
    """Expects db: the level of the whole clip."""
    return [] if o.max_silence_dbfs is None else [_check("silence", F.col("db") < o.max_silence_dbfs, "level ", F.round("db", 2))]


def contiguous_silence_check(o: ValidationOptions) -> list[Check]:
    """Expects silence_s: the longest silence."""
    return [] if o.max_contiguous_silence_s is None else [_check("contiguous_silence", F.col("silence_s") > o.max_contiguous_silence_s, "longest ", F.round("silence_s", 3))]


def duration_check(o: ValidationOptions) -> list[Check]:
    """Expects syllables, voiced_s, and most_s: the budget of the text (see duration_budget). A text of no syllables passes."""
    enough, out = (F.col("syllables") > 0) & (F.col("syllables") >= (o.min_syllables_for_duration_validation or 0)), []
    if o.min_voiced_duration_per_syllable is not None:
        out.append(_check("too_short", enough & (F.col("voiced_s") < F.col("syllables") * o.min_voiced_duration_per_syllable), "voiced ", F.round("voiced_s", 3)))
    if o.max_voiced_duration_per_syllable is not None:
        out.append(_check("too_long", enough & (F.col("voiced_s") > F.col("most_s")), "voiced ", F.round("voiced_s", 3)))
    return out


def duration_budget(text: Column, o: ValidationOptions) -> Column:
    """Longest time the words may take, word by word or by syllables alone; null if the limit is off."""
    rate = o.max_voiced_duration_per_syllable
    if rate is None:
        return F.lit(None).cast("double")
    if not o.use_word_level_duration_analysis:
        return syllables(text) * F.lit(rate)
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    cost = lambda t: word_budget(t, rate, o.min_word_len_for_low_complexity_analysis, o.low_complexity_log_variety_threshold, o.low_complexity_chars_per_syllable, o.low_complexity_max_duration_per_syllable)
    return F.aggregate(tokens, F.lit(0.0), lambda a, t: a + cost(t))


def alignment_check() -> list[Check]:
    """Expects n_aligned (words) and issue (type of the first issue, or null)."""
    return [_check("no_words", F.coalesce(F.col("n_aligned"), F.lit(0)) == 0), _check("alignment", F.col("issue").isNotNull(), F.col("issue"))]


def gap_check(o: AlignmentOptions) -> list[Check]:
    """Expects bad_gap: index of the first gap with too much speech (see bad_gaps), or null."""
    return [] if o.gap_max_speech_ms is None else [_check("gap_speech", F.col("bad_gap").isNotNull(), "after word ", F.col("bad_gap"))]


def bad_gaps(words: DataFrame, speech: DataFrame, rate: int, o: AlignmentOptions) -> DataFrame:
    """clip_id, bad_gap: index of the first gap between words that holds more speech than allowed."""
    found = gap_speech(word_gaps(words, o.gap_min_ms), speech, rate)
    return found.where(F.col("speech") * 1000 / rate > (o.gap_max_speech_ms or 0)).groupBy("clip_id").agg(F.min("idx").alias("bad_gap"))


def clipping_check(o: ValidationOptions) -> list[Check]:
    """Expects clipping: percent of clipped samples."""
    return [] if o.max_clipping_percentage is None else [_check("clipping", F.col("clipping") > o.max_clipping_percentage, F.round("clipping", 3))]


def spectral_check(o: ValidationOptions) -> list[Check]:
    """Expects centroid_std (null: not known) and syllables."""
    if o.min_spectral_centroid_std_dev is None:
        return []
    return [_check("spectrum", (F.col("syllables") >= (o.min_syllables_for_spectral_validation or 0)) & (F.col("centroid_std") < o.min_spectral_centroid_std_dev), F.round("centroid_std", 1))]


def first_failure(checks: list[Check]) -> Column:
    """Reason of the first check that fails; null if none does."""
    return F.coalesce(*[F.when(fails, reason) for _, fails, reason in checks]) if checks else F.lit(None).cast("string")


def validated(clips: DataFrame, checks: list[Check]) -> DataFrame:
    """`clips` with is_ok and reason."""
    return clips.withColumn("reason", first_failure(checks)).withColumn("is_ok", F.col("reason").isNull())


def with_spectrum(clips: DataFrame, rate: int, cheap: list[Check]) -> DataFrame:
    """centroid_std of column samples, computed only for clips that pass the cheap checks."""
    ok = reduce(lambda a, c: a & ~c[1], cheap, F.lit(True))
    return clips.withColumn("centroid_std", spectral_deviation(F.when(ok, F.col("samples")), rate))


def _once(df: DataFrame, name: str) -> DataFrame:
    """A table that is used more than once, written so that it is made once."""
    return written(df, shared_folder(df.sparkSession, name))


def indexed(chunks: DataFrame) -> DataFrame:
    """The prefix-sum index, with the chunks' samples, written: levels, segments and the spectrum all read it."""
    return _once(sample_index(chunks), "samples")


def measured(clips: DataFrame, chunks: DataFrame, speech: DataFrame, words: DataFrame, rate: int, o: ValidationOptions, post: PostOptions, align: AlignmentOptions, size: int = CHUNK, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What the checks need, one row for each clip, and the speech that passed the energy filter.

    Expects clip_id, text; chunks of samples (clip_id, chunk, samples); speech (clip_id,
    seg_idx, start, end in samples); words. Speech within max_voiced_dynamic_range_db of
    the clip's loudest segment is kept: n_found segments, n_removed others. From what is
    kept come voiced_s, silence_s and clipping (null without any); the level db is the
    whole clip's, and gaps between words are judged on all speech. `index` is indexed(chunks),
    if it is there already.
    """
    index = indexed(chunks) if index is None else index
    levels = clip_levels(index)
    judged = segment_levels(speech, index, levels, size)
    kept = _once(loud_segments(judged, post.max_voiced_dynamic_range_db), "speech")
    before = F.lag("end").over(Window.partitionBy("clip_id").orderBy("start", "end"))
    quiet = F.max(F.greatest(F.lit(0), F.col("start") - F.coalesce("before", F.lit(0))))
    spoken = kept.withColumn("before", before).groupBy("clip_id").agg(
        F.count("*").alias("n_found"),
        (F.sum(F.col("end") - F.col("start")) / rate).alias("voiced_s"),
        (quiet / rate).alias("silence_s"),
        F.when(F.sum("n") > 0, 100.0 * F.sum("clipped") / F.sum("n")).otherwise(0.0).alias("clipping"),
    )
    all_speech = speech.groupBy("clip_id").agg(F.count("*").alias("n_segments"))
    aligned = words.groupBy("clip_id").agg(F.count("*").alias("n_aligned"))
    found = first_issue(issues(words, align)).select("clip_id", F.col("type").alias("issue"))
    out = clips.select("clip_id", syllables(F.col("text")).alias("syllables"), duration_budget(F.col("text"), o).alias("most_s"))
    for part in (levels.drop("total"), spoken, all_speech, aligned, found, bad_gaps(words, speech, rate, align)):
        out = out.join(part, "clip_id", "left")
    n_found = F.coalesce("n_found", F.lit(0))
    out = out.withColumns({"n_found": n_found, "n_removed": F.coalesce("n_segments", F.lit(0)) - n_found, "voiced_s": F.coalesce("voiced_s", F.lit(0.0)), "db": F.coalesce("db", F.lit(-180.0))})
    return out.withColumn("voiced_per_syllable", F.when(F.col("n_found") > 0, F.col("voiced_s") / F.greatest("syllables", F.lit(1)))), kept


def judged_clips(clips: DataFrame, chunks: DataFrame, speech: DataFrame, words: DataFrame, rate: int, o: ValidationOptions, post: PostOptions, align: AlignmentOptions, size: int = CHUNK, n_fft: int = N_FFT, hop: int = HOP, report: bool = False) -> DataFrame:
    """measured() with centroid_std, is_ok and reason: level, then duration, silences, alignment and gaps on kept speech, then clipping and spectrum; the first that fails decides.

    The spectrum is computed for clips that pass all else, or with `report` for all.
    """
    index = indexed(chunks)
    held, kept = measured(clips, chunks, speech, words, rate, o, post, align, size, index)
    cheap = silence_check(o) + duration_check(o) + contiguous_silence_check(o) + alignment_check() + gap_check(align) + clipping_check(o)
    held = _once(validated(held, cheap), "judged")
    voiced = voiced_samples(kept if report else kept.join(held.where("is_ok").select("clip_id"), "clip_id", "left_semi"), index.select("clip_id", "chunk", "samples"), size)
    spectrum = voiced.select("clip_id", spectral_deviation(F.col("samples"), rate, n_fft, hop).alias("centroid_std"))
    return validated(held.drop("is_ok", "reason").join(spectrum, "clip_id", "left"), cheap + spectral_check(o))
