"""Queries over clips: signals, intervals, word windows and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import signal as S
from lectern.operators import intervals as I
from lectern.operators import report as R
from lectern.operators import samples as P
from lectern.operators import speech as D
from lectern.operators import validate as C
from lectern.operators import words as W
from lectern.options import AlignmentOptions, PostOptions, ValidationOptions
from lectern.plans import views as V

ALIGN, CHECKS = AlignmentOptions(), ValidationOptions()
#: Clipping level and voiced rate that suit the fixtures.
CLIP = 0.4


def _signal(name: str, rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return V.signal(spark, sf_dir).select("clip_id", F.round(rule(F.col("samples")), 6).alias(name))

    return run


def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.slices(spark, sf_dir)
    pairs = v.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "samples"))), lambda s: s["samples"]).alias("channels"))
    return pairs.select("clip_id", F.transform(S.downmix(F.col("channels")), lambda x: F.round(x, 6)).alias("mono")).select("clip_id", F.posexplode("mono").alias("pos", "x"))


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.signal(spark, sf_dir).select("clip_id", F.posexplode(S.cut(F.col("samples"), F.lit(2), F.lit(6))).alias("pos", "x"))


def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.segments(spark, sf_dir).groupBy("clip_id").agg(F.collect_list(F.struct("start", "end")).alias("segs"), F.max("end").alias("total"))
    return s.select("clip_id", F.round(S.speech_ratio(F.col("segs"), F.col("total")), 6).alias("ratio"))


def faded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.signal(spark, sf_dir).select("clip_id", F.posexplode(F.transform(S.faded(F.col("samples"), 5), lambda x: F.round(x, 9))).alias("pos", "x"))


def denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array(F.struct(F.lit(3).alias("start"), F.lit(12).alias("end")), F.struct(F.lit(20).alias("start"), F.lit(24).alias("end")))
    return V.signal(spark, sf_dir).select("clip_id", F.posexplode(F.transform(S.denoised(F.col("samples"), spans, 4), lambda x: F.round(x, 9))).alias("pos", "x"))


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.flatten(F.array_repeat("samples", 40))
    return V.signal(spark, sf_dir).select("clip_id", S.spectral_deviation(long, V.RATE).alias("centroid_std"))


def speech_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech by the level stand-in, in a task each batch."""

    def run(batches):
        for b in batches:
            b["segments"] = [[{"start": s, "end": e} for s, e in S.energy_segments(x, 4, -8.0)] for x in b["samples"]]
            yield b[["clip_id", "segments"]]

    found = V.signal(spark, sf_dir).mapInPandas(run, "clip_id long, segments array<struct<start:long,end:long>>")
    return found.select("clip_id", F.explode("segments").alias("s")).select("clip_id", "s.start", "s.end")


#: Frames and rules of the takes' speech.
VAD_FRAME = 8
VAD = PostOptions(vad_threshold=0.62, vad_min_silence_ms=500, vad_min_speech_ms=900, vad_speech_pad_ms=350)


def speech_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech of the takes by hysteresis, least silence and speech, and padding; times for 50 samples a second."""
    takes = V.takes(spark, sf_dir)
    lengths = takes.groupBy("clip_id").agg(F.sum(F.size("samples")).alias("total"))
    return D.speech_segments(D.frame_probabilities(takes, VAD_FRAME), lengths, VAD, V.TAKE_RATE, VAD_FRAME, 50)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_speech(V.segments(spark, sf_dir), V.words(spark, sf_dir), V.RATE)


def loud(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = V.slices(spark, sf_dir).select("clip_id", "seg_idx", S.dbfs(F.col("samples")).alias("db"))
    return I.loud_segments(levels, 3.0).select("clip_id", "seg_idx", F.round("db", 6).alias("db"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.with_severity(W.cleaned_words(V.words(spark, sf_dir)), ALIGN)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.issues(V.words(spark, sf_dir), ALIGN)


#: Limits that suit the takes.
LOOSE = ValidationOptions(max_silence_dbfs=-16.5, min_voiced_duration_per_syllable=0.09, max_voiced_duration_per_syllable=0.16, max_contiguous_silence_s=2.5, max_clipping_percentage=0.1, min_spectral_centroid_std_dev=1.1)
GAPS, RANGE = AlignmentOptions(gap_min_ms=250, gap_max_speech_ms=130), PostOptions(max_voiced_dynamic_range_db=5.0)
TAKE_FFT, TAKE_HOP = 16, 4


def _parts(spark: SparkSession, sf_dir: str) -> tuple:
    text = V.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("clip_id"), "text")
    return text, V.takes(spark, sf_dir), V.take_speech(spark, sf_dir), V.take_words(spark, sf_dir), V.TAKE_RATE, LOOSE, RANGE, GAPS, V.TAKE_CHUNK


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each take: level, kept speech, silences, syllables, clipping, issues and gaps."""
    return C.measured(*_parts(spark, sf_dir))[0]


def segment_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = P.sample_index(V.takes(spark, sf_dir))
    held = P.segment_levels(V.take_speech(spark, sf_dir), index, P.clip_levels(index), V.TAKE_CHUNK)
    return held.select("clip_id", "seg_idx", "n", "clipped", F.round("db", 6).alias("db"))


def kept_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.measured(*_parts(spark, sf_dir))[1].select("clip_id", "seg_idx", "start", "end")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = C.judged_clips(*_parts(spark, sf_dir), n_fft=TAKE_FFT, hop=TAKE_HOP)
    return held.select("clip_id", "is_ok", F.split("reason", ":")[0].alias("failed"))


def _verdict(*checks):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.validated(metrics(spark, sf_dir), [c for part in checks for c in part()]).select("clip_id", "is_ok", F.split("reason", ":")[0].alias("failed"))

    return run


ALL = (
    lambda: C.silence_check(LOOSE),
    lambda: C.duration_check(LOOSE),
    lambda: C.contiguous_silence_check(LOOSE),
    C.alignment_check,
    lambda: C.gap_check(ALIGN),
    lambda: C.clipping_check(LOOSE),
)


def spectral_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = V.signal(spark, sf_dir).select("clip_id", F.lit(8).alias("syllables"), F.flatten(F.array_repeat("samples", 40)).alias("samples"), S.dbfs(F.col("samples")).alias("db"))
    held = C.with_spectrum(clips, V.RATE, C.silence_check(CHECKS))
    return C.validated(held, C.silence_check(CHECKS) + C.spectral_check(CHECKS)).select("clip_id", "is_ok")


METRICS = ["db", "n_found", "n_removed", "voiced_per_syllable", "silence_s", "clipping", "centroid_std"]


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unpivoted(C.judged_clips(*_parts(spark, sf_dir), n_fft=TAKE_FFT, hop=TAKE_HOP, report=True), METRICS)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(spark, sf_dir).withColumn("value", F.round("value", 6))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.summary(reported(spark, sf_dir), [*METRICS, "not computed"])
    return s.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")])


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.words(spark, sf_dir).groupBy("clip_id").agg(F.sum("idx").alias("s"), F.max("score").alias("m"), F.bool_or(F.col("score") < 0.1).alias("any_low"), F.every(F.col("score") < 0.9).alias("all_low"), F.count("*").alias("n"), F.countDistinct("word").alias("d"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = V.words(spark, sf_dir).groupBy("clip_id").agg(F.when(F.count("*") % 7 == 0, "failed").otherwise("ok").alias("status"))
    return R.processed(clips)


_W = f"WITH {V.SQL_WORDS}"
_WS = f"{_W}, {V.SQL_SEGMENTS}"
_G = V.SQL_SIGNAL
_EDGE = r"[^\p{L}\p{N}_]+"
_THR = lambda t: "CASE " + " ".join(f"WHEN n >= {k} THEN {v}" for k, v in sorted(t.items(), reverse=True)) + " END"
SQL_GRADED = f"""clean AS (SELECT clip_id, idx AS orig_idx, regexp_replace(word, '^{_EDGE}|{_EDGE}$', '', 'g') AS word, start, "end", score FROM words),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY clip_id ORDER BY orig_idx) - 1)::INT AS idx, length(word) AS n FROM clean WHERE word <> ''),
graded AS (SELECT clip_id, orig_idx, idx, word, start, "end", score, (CASE WHEN regexp_full_match(word, '\\p{{N}}+') THEN 0 WHEN score < {_THR(ALIGN.critical)} THEN 3 WHEN score < {_THR(ALIGN.poor)} THEN 2 WHEN score < {_THR(ALIGN.weak)} THEN 1 ELSE 0 END)::INT AS severity FROM numbered),
stop AS (SELECT clip_id, min(idx) AS stop FROM graded WHERE severity >= 3 GROUP BY 1)"""


def _sql_runs(level: int, limit: int) -> str:
    return f"""SELECT clip_id, idx, word, score FROM (SELECT *, sum(CASE WHEN severity >= {level} THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, g ORDER BY idx) AS pos FROM (
  SELECT *, sum(CASE WHEN severity >= {level} THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY idx) AS g FROM graded)) WHERE severity >= {level} AND pos % {limit} = 0"""


_FRAME = "(PARTITION BY clip_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"
_SQL_DIP = f"SELECT clip_id, idx, word, score FROM (SELECT *, count(*) OVER {_FRAME} AS k, (sum(score) OVER {_FRAME} - score) / 3 AS o FROM graded) WHERE k = 4 AND length(word) >= 4 AND round(o - score, 9) > 0.4"
_SQL_LOW = f"SELECT clip_id, idx, word, score FROM (SELECT *, count(*) OVER {_FRAME} AS k, sum(score * (1.0 + length(word) * 0.15)) OVER {_FRAME} / sum(1.0 + length(word) * 0.15) OVER {_FRAME} AS m FROM graded) WHERE k = 4 AND round(m, 9) < 0.6"
SQL_ISSUES = f"""{SQL_GRADED}, later AS (
  SELECT *, 'consecutive_poor' AS type FROM ({_sql_runs(2, 2)}) UNION ALL SELECT *, 'consecutive_weak' FROM ({_sql_runs(1, 3)})
  UNION ALL SELECT *, 'dip' FROM ({_SQL_DIP}) UNION ALL SELECT *, 'window' FROM ({_SQL_LOW})
), issues AS (
  SELECT l.clip_id, idx, type, word, score FROM later l LEFT JOIN stop s ON l.clip_id = s.clip_id WHERE stop IS NULL OR idx < stop
  UNION ALL SELECT g.clip_id, idx, 'critical', word, score FROM graded g JOIN stop s ON g.clip_id = s.clip_id AND idx = stop)"""
SQL_MERGED = """timed AS (SELECT clip_id, trunc(start * 24000)::BIGINT AS start, trunc("end" * 24000)::BIGINT AS "end" FROM words UNION ALL SELECT clip_id, start, "end" FROM segments),
opened AS (SELECT *, max("end") OVER (PARTITION BY clip_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM timed),
islands AS (SELECT *, sum(CASE WHEN pe IS NULL OR start > pe THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM opened)
SELECT clip_id, min(start) AS start, max("end") AS "end" FROM islands GROUP BY clip_id, g"""
SQL_SILENCE = """silence AS (SELECT clip_id, max(greatest(0, start - coalesce(p, 0))) AS silence FROM (SELECT *, lag("end") OVER (PARTITION BY clip_id ORDER BY start, "end") AS p FROM segments) GROUP BY 1)"""
SQL_GAPS = """gaps AS (SELECT * FROM (SELECT clip_id, idx, "end" AS start, lead(start) OVER (PARTITION BY clip_id ORDER BY idx) AS "end" FROM words) WHERE "end" > start AND ("end" - start) * 1000 >= {ms})"""
SQL_GAP_SPEECH = """gap_speech AS (SELECT g.clip_id, g.idx, sum(least(s."end", trunc(g."end" * 24000)::BIGINT) - greatest(s.start, trunc(g.start * 24000)::BIGINT))::BIGINT AS speech
  FROM gaps g JOIN segments s ON g.clip_id = s.clip_id AND s.start < trunc(g."end" * 24000)::BIGINT AND s."end" > trunc(g.start * 24000)::BIGINT GROUP BY 1, 2)"""
_VOWELS = "[aeiouyáéíóúàèìòùâêîôûäëïöüãõœæ]+"
_DB = lambda rms: f"CASE WHEN {rms} IS NULL OR {rms} < 1e-9 THEN -180 ELSE 20 * log10({rms}) END"
_TAKES = f"WITH {V.SQL_TAKE_WORDS}, {V.SQL_TAKE_SPEECH}, {V.SQL_TAKES}"
SQL_LEVELS = f"""seg_sums AS (SELECT clip_id, seg_idx, start, "end", count(x) AS n, sqrt(avg(x * x)) AS rms, count(*) FILTER (abs(x) >= 0.999) AS clipped
  FROM segments s LEFT JOIN takes t USING (clip_id) WHERE t.pos IS NULL OR t.pos >= start AND t.pos < "end" GROUP BY ALL),
seg_levels AS (SELECT s.clip_id, s.seg_idx, s.start, s."end", coalesce(n, 0) AS n, coalesce(clipped, 0) AS clipped, {_DB("rms")} AS db FROM segments s LEFT JOIN seg_sums USING (clip_id, seg_idx)),
kept AS (SELECT * FROM (SELECT *, max(db) OVER (PARTITION BY clip_id) AS top, count(*) OVER (PARTITION BY clip_id) AS k FROM seg_levels) WHERE k < 2 OR db >= top - 5)"""
SQL_METRICS = f"""{SQL_ISSUES}, {SQL_LEVELS}, {SQL_GAPS.format(ms=250)}, {SQL_GAP_SPEECH.replace("24000", "40")},
tok AS (SELECT conv_id * 1000 + turn AS clip_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word FROM conversations),
cost AS (SELECT clip_id, greatest(1, len(regexp_extract_all(lower(word), '{_VOWELS}')) + len(regexp_extract_all(word, '[0-9A-Za-z_]-[0-9A-Za-z_]'))) AS s, regexp_replace(word, '^{_EDGE}|{_EDGE}$', '', 'g') AS w FROM tok),
base AS (SELECT clip_id, sum(s)::INT AS syllables, sum(CASE WHEN length(w) >= 7 AND len(list_distinct(string_split(w, ''))) / ln(length(w)) < 1.6 THEN greatest(1, ceil(length(w) / 4.0)) * 0.6 ELSE s * 0.16 END) AS most_s FROM cost GROUP BY 1),
level AS (SELECT clip_id, {_DB("sqrt(avg(x * x))")} AS db FROM takes GROUP BY 1),
spoken AS (SELECT clip_id, count(*) AS n_found, sum("end" - start) / 40.0::DOUBLE AS voiced_s, max(greatest(0, start - coalesce(p, 0))) / 40.0::DOUBLE AS silence_s, CASE WHEN sum(n) > 0 THEN 100.0::DOUBLE * sum(clipped) / sum(n) ELSE 0 END AS clipping
  FROM (SELECT *, lag("end") OVER (PARTITION BY clip_id ORDER BY start, "end") AS p FROM kept) GROUP BY 1),
aligned AS (SELECT clip_id, count(*) AS n_aligned, count(*) FILTER (idx % 3 <> 1) AS n_segments FROM words GROUP BY 1),
bad AS (SELECT clip_id, min(idx) AS bad_gap FROM gap_speech WHERE speech * 1000 / 40.0 > 130 GROUP BY 1),
metrics AS (SELECT clip_id, syllables, most_s, n_aligned, coalesce(n_found, 0) AS n_found, coalesce(n_segments, 0) - coalesce(n_found, 0) AS n_removed, coalesce(voiced_s, 0) AS voiced_s,
    CASE WHEN n_found > 0 THEN voiced_s / greatest(syllables, 1) END AS voiced_per_syllable, clipping, silence_s, bad_gap, issue, coalesce(db, -180) AS db
  FROM base LEFT JOIN spoken USING (clip_id) LEFT JOIN level USING (clip_id) LEFT JOIN aligned USING (clip_id) LEFT JOIN bad USING (clip_id)
  LEFT JOIN (SELECT clip_id, arg_min(type, (idx, type)) AS issue FROM issues GROUP BY 1) USING (clip_id))"""
SQL_CENTROIDS = """voiced AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY seg_idx, pos) - 1 AS i, x FROM kept JOIN takes USING (clip_id) WHERE pos >= start AND pos < "end"),
long AS (SELECT clip_id, count(*) AS n FROM voiced GROUP BY 1 HAVING count(*) >= 16),
frames AS (SELECT clip_id, n, unnest(range(n // 4 + 1)) AS f FROM long),
taps AS (SELECT clip_id, f, k, CASE WHEN j < 0 THEN -j WHEN j >= n THEN 2 * (n - 1) - j ELSE j END AS i FROM (SELECT *, f * 4 + k - 8 AS j FROM frames, (SELECT unnest(range(16)) AS k))),
bins AS (SELECT k, b, (0.5 - 0.5 * cos(2 * pi() * k / 16)) * cos(2 * pi() * k * b / 16) AS re, (0.5 - 0.5 * cos(2 * pi() * k / 16)) * sin(2 * pi() * k * b / 16) AS im FROM (SELECT unnest(range(16)) AS k), (SELECT unnest(range(9)) AS b)),
power AS (SELECT clip_id, f, b, sum(x * re) ** 2 + sum(x * im) ** 2 AS p FROM taps JOIN voiced USING (clip_id, i) JOIN bins USING (k) GROUP BY ALL),
centroids AS (SELECT clip_id, f, sum(p * b * 40 / 16.0) / (sum(p) + 1e-9) AS c FROM power GROUP BY ALL),
spectrum AS (SELECT clip_id, stddev_samp(c) AS centroid_std FROM centroids GROUP BY 1)"""
_FAIL = {
    "v01_silence": [("silence", "db < -16.5")],
    "v02_duration": [("too_short", "syllables >= 7 AND voiced_s < syllables * 0.09"), ("too_long", "syllables >= 7 AND voiced_s > most_s")],
    "v03_contiguous": [("contiguous_silence", "silence_s > 2.5")],
    "v04_alignment": [("no_words", "coalesce(n_aligned, 0) = 0"), ("alignment", "issue IS NOT NULL")],
    "v05_gap_speech": [("gap_speech", "bad_gap IS NOT NULL")],
    "v06_clipping": [("clipping", "clipping > 0.1")],
}
_SEVEN = [c for k in ("v01_silence", "v02_duration", "v03_contiguous", "v04_alignment", "v05_gap_speech", "v06_clipping") for c in _FAIL[k]] + [("spectrum", "syllables >= 7 AND centroid_std < 1.1")]


def _sql_verdict(checks: list[tuple[str, str]], more: str = "", table: str = "metrics") -> str:
    case = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in checks) + " END"
    return f"{_TAKES}, {SQL_METRICS}{more}, v AS (SELECT clip_id, {case} AS failed FROM {table}) SELECT clip_id, failed IS NULL AS is_ok, failed FROM v"


_ALL = f", {SQL_CENTROIDS}"
_BOTH = "(SELECT * FROM metrics LEFT JOIN spectrum USING (clip_id))"
_UNPIVOT = "UNION ALL ".join(f"SELECT clip_id, '{m}' AS metric, {m}::DOUBLE AS value FROM {_BOTH} WHERE {m} IS NOT NULL " for m in METRICS)

QUERIES = {
    "a01_dbfs": _signal("db", S.dbfs),
    "a02_downmix": downmix,
    "a03_slice": cut,
    "a04_clipping": _signal("clipping", lambda x: S.clipping_percent(x, CLIP)),
    "a05_spectrum": spectrum,
    "a06_speech_ratio": ratio,
    "a07_fade": faded,
    "a08_denoise": denoised,
    "a09_speech_runs": speech_runs,
    "a09_speech_rules": speech_rules,
    "i01_coalesce": merged,
    "i02_gap_speech": lambda s, d: I.gap_speech(I.word_gaps(V.words(s, d), 200), V.segments(s, d), V.RATE),
    "i03_word_gaps": lambda s, d: I.word_gaps(V.words(s, d), 200).select("clip_id", "idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end")),
    "i04_longest_silence": lambda s, d: I.longest_silence(V.segments(s, d)),
    "i05_loud_segments": loud,
    "i05_segment_levels": segment_levels,
    "i05_kept_speech": kept_speech,
    "w01_severity": lambda s, d: graded(s, d).select("clip_id", "orig_idx", "idx", "word", "severity"),
    "w02_weight": lambda s, d: V.words(s, d).select("clip_id", "idx", F.round(W.word_weight(F.col("word"), 1.0, 0.15), 6).alias("weight")),
    "w03_immediate_fail": lambda s, d: W.immediate_fail(graded(s, d), 3),
    "w04_runs": lambda s, d: W.runs(graded(s, d), 2, 2).select("clip_id", "idx", "word", "score"),
    "w05_dips": lambda s, d: W.dips(graded(s, d), 4, 0.4, 4).select("clip_id", "idx", "word", "score"),
    "w06_low_windows": lambda s, d: W.low_windows(graded(s, d), 4, 0.6, 1.0, 0.15).select("clip_id", "idx", "word", "score"),
    "w07_issues": issues,
    "v01_silence": _verdict(ALL[0]),
    "v02_duration": _verdict(ALL[1]),
    "v03_contiguous": _verdict(ALL[2]),
    "v04_alignment": _verdict(ALL[3]),
    "v05_gap_speech": _verdict(ALL[4]),
    "v06_clipping": _verdict(ALL[5]),
    "v07_spectrum": spectral_verdict,
    "v08_first_failure": judged,
    "g01_summary": summary,
    "g02_report": report,
    "g03_aggregates": totals,
    "g04_processed": counts,
}
ORACLES = {
    "a01_dbfs": f"WITH {_G}, r AS (SELECT clip_id, sqrt(list_avg(list_transform(samples, lambda x: x * x))) AS rms FROM signal) SELECT clip_id, round(CASE WHEN rms IS NULL OR rms < 1e-9 THEN -180 ELSE 20 * log10(rms) END, 6) AS db FROM r",
    "a02_downmix": f"WITH {V.SQL_SLICES}, e AS (SELECT clip_id, unnest(range(8))::INT AS pos, unnest(samples) AS x FROM slices) SELECT clip_id, pos, round(avg(x), 6) AS x FROM e GROUP BY 1, 2",
    "a03_slice": f"WITH {_G} SELECT clip_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS x FROM (SELECT clip_id, samples[3:6] AS s FROM signal)",
    "a04_clipping": f"WITH {_G} SELECT clip_id, round(100.0 * len(list_filter(samples, lambda x: abs(x) >= {CLIP})) / len(samples), 6) AS clipping FROM signal",
    "a06_speech_ratio": f'{_WS} SELECT clip_id, round(sum("end" - start) / max("end")::DOUBLE, 6) AS ratio FROM segments GROUP BY 1',
    "a07_fade": f"WITH {_G}, k AS (SELECT clip_id, samples, len(samples) AS n, least(5, len(samples) // 2) AS k FROM signal), e AS (SELECT *, unnest(range(n))::INT AS pos, unnest(samples) AS x FROM k) SELECT clip_id, pos, round(x * CASE WHEN pos < k THEN CASE WHEN k <= 1 THEN 0 ELSE pos / (k - 1)::DOUBLE END WHEN pos >= n - k THEN CASE WHEN k <= 1 THEN 0 ELSE (n - 1 - pos) / (k - 1)::DOUBLE END ELSE 1 END, 9) AS x FROM e",
    "a08_denoise": f"WITH {_G}, e AS (SELECT clip_id, unnest(range(len(samples)))::INT AS pos, unnest(samples) AS x FROM signal), s AS (SELECT *, CASE WHEN pos BETWEEN 3 AND 11 THEN least(pos - 3, 11 - pos) WHEN pos BETWEEN 20 AND 23 THEN least(pos - 20, 23 - pos) END AS near, CASE WHEN pos < 12 THEN 4 ELSE 2 END AS k FROM e) SELECT clip_id, pos, round(CASE WHEN near IS NULL THEN 0 WHEN near < k THEN x * near / (k - 1)::DOUBLE ELSE x END, 9) AS x FROM s",
    "a09_speech_runs": f"""WITH {_G}, e AS (SELECT clip_id, len(samples) // 4 AS n, unnest(range(len(samples))) AS pos, unnest(samples) AS x FROM signal),
f AS (SELECT clip_id, pos // 4 AS k, sqrt(avg(x * x)) AS rms FROM e WHERE pos // 4 < n GROUP BY ALL),
r AS (SELECT clip_id, k, k - row_number() OVER (PARTITION BY clip_id ORDER BY k) AS g FROM f WHERE 20 * log10(greatest(rms, 1e-9)) >= -8)
SELECT clip_id, min(k) * 4 AS start, max(k) * 4 + 4 AS "end" FROM r GROUP BY clip_id, g""",
    "a09_speech_rules": f"""WITH {V.SQL_TAKES}, f AS (SELECT clip_id, pos // 8 AS f, sqrt(avg(x * x)) AS rms FROM takes GROUP BY ALL),
m AS (SELECT clip_id, f, CASE WHEN rms / (rms + 0.1) >= 0.62 THEN 1 WHEN rms / (rms + 0.1) < 0.62 - 0.15 THEN 0 END AS mark FROM f),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY f ROWS UNBOUNDED PRECEDING), 0) AS sp FROM m),
r AS (SELECT *, sum(ch) OVER (PARTITION BY clip_id ORDER BY f) AS r FROM (SELECT *, (sp <> coalesce(lag(sp) OVER (PARTITION BY clip_id ORDER BY f), 0))::INT AS ch FROM s)),
runs AS (SELECT clip_id, r, min(sp) AS sp, min(f) AS a, max(f) FILTER (mark = 0) AS low FROM r GROUP BY ALL),
e AS (SELECT *, sp = 0 AND coalesce((low - a) * 8 >= 20, false) AS e FROM runs),
g AS (SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY clip_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e),
k AS (SELECT clip_id, min(a * 8) FILTER (sp = 1) AS s, max(a * 8) FILTER (e) AS z FROM g GROUP BY clip_id, g),
t AS (SELECT k.clip_id, s, coalesce(z, n) AS z, n FROM k JOIN turns USING (clip_id) WHERE s IS NOT NULL),
w AS (SELECT *, s - lag(z) OVER o AS b, lead(s) OVER o - z AS c, row_number() OVER o - 1 AS i FROM t WHERE z - s > 36 WINDOW o AS (PARTITION BY clip_id ORDER BY s))
SELECT clip_id, i::INT AS seg_idx, trunc(greatest(0, s - CASE WHEN b < 28 THEN b // 2 ELSE 14 END) * 1.25::DOUBLE)::BIGINT AS start, trunc(least(n, z + CASE WHEN c < 28 THEN c // 2 ELSE 14 END) * 1.25::DOUBLE)::BIGINT AS "end" FROM w""",
    "i01_coalesce": f"{_WS}, {SQL_MERGED}",
    "i02_gap_speech": f"{_WS}, {SQL_GAPS.format(ms=200)}, {SQL_GAP_SPEECH} SELECT * FROM gap_speech",
    "i03_word_gaps": f'{_W}, {SQL_GAPS.format(ms=200)} SELECT clip_id, idx, round(start, 6) AS start, round("end", 6) AS "end" FROM gaps',
    "i04_longest_silence": f"{_WS}, {SQL_SILENCE} SELECT * FROM silence",
    "i05_loud_segments": f"WITH {V.SQL_SLICES}, l AS (SELECT clip_id, seg_idx, 20 * log10(sqrt(list_avg(list_transform(samples, lambda x: x * x)))) AS db FROM slices), m AS (SELECT *, max(db) OVER (PARTITION BY clip_id) AS top FROM l) SELECT clip_id, seg_idx, round(db, 6) AS db FROM m WHERE db >= top - 3",
    "w01_severity": f"{_W}, {SQL_GRADED} SELECT clip_id, orig_idx, idx, word, severity FROM graded",
    "w02_weight": f"{_W} SELECT clip_id, idx, round(1.0 + length(word) * 0.15, 6)::DOUBLE AS weight FROM words",
    "w03_immediate_fail": f"{_W}, {SQL_GRADED} SELECT * FROM stop",
    "w04_runs": f"{_W}, {SQL_GRADED} {_sql_runs(2, 2)}",
    "w05_dips": f"{_W}, {SQL_GRADED} {_SQL_DIP}",
    "w06_low_windows": f"{_W}, {SQL_GRADED} {_SQL_LOW}",
    "w07_issues": f"{_W}, {SQL_ISSUES} SELECT * FROM issues",
    "i05_segment_levels": f"{_TAKES}, {SQL_LEVELS} SELECT clip_id, seg_idx, n, clipped, round(db, 6) AS db FROM seg_levels",
    "i05_kept_speech": f'{_TAKES}, {SQL_LEVELS} SELECT clip_id, seg_idx, start, "end" FROM kept',
    **{k: _sql_verdict(v) for k, v in _FAIL.items()},
    "v08_first_failure": _sql_verdict(_SEVEN, _ALL, _BOTH),
    "g01_summary": f"{_TAKES}, {SQL_METRICS}{_ALL}, u AS ({_UNPIVOT}), n AS (SELECT unnest(['" + "','".join([*METRICS, "not computed"]) + "']) AS metric) SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most FROM n LEFT JOIN u USING (metric) GROUP BY metric",
    "g02_report": f"{_TAKES}, {SQL_METRICS}{_ALL}, u AS ({_UNPIVOT}) SELECT clip_id, metric, round(value, 6) AS value FROM u",
    "g03_aggregates": f"{_W} SELECT clip_id, sum(idx)::BIGINT AS s, max(score) AS m, bool_or(score < 0.1) AS any_low, bool_and(score < 0.9) AS all_low, count(*) AS n, count(DISTINCT word) AS d FROM words GROUP BY 1",
    "g04_processed": f"{_W}, c AS (SELECT clip_id, count(*) % 7 = 0 AS bad FROM words GROUP BY 1) SELECT count(*) FILTER (NOT bad) AS n_processed, count(*) FILTER (bad) AS n_failed FROM c",
}
