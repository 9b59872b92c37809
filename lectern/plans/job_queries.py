"""Queries of the job grid, the timeline, sources and extension points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import engines as E
from lectern.operators import jobs as J
from lectern.operators import loudness as N
from lectern.operators import samples as P
from lectern.operators import voices as VO
from lectern.options import PostOptions
from lectern.plans import views as V
from lectern.shared import shared_folder, written
from lectern.sources import audio as A
from lectern.sources import requests as Q

POST = PostOptions(lead_in_ms=120)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("segment_idx"), "text")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_grid(turns(spark, sf_dir).select("segment_idx"), 3)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = V.words(spark, sf_dir).withColumn("score", F.when(F.col("idx") % 4 != 0, F.col("score")))
    return J.job_score(w, w, True).withColumn("score", F.round("score", 6))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.assemble(V.timeline(spark, sf_dir), POST).select("doc_id", "idx", "slice_start", "slice_end", "pause_ms", F.round("offset_s", 6).alias("offset_s"))


def moved_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = V.words(spark, sf_dir).select(F.floor(F.col("clip_id") / 1000).alias("doc_id"), (F.col("clip_id") % 1000).alias("idx"), F.col("idx").alias("word_idx"), "word", "start", "end")
    return J.shifted_words(w, J.assemble(V.timeline(spark, sf_dir), POST)).select("doc_id", "idx", "word_idx", "word", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = V.slices(spark, sf_dir).select(F.col("clip_id").alias("doc_id"), F.col("seg_idx").alias("idx"), "samples")
    return J.joined_samples(parts).select("doc_id", F.posexplode("samples").alias("pos", "x"))


#: Of the assembled takes.
AUDIO = PostOptions(lead_in_ms=120, lead_out_ms=7_000)
OUT_CHUNK = 200


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = V.takes(spark, sf_dir).select(F.floor(F.col("clip_id") / 1000).alias("doc_id"), (F.col("clip_id") % 1000).alias("idx"), "chunk", "samples")
    # takes come in chunks of another size than the output's
    return P.joined_chunks(J.placed_samples(V.take_timeline(spark, sf_dir), AUDIO), P.rechunked(chunks, V.TAKE_CHUNK, OUT_CHUNK, ("doc_id", "idx")), OUT_CHUNK)


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The takes of a conversation cut, with pauses, as chunks of the output; of each its length and two sums of its samples."""
    made = _audio(spark, sf_dir)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return made.select("doc_id", "chunk", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(weighted, 6).alias("weighted"))


def audio_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudness and highest sample of each assembled conversation, as if it had 4,000 samples a second."""
    made = written(_audio(spark, sf_dir).withColumnRenamed("doc_id", "clip_id"), shared_folder(spark, "audio"))  # filtered twice
    found = N.loudness(made, 4000)
    return found.select(F.col("clip_id").alias("doc_id"), F.round("loudness", 6).alias("loudness"), "peak")


def checked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each error of requests whose options run through and beyond their ranges; one without for those that have none."""
    i = F.col("segment_idx")
    text = F.format_string(
        '{"text": "%s", "best_of": %d, "max_retries": %d, "validation": {"max_silence_dbfs": -%d, "alignment": {"window_size": %d}}, "text_processing": {"chunking_strategy": "%s"}, "field%d": 1',
        F.when(i % 11 == 0, "").otherwise("hello"), i % 13, i % 25, i % 140, i % 20, F.get(F.array(*map(F.lit, ("greedy", "simple", "odd"))), (i % 3).cast("int")), i % 4,
    )
    reqs = turns(spark, sf_dir).select("segment_idx", F.concat(text, F.when(i % 17 == 0, "").otherwise("}")).alias("json"), F.when(i % 19 == 0, "none").otherwise("tone").alias("engine"))
    held = Q.checked(reqs, ["tone"]).select("segment_idx", "status", F.array_join("unknown", ",").alias("unknown"), F.explode_outer("errors").alias("e"))
    return held.select("segment_idx", "status", "unknown", "e.path", "e.problem")


def voice_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of requests, a turn each, against a store of 40 voices: hits, misses, invalid tokens and evictions."""
    t = V.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), (F.col("turn") % 3).alias("b"), F.col("conv_id"))
    content = F.concat(F.lit("voice "), F.when(F.col("b") == 1, F.col("conv_id") % 37).otherwise(F.col("conv_id") % 60).cast("string"))
    named = F.col("conv_id") % 5 == 4
    reqs = t.select("request_id", "b", F.when(~named, content).alias("content"), F.when(named, VO.voice_token(content)).alias("token"))
    store, out = VO.empty_store(reqs, "double"), None
    for b in range(3):
        answers, after = VO.served(store, reqs.where(F.col("b") == b), lambda m: m.select("token", F.length("content").cast("double").alias("voice")), b, 40)
        gone = store.select("token").unionByName(answers.where("outcome = 'miss'").select("token").distinct()).join(after.select("token"), "token", "left_anti")
        counts = answers.agg(*[F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in ("hit", "miss", "invalid")])
        row = counts.join(F.broadcast(gone.agg(F.count("*").alias("n_evicted")))).join(F.broadcast(after.agg(F.count("*").alias("n_kept")))).withColumn("batch", F.lit(b))
        out, store = row if out is None else out.unionByName(row), after
    return out


def _sql_voices() -> str:
    parts = ["""t AS (SELECT conv_id * 1000 + turn AS r, turn % 3 AS b, 'voice ' || CASE WHEN turn % 3 = 1 THEN conv_id % 37 ELSE conv_id % 60 END AS c, conv_id % 5 = 4 AS named FROM conversations),
q AS (SELECT r, b, named, sha256(strlen(c) || ':' || c) AS token FROM t), s0 AS (SELECT '' AS token, 0 AS used WHERE false)"""]
    for b in range(3):
        parts.append(f"""m{b} AS (SELECT DISTINCT token FROM q WHERE b = {b} AND NOT named AND token NOT IN (SELECT token FROM s{b})),
a{b} AS (SELECT r, token, CASE WHEN token IN (SELECT token FROM s{b}) THEN 'hit' WHEN token IN (SELECT token FROM m{b}) THEN 'miss' ELSE 'invalid' END AS o FROM q WHERE b = {b}),
e{b} AS (SELECT token, CASE WHEN token IN (SELECT token FROM a{b} WHERE o <> 'invalid') THEN {b} ELSE used END AS used FROM (SELECT token, used FROM s{b} UNION ALL SELECT token, {b} FROM m{b})),
s{b + 1} AS (SELECT token, used FROM e{b} ORDER BY used DESC, token LIMIT 40)""")
    rows = [f"SELECT {b} AS batch, count(*) FILTER (o = 'hit') AS n_hit, count(*) FILTER (o = 'miss') AS n_miss, count(*) FILTER (o = 'invalid') AS n_invalid, (SELECT count(*) FROM e{b} WHERE token NOT IN (SELECT token FROM s{b + 1})) AS n_evicted, (SELECT count(*) FROM s{b + 1}) AS n_kept FROM a{b}" for b in range(3)]
    return "WITH " + ",\n".join(parts) + " " + " UNION ALL ".join(rows)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents")
    audio = docs.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".wav").otherwise(".MP3")).alias("path")).where(A.suffix(F.col("path")).isin(*A.AUDIO_SUFFIXES))
    texts = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).otherwise("  ").alias("text"))
    return A.paired_texts(audio, texts)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "value"))


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents")
    entry = F.struct(F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("a/"), F.col("doc_id").cast("string"))).alias("active_audio_file_path"), F.col("text").alias("concatenated_text_for_tts"))
    js = docs.select(F.to_json(F.struct(F.create_map(F.col("doc_id").cast("string"), entry).alias("superblocks"))).alias("json"))
    return A.manifest_rows(js)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    body = F.when(F.col("segment_idx") % 5 == 0, F.lit("{broken")).when(F.col("segment_idx") % 5 == 1, F.lit('{"text": ""}')).otherwise(F.to_json(F.struct("text", (F.col("segment_idx") % 13).alias("best_of"))))
    reqs = t.select("segment_idx", F.when(F.col("segment_idx") % 7 == 0, "other").otherwise("tone").alias("engine"), body.alias("json"))
    return A.parsed_requests(reqs, ["tone"]).select("segment_idx", "status", "error")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("audio"), F.array().cast("array<string>").alias("words"))
    return A.responses(t).select("conv_id", "turn", F.get_json_object("response", "$.audio_base64").alias("audio_base64"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = J.job_grid(turns(spark, sf_dir), 2).withColumn("attempt", F.lit(0))
    made = E.generated(J.assign_seeds(jobs, 42), E.ToneEngine, A.encode_wavs)
    return A.probed(made.select(F.concat_ws("/", "segment_idx", "candidate_idx").alias("path"), F.col("audio").alias("content")))


def aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the aligner's stub for a clip of each document, a sample for a character; one language in five has no aligner."""
    docs = V.table(spark, sf_dir, "documents")
    clips = docs.select(F.col("doc_id").alias("clip_id"), F.array_repeat(F.lit(0.1), F.length("text")).alias("samples"), F.lit(100).alias("rate"), "text", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("language"))
    return E.aligned(clips, E.EvenAligner).select("clip_id", F.size("words").alias("n_words"), F.round(F.element_at("words", -1)["end"], 6).alias("last_end"), "error")


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("token"), "embedding")
    asked = turns(spark, sf_dir).select("segment_idx", (F.col("segment_idx") % 997).cast("string").alias("token"))
    return E.voice_lookup(asked, known).select("segment_idx", "token", "error")


def named_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a batch call found by name: one in four is missing, some have failed, with a message or without."""
    jobs = turns(spark, sf_dir).select("segment_idx", F.concat(F.lit("clip_"), F.col("segment_idx").cast("string"), F.lit(".wav")).alias("name"))
    k = F.col("segment_idx")
    made = turns(spark, sf_dir).where(k % 4 != 1).select(
        F.concat(F.lit("clip_"), k.cast("string"), F.lit(".wav")).alias("name"),
        F.when(k % 3 == 0, "Success").when(k % 3 == 1, "success").otherwise("failed").alias("status"),
        F.split("text", " ").alias("words"),
        F.when(k % 2 == 0, "too short").alias("message"),
    )
    return E.results_by_name(jobs, made).select("segment_idx", F.when(F.col("words").isNotNull(), F.size("words")).alias("n_words"), "error")


def keyed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the jobs that were sent (clips that are not empty), joined by the job's key."""
    jobs = grid(spark, sf_dir)
    sent = J.job_grid(turns(spark, sf_dir), 3).where((F.col("segment_idx") + F.col("candidate_idx")) % 5 != 0)
    return E.results_by_key(jobs, sent.select("segment_idx", "candidate_idx", (F.length("text") * (F.col("candidate_idx") + 1)).alias("n")), "segment_idx", "candidate_idx")


def folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, SUFFIXES))
    docs = V.table(spark, sf_dir, "documents")
    return A.only_audio(docs.select("doc_id", F.concat(F.lit("in/v1.wav/"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % len(SUFFIXES)).cast("int"))).alias("path")))


SUFFIXES = [".wav", ".MP3", ".Flac", ".txt", ".ogg", "", ".wav.bak", ".tar.flac"]


def decoded_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's signal as WAV data, read again; one in seven is no WAV data."""
    wav = A.encoded(V.signal(spark, sf_dir), 8000).select(F.col("clip_id").cast("string").alias("path"), F.when(F.col("clip_id") % 7 == 3, F.lit(b"RIFFnothing")).otherwise(F.col("audio")).alias("content"))
    out = A.decoded(wav).select(F.col("path").cast("long").alias("clip_id"), "rate", F.col("error").isNotNull().alias("failed"), F.posexplode_outer("samples").alias("pos", "x"))
    return out.withColumn("x", F.round(F.col("x").cast("double"), 9))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit(None).cast("string"), *map(F.lit, [*E.ERROR_STATUS, "else"]))
    return turns(spark, sf_dir).select("segment_idx", F.get(kinds, (F.col("segment_idx") % 6).cast("int")).alias("kind")).withColumn("status", E.error_status("kind"))


def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, k, s) for n in (1, 2, 10, 64) for k, s in enumerate(E.retry_sizes(n))], "n int, step int, size int")


def severity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest key that is at most the length: an as-of lookup in a table of a few rows."""
    from lectern.operators.words import threshold
    from lectern.options import AlignmentOptions

    return V.words(spark, sf_dir).select("clip_id", "idx", threshold(F.length("word"), AlignmentOptions().poor).alias("threshold"))


_A = f"WITH {V.SQL_ATTEMPTS}"
_SETTLED = "settled AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY segment_idx, candidate_idx ORDER BY ok DESC, CASE WHEN ok THEN attempt ELSE -attempt END) AS k FROM attempts) WHERE k = 1)"
_PLACED = f"""WITH {V.SQL_TIMELINE}, n AS (
  SELECT *, lag(idx) OVER w IS NULL AS first, lead(idx) OVER w IS NULL AS last, lag(boundary) OVER w AS after FROM timeline WINDOW w AS (PARTITION BY doc_id ORDER BY idx)
), p AS (
  SELECT *, CASE WHEN first OR NOT first THEN least(coalesce(vad_start, 0), coalesce(word_start, vad_start, 0)) END AS slice_start,
    least(CASE WHEN last THEN n ELSE greatest(coalesce(vad_end, n), coalesce(word_end, vad_end, n)) END, n) AS slice_end,
    CASE WHEN first THEN 120 WHEN after = 'SENTENCE' THEN 200 WHEN after = 'PARAGRAPH' THEN 600 ELSE 150 END AS pause_ms FROM n
), o AS (
  SELECT *, sum(pause_ms / 1000.0::DOUBLE + greatest(0, slice_end - slice_start) / rate::DOUBLE) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - greatest(0, slice_end - slice_start) / rate::DOUBLE AS offset_s FROM p
)"""

QUERIES = {
    "j01_grid": grid,
    "j02_seeds": lambda s, d: J.assign_seeds(grid(s, d), 42, "segment_idx"),
    "j02_seed_list": lambda s, d: J.assign_seeds(grid(s, d), [42, 7, 99], "segment_idx"),
    "j03_retry_seeds": lambda s, d: J.retry_seeds(J.assign_seeds(V.attempts(s, d).select("segment_idx", "candidate_idx", "attempt"), 42)).groupBy("candidate_idx", "attempt").agg(F.countDistinct("seed").alias("n_seeds"), F.min(F.when(F.col("attempt") == 0, F.col("seed"))).alias("own"), F.every(F.col("seed") > 0).alias("positive")),
    "j04_batches": lambda s, d: J.seed_batches(J.assign_seeds(grid(s, d), 42)),
    "j05_settled": lambda s, d: J.settled(V.attempts(s, d)),
    "j06_score": scores,
    "j07_best": lambda s, d: J.best_candidates(J.settled(V.attempts(s, d))).select("segment_idx", "candidate_idx", "attempt", "score"),
    "j08_failed": lambda s, d: J.failed_segments(J.settled(V.attempts(s, d)), turns(s, d)),
    "j09_failures": lambda s, d: J.settled(V.attempts(s, d)).agg(F.count_if(F.col("status") == "FAILED_FINAL").alias("n")),
    "j10_timeline": placed,
    "j10_words": moved_words,
    "j10_audio": audio,
    "a10_loudness": audio_loudness,
    "j11_joined": joined,
    "l01_pairs": pairs,
    "l02_results": named_results,
    "l03_results": keyed_results,
    "l07_lookup": severity_lookup,
    "s01_requests": requests,
    "u07_store": voice_batches,
    "s01_checked": checked_requests,
    "s02_files": folder,
    "s04_manifest": manifest,
    "s04_entries": manifest_entries,
    "s05_decoded": decoded_clips,
    "s06_audio": spoken,
    "s07_responses": responses,
    "s08_template": lambda s, d: A.config_template(s),
    "s10_aligned": aligned_words,
    "s09_health": lambda s, d: A.health(s, {"tone": True, "other": False}),
    "u05_batch_sizes": batch_sizes,
    "u07_voices": voices,
    "u08_status": statuses,
}
ORACLES = {
    "j01_grid": "SELECT conv_id * 1000 + turn AS segment_idx, unnest(range(3))::INT AS candidate_idx FROM conversations",
    "j02_seeds": "SELECT segment_idx, c AS candidate_idx, (42 + 1000 * c)::BIGINT AS seed FROM (SELECT conv_id * 1000 + turn AS segment_idx, unnest(range(3))::INT AS c FROM conversations)",
    "j02_seed_list": "SELECT segment_idx, c AS candidate_idx, ([42, 7, 99])[c + 1]::BIGINT AS seed FROM (SELECT conv_id * 1000 + turn AS segment_idx, unnest(range(3))::INT AS c FROM conversations)",
    "j03_retry_seeds": f"{_A} SELECT candidate_idx, attempt, count(DISTINCT CASE WHEN attempt = 0 THEN 42 + 1000 * candidate_idx ELSE 10 * attempt + candidate_idx END) AS n_seeds, min(CASE WHEN attempt = 0 THEN 42 + 1000 * candidate_idx END)::BIGINT AS own, true AS positive FROM attempts GROUP BY 1, 2",
    "j04_batches": "SELECT seed, count(*) AS n FROM (SELECT (42 + 1000 * unnest(range(3)))::BIGINT AS seed FROM conversations) GROUP BY seed",
    "j05_settled": f"{_A}, {_SETTLED} SELECT *, CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILED_FINAL' END AS status FROM settled",
    "j06_score": f"WITH {V.SQL_WORDS} SELECT clip_id, round(coalesce(avg(CASE WHEN idx % 4 <> 0 THEN score END), 0), 6) AS score FROM words GROUP BY 1",
    "j07_best": f"{_A}, {_SETTLED} SELECT segment_idx, candidate_idx, attempt, score FROM (SELECT *, row_number() OVER (PARTITION BY segment_idx ORDER BY score DESC, candidate_idx) AS k FROM settled WHERE ok) WHERE k = 1",
    "j08_failed": f"{_A}, {_SETTLED}, t AS (SELECT conv_id * 1000 + turn AS segment_idx, text FROM conversations) SELECT t.segment_idx, substr(text, 1, 100) AS text, arg_min(reason, candidate_idx) AS reason FROM t JOIN settled s USING (segment_idx) GROUP BY 1, 2 HAVING NOT bool_or(ok)",
    "j09_failures": f"{_A}, {_SETTLED} SELECT count(*) FILTER (NOT ok) AS n FROM settled",
    "j10_timeline": f"{_PLACED} SELECT doc_id, idx, slice_start, slice_end, pause_ms, round(offset_s, 6) AS offset_s FROM o",
    "j10_words": f"""{_PLACED}, {V.SQL_WORDS} SELECT o.doc_id, o.idx, w.idx AS word_idx, word, round(greatest(0, w.start - slice_start / rate::DOUBLE) + offset_s, 6) AS start, round(greatest(0, w."end" - slice_start / rate::DOUBLE) + offset_s, 6) AS "end" FROM words w JOIN o ON w.clip_id = o.doc_id * 1000 + o.idx""",
    "j10_audio": f"""WITH {V.SQL_TAKES}, n AS (
  SELECT *, lag(idx) OVER w IS NULL AS first, lead(idx) OVER w IS NULL AS last, lag(boundary) OVER w AS after FROM (
    SELECT conv_id AS doc_id, turn AS idx, len(string_split(text, ' ')) * 16 AS n, CASE WHEN turn % 3 = 2 THEN 'PARAGRAPH' ELSE 'SENTENCE' END AS boundary,
      CASE WHEN turn % 4 <> 3 THEN 6 ELSE 0 END AS vs, CASE WHEN turn % 4 <> 3 THEN len(string_split(text, ' ')) * 16 - 9 ELSE len(string_split(text, ' ')) * 16 END AS ve FROM conversations) WINDOW w AS (PARTITION BY doc_id ORDER BY idx)
), p AS (
  SELECT *, CASE WHEN idx % 2 = 0 THEN least(vs, 9) ELSE vs END AS a, least(n, CASE WHEN idx % 2 = 0 THEN greatest(ve, n + 3) ELSE ve END) AS b,
    trunc(CASE WHEN first THEN 120 WHEN after = 'PARAGRAPH' THEN 600 ELSE 200 END / 1000.0::DOUBLE * 40)::BIGINT AS pause FROM n
), o AS (
  SELECT *, greatest(0, b - a) AS l, sum(pause + greatest(0, b - a)) OVER (PARTITION BY doc_id ORDER BY idx) - greatest(0, b - a) AS base FROM p
), total AS (
  SELECT doc_id, max(base + l) + 280 AS t FROM o GROUP BY 1
), x AS (
  SELECT doc_id, (base + pos - a)::BIGINT AS q, x FROM o JOIN takes ON takes.clip_id = doc_id * 1000 + idx AND pos >= a AND pos < b
), every AS (
  SELECT doc_id, unnest(range(t::BIGINT)) AS q FROM total
)
SELECT doc_id, q // 200 AS chunk, count(*)::INT AS n, round(sum(coalesce(x, 0)), 6) AS total, round(sum(coalesce(x, 0) * (q % 200 + 1)), 6) AS weighted FROM every LEFT JOIN x USING (doc_id, q) GROUP BY 1, 2""",
    "j11_joined": "SELECT vec_id AS doc_id, unnest(range(len(e)))::INT AS pos, unnest(e) AS x FROM (SELECT vec_id, embedding[1:64]::DOUBLE[] AS e FROM embeddings)",
    "l01_pairs": "SELECT 'in/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.wav' ELSE '.MP3' END AS path, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE doc_id % 9 <> 0",
    "l02_results": "SELECT k AS segment_idx, CASE WHEN k % 4 <> 1 AND k % 3 < 2 THEN len(string_split(text, ' '))::INT END AS n_words, CASE WHEN k % 4 = 1 THEN 'no result' WHEN k % 3 = 2 THEN CASE WHEN k % 2 = 0 THEN 'too short' ELSE 'unknown error' END END AS error FROM (SELECT conv_id * 1000 + turn AS k, text FROM conversations)",
    "l03_results": "SELECT k AS segment_idx, c AS candidate_idx, CASE WHEN (k + c) % 5 <> 0 THEN (length(text) * (c + 1))::INT END AS n FROM (SELECT conv_id * 1000 + turn AS k, text, unnest(range(3))::INT AS c FROM conversations)",
    "s02_files": f"SELECT * FROM (SELECT doc_id, 'in/v1.wav/' || doc_id || {SUFFIXES}[doc_id % {len(SUFFIXES)} + 1] AS path FROM documents) WHERE regexp_matches(path, '(?i)\\.(wav|mp3|flac)$')",
    "s05_decoded": f"WITH {V.SQL_SIGNAL}, e AS (SELECT clip_id, unnest(range(len(samples)))::INT AS pos, unnest(samples) AS x FROM signal WHERE clip_id % 7 <> 3) SELECT clip_id, 8000 AS rate, false AS failed, pos, round(round(greatest(-1, least(1, x)) * 32767) / 32768.0::DOUBLE, 9) AS x FROM e UNION ALL SELECT clip_id, NULL, true, NULL, NULL FROM signal WHERE clip_id % 7 = 3",
    "u05_batch_sizes": "WITH RECURSIVE r AS (SELECT unnest([1, 2, 10, 64]) AS n, 0 AS step, unnest([1, 2, 10, 64]) AS size UNION ALL SELECT n, step + 1, (CASE WHEN step = 0 THEN n - greatest(1, n // 5) ELSE size // 2 END)::INT FROM r WHERE size > 1) SELECT n, step, size FROM r",
    "u07_voices": "WITH t AS (SELECT conv_id * 1000 + turn AS segment_idx, ((conv_id * 1000 + turn) % 997)::VARCHAR AS token FROM conversations) SELECT segment_idx, token, CASE WHEN v.vec_id IS NULL THEN 'INVALID_TOKEN' END AS error FROM t LEFT JOIN embeddings v ON v.vec_id::VARCHAR = token",
    "l07_lookup": f"WITH {V.SQL_WORDS} SELECT clip_id, idx, (CASE WHEN length(word) >= 7 THEN 0.55 WHEN length(word) >= 4 THEN 0.45 WHEN length(word) >= 2 THEN 0.35 ELSE 0.25 END)::DOUBLE AS threshold FROM words",
    "u07_store": _sql_voices(),
    "s01_checked": """WITH t AS (SELECT conv_id * 1000 + turn AS i FROM conversations), e AS (
  SELECT i, '' AS path, 'malformed JSON' AS problem FROM t WHERE i % 17 = 0
  UNION ALL SELECT i, 'text', 'text is empty' FROM t WHERE i % 11 = 0 AND i % 17 <> 0
  UNION ALL SELECT i, 'best_of', 'outside 1 to 10' FROM t WHERE i % 13 NOT BETWEEN 1 AND 10 AND i % 17 <> 0
  UNION ALL SELECT i, 'max_retries', 'outside 0 to 20' FROM t WHERE i % 25 > 20 AND i % 17 <> 0
  UNION ALL SELECT i, 'validation.max_silence_dbfs', 'outside -120 to -10' FROM t WHERE i % 140 NOT BETWEEN 10 AND 120 AND i % 17 <> 0
  UNION ALL SELECT i, 'validation.alignment.window_size', 'outside 3 to 15' FROM t WHERE i % 20 NOT BETWEEN 3 AND 15 AND i % 17 <> 0
  UNION ALL SELECT i, 'text_processing.chunking_strategy', 'none of paragraph, balanced, greedy, simple' FROM t WHERE i % 3 = 2 AND i % 17 <> 0)
SELECT t.i AS segment_idx, (CASE WHEN t.i % 19 = 0 THEN 404 WHEN problem IS NOT NULL THEN 422 ELSE 200 END)::INT AS status, CASE WHEN t.i % 17 = 0 THEN '' ELSE 'field' || t.i % 4 END AS unknown, path, problem
FROM t LEFT JOIN e ON e.i = t.i""",
    "s01_requests": "WITH t AS (SELECT conv_id * 1000 + turn AS i FROM conversations), e AS (SELECT i, CASE WHEN i % 7 = 0 THEN 'unknown engine' WHEN i % 5 = 0 THEN 'malformed JSON' WHEN i % 5 = 1 THEN 'text is empty' WHEN i % 13 NOT BETWEEN 1 AND 10 THEN 'best_of is out of range' END AS error FROM t) SELECT i AS segment_idx, (CASE WHEN i % 7 = 0 THEN 404 WHEN error IS NOT NULL THEN 422 ELSE 200 END)::INT AS status, error FROM e",
    "s04_manifest": "WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) SELECT event_id, key, json_extract(props, '$.' || key)::INT AS value FROM k",
    "s04_entries": "SELECT doc_id::VARCHAR AS id, 'a/' || doc_id AS path, text FROM documents WHERE doc_id % 4 <> 0 AND text <> ''",
    "s06_audio": "SELECT (conv_id * 1000 + turn) || '/' || c AS path, 24000 AS rate, trunc(length(text) * 0.06::DOUBLE * 24000)::INT AS n, NULL::VARCHAR AS error FROM (SELECT *, unnest(range(2)) AS c FROM conversations)",
    "s09_health": "SELECT * FROM (VALUES ('tone', true), ('other', false)) AS t(engine, loaded)",
    "s07_responses": "SELECT conv_id, turn, base64(encode(text)) AS audio_base64 FROM conversations",
    "s10_aligned": "WITH d AS (SELECT doc_id AS clip_id, length(text) AS n, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w, CASE WHEN doc_id % 5 = 0 THEN 'no aligner for xx' END AS error FROM documents) SELECT clip_id, CASE WHEN error IS NULL THEN w ELSE NULL END AS n_words, CASE WHEN error IS NULL THEN round(n / 100.0::DOUBLE, 6) END AS last_end, error FROM d",
    "u08_status": "SELECT segment_idx, kind, (CASE WHEN kind IS NULL THEN 200 WHEN kind = 'client' THEN 400 WHEN kind = 'invalid_token' THEN 409 ELSE 500 END)::INT AS status FROM (SELECT conv_id * 1000 + turn AS segment_idx, ([NULL, 'client', 'invalid_token', 'synthesis', 'alignment', 'else'])[(conv_id * 1000 + turn) % 6 + 1] AS kind FROM conversations)",
}
