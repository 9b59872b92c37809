"""Derived tables that the queries share, in Spark and as DuckDB SQL (a WITH clause)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 24_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noisy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with marks put before the text, by doc_id % 8, so that every rule has something to do."""
    marks = F.array(*map(F.lit, NOISE))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.concat(F.get(marks, (F.col("doc_id") % 8).cast("int")), F.lit(" "), F.col("text")).alias("text"))


NOISE = ["First part.\n\nSecond part.", "A scene.\n***\nNext", "What?!?!?! Yes,,,, no", "So....... it is--", "W-w-what is it", "Ahhhhhhh no", "[cut] this (out)", "$$$$$ **bold** and *soft* __x__"]
SQL_NOISE = "noisy AS (SELECT doc_id, lang, ([" + ", ".join("'" + n.replace("\n", "' || chr(10) || '") + "'" for n in NOISE) + "])[doc_id % 8 + 1] || ' ' || text AS text FROM documents)"


def abbreviated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with some common words written as abbreviations."""
    text = F.col("text")
    for word, short in PLANTED.items():
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {short} "))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", text.alias("text"))


#: Common words, and the abbreviations that stand for them.
PLANTED = {"with": "Capt.", "for": "approx.", "die": "bzgl.", "le": "env.", "los": "p.ej.", "was": "e.g."}


def sql_planted() -> str:
    text = "text"
    for word, short in PLANTED.items():
        text = f"replace({text}, ' {word} ', ' {short} ')"
    return f"planted AS (SELECT doc_id, lang, {text} AS text FROM documents)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, idx, word, start, end, score of the words of conversations."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("clip_id"), F.split("text", " ").alias("w"))
    held = turns.select("clip_id", F.posexplode("w").alias("idx", "word"))
    start = F.col("idx") * F.lit(0.4)
    return held.select("clip_id", "idx", "word", start.alias("start"), (start + F.length("word") * F.lit(0.05)).alias("end"), (((F.length("word") * 37 + F.col("idx") * 17) % 100) / 100).alias("score"))


SQL_WORDS = """words AS (
  SELECT clip_id, idx, word, idx * 0.4::DOUBLE AS start, idx * 0.4::DOUBLE + length(word) * 0.05::DOUBLE AS "end", ((length(word) * 37 + idx * 17) % 100) / 100.0::DOUBLE AS score
  FROM (SELECT conv_id * 1000 + turn AS clip_id, unnest(range(len(w)))::INT AS idx, unnest(w) AS word
        FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, seg_idx, start, end in samples: speech around two words of three."""
    w = words(spark, sf_dir).where("idx % 3 <> 1")
    start = F.greatest(F.lit(0), (F.col("start") * RATE).cast("long") - 1200)
    return w.select("clip_id", F.col("idx").alias("seg_idx"), start.alias("start"), ((F.col("end") * RATE).cast("long") + 1200).alias("end"))


SQL_SEGMENTS = """segments AS (
  SELECT clip_id, idx AS seg_idx, greatest(0, trunc(start * 24000)::BIGINT - 1200) AS start, trunc("end" * 24000)::BIGINT + 1200 AS "end" FROM words WHERE idx % 3 <> 1)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, samples: each user's event values over 400, in order of time."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.struct("ts", "event_id", (F.col("value") / 400).alias("x")).alias("s"))
    return e.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias("samples"))


SQL_SIGNAL = "signal AS (SELECT user_id AS clip_id, list(value / 400 ORDER BY ts, event_id) AS samples FROM events GROUP BY 1)"


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, seg_idx, samples: vectors cut in eight."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seg_idx"), "embedding")
    return v.select("clip_id", "seg_idx", F.transform(F.slice("embedding", F.col("seg_idx") * 8 + 1, F.lit(8)), lambda x: x.cast("double")).alias("samples"))


SQL_SLICES = "slices AS (SELECT vec_id AS clip_id, k AS seg_idx, embedding[k * 8 + 1:k * 8 + 8]::DOUBLE[] AS samples FROM embeddings, (SELECT unnest(range(8))::INT AS k))"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_idx, candidate_idx, attempt, ok, score, reason: three candidates and attempts for each conversation turn."""
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("segment_idx"), F.length("text").alias("n"))
    grid = t.withColumn("candidate_idx", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
    key = F.col("segment_idx") * 7 + F.col("candidate_idx") * 5 + F.col("attempt") * 3 + F.col("n")
    passes = (key % 4 == 0) & (F.col("segment_idx") % 7 != 3)  # some segments never pass
    return grid.select("segment_idx", "candidate_idx", "attempt", passes.alias("ok"), ((key % 10) / 10).alias("score"), F.concat(F.lit("reason "), (key % 3).cast("string")).alias("reason"))


SQL_ATTEMPTS = """attempts AS (
  SELECT segment_idx, candidate_idx, attempt, key % 4 = 0 AND segment_idx % 7 <> 3 AS ok, (key % 10) / 10.0::DOUBLE AS score, 'reason ' || (key % 3) AS reason FROM (
    SELECT conv_id * 1000 + turn AS segment_idx, c::INT AS candidate_idx, a::INT AS attempt, (conv_id * 1000 + turn) * 7 + c * 5 + a * 3 + length(text) AS key
    FROM conversations, unnest(range(3)) AS t(c), unnest(range(3)) AS u(a)))"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, boundary, n, rate, vad_start, vad_end, word_start, word_end: turns as segments of a conversation."""
    t = table(spark, sf_dir, "conversations")
    n = F.length("text") * 1440
    return t.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.when(F.col("turn") % 3 == 2, "PARAGRAPH").otherwise("SENTENCE").alias("boundary"), n.cast("long").alias("n"), F.lit(RATE).alias("rate"),
        F.when(F.col("turn") % 4 != 3, F.lit(480)).cast("long").alias("vad_start"), F.when(F.col("turn") % 4 != 3, n - 720).cast("long").alias("vad_end"),
        F.when(F.col("turn") % 2 == 0, F.lit(960)).cast("long").alias("word_start"), F.when(F.col("turn") % 2 == 0, n + 240).cast("long").alias("word_end"),
    )


SQL_TIMELINE = """timeline AS (
  SELECT conv_id AS doc_id, turn AS idx, CASE WHEN turn % 3 = 2 THEN 'PARAGRAPH' ELSE 'SENTENCE' END AS boundary, length(text) * 1440 AS n, 24000 AS rate,
    CASE WHEN turn % 4 <> 3 THEN 480 END AS vad_start, CASE WHEN turn % 4 <> 3 THEN length(text) * 1440 - 720 END AS vad_end,
    CASE WHEN turn % 2 = 0 THEN 960 END AS word_start, CASE WHEN turn % 2 = 0 THEN length(text) * 1440 + 240 END AS word_end FROM conversations)"""


#: Rate and chunks of takes.
TAKE_RATE, TAKE_CHUNK = 40, 256


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, chunk, samples: a signal for every conversation turn, as long as its words, of one user's event values over 400, over and over."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", (F.col("value") / 400).alias("x")).alias("s"))
    users = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias("v"))
    count = table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("u"))
    t = table(spark, sf_dir, "conversations").join(F.broadcast(count)).select((F.col("conv_id") * 1000 + F.col("turn")).alias("clip_id"), ((F.col("conv_id") * 7 + F.col("turn")) % F.col("u")).alias("user_id"), (F.size(F.split("text", " ")) * 16).alias("n"))
    held = t.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / TAKE_CHUNK).cast("int")))).join(users, "user_id")
    at = F.sequence(F.col("chunk") * TAKE_CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * TAKE_CHUNK) - 1)
    return held.select("clip_id", F.col("chunk").cast("long").alias("chunk"), F.transform(at, lambda p: F.get("v", p % F.size("v"))).alias("samples"))


SQL_TAKES = """users AS (SELECT user_id, list(value / 400 ORDER BY ts, event_id) AS v FROM events GROUP BY 1),
turns AS (SELECT conv_id * 1000 + turn AS clip_id, (conv_id * 7 + turn) % (SELECT count(*) FROM users) AS user_id, len(string_split(text, ' ')) * 16 AS n FROM conversations),
takes AS (SELECT clip_id, pos, v[pos % len(v) + 1] AS x FROM (SELECT clip_id, user_id, unnest(range(n)) AS pos FROM turns) JOIN users USING (user_id))"""


def take_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """words(), well aligned in two conversations of three."""
    good = F.floor(F.col("clip_id") / 1000) % 3 != 0
    return words(spark, sf_dir).withColumn("score", F.when(good, F.greatest("score", F.lit(0.7))).otherwise(F.col("score")))


SQL_TAKE_WORDS = SQL_WORDS.replace("words AS (", "every_word AS (", 1) + """,
words AS (SELECT * REPLACE (CASE WHEN clip_id // 1000 % 3 <> 0 THEN greatest(score, 0.7::DOUBLE) ELSE score END AS score) FROM every_word)"""


def take_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, seg_idx, start, end in samples of takes: speech around two words of three; the last may end beyond the take."""
    w = words(spark, sf_dir).where("idx % 3 <> 1")
    start = F.greatest(F.lit(0), (F.col("start") * TAKE_RATE).cast("long") - 2)
    return w.select("clip_id", F.col("idx").alias("seg_idx"), start.alias("start"), ((F.col("end") * TAKE_RATE).cast("long") + 2).alias("end"))


SQL_TAKE_SPEECH = """segments AS (
  SELECT clip_id, idx AS seg_idx, greatest(0, trunc(start * 40)::BIGINT - 2) AS start, trunc("end" * 40)::BIGINT + 2 AS "end" FROM words WHERE idx % 3 <> 1)"""


def take_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, boundary, n, rate, vad_start, vad_end, word_start, word_end: takes as segments of a conversation."""
    t = table(spark, sf_dir, "conversations")
    n, long = F.size(F.split("text", " ")) * 16, lambda c: c.cast("long")
    return t.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.when(F.col("turn") % 3 == 2, "PARAGRAPH").otherwise("SENTENCE").alias("boundary"), long(n).alias("n"), F.lit(TAKE_RATE).alias("rate"),
        long(F.when(F.col("turn") % 4 != 3, F.lit(6))).alias("vad_start"), long(F.when(F.col("turn") % 4 != 3, n - 9)).alias("vad_end"),
        long(F.when(F.col("turn") % 2 == 0, F.lit(9))).alias("word_start"), long(F.when(F.col("turn") % 2 == 0, n + 3)).alias("word_end"),
    )
