"""A store of voices by content, kept up to date batch after batch.

A voice's token is the hash of what it is made from, so equal content is one row whoever
asks for it. A batch finds its misses by an anti-join; only those are computed, each once.
Then the next snapshot is written whole, with the time of last use, and the least recently
used rows beyond the capacity are left out. Readers of the snapshot before are not disturbed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.shared import shared_folder, written

#: Rows that a store keeps.
CAPACITY = 10


def voice_token(content: Column, *params: Column) -> Column:
    """SHA-256 of the content and the parameters."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in (content, *params)]), 256)


def empty_store(requests: DataFrame, value: str = "array<double>") -> DataFrame:
    return requests.sparkSession.createDataFrame([], f"token string, voice {value}, used long")


def served(store: DataFrame, requests: DataFrame, compute: Callable[[DataFrame], DataFrame], now: int, capacity: int = CAPACITY, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers to a batch of requests, and the next snapshot of the store, both written.

    Requests have request_id, content (null: a voice is named by its token) and token
    (null where there is content). Answers have request_id, token, voice and outcome: hit,
    miss (computed now), or invalid (a token that the store lacks; its voice is null).
    `compute` gets token and content of the misses, a row a token, and returns token, voice.
    The store keeps the `capacity` rows used last; of equal times the smaller tokens.
    """
    folder = folder or shared_folder(requests.sparkSession, "voices")
    asked = requests.select("request_id", "content", F.coalesce("token", F.when(F.col("content").isNotNull(), voice_token(F.col("content")))).alias("token"))
    misses = asked.where("content is not null").groupBy("token").agg(F.min("content").alias("content")).join(store.select("token"), "token", "left_anti")
    made = written(compute(misses).select("token", "voice"), f"{folder}/made")
    known = store.select("token", "voice", F.lit("hit").alias("outcome")).unionByName(made.withColumn("outcome", F.lit("miss")))
    answers = asked.select("request_id", "token").join(known, "token", "left").withColumn("outcome", F.coalesce("outcome", F.lit("invalid")))
    answers = written(answers, f"{folder}/answers")
    used = answers.where("outcome <> 'invalid'").select("token").distinct().withColumn("now", F.lit(now).cast("long"))
    every = store.unionByName(made.withColumn("used", F.lit(None).cast("long"))).join(used, "token", "left")
    kept = every.select("token", "voice", F.coalesce("now", "used").alias("used")).orderBy(F.col("used").desc(), "token").limit(capacity)
    return answers, written(kept, f"{folder}/store")
