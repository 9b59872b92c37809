"""The retry loop: each round runs only the jobs that have not passed.

A round takes the jobs left by an anti-join with those that passed, makes an attempt at
them and writes it. So what passes early is never made again, a lost executor costs a part
of one round, and a run that is started anew on its folder goes on from the last round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.shared import shared_folder, written

KEYS = ("segment_idx", "candidate_idx")
#: Reason of a job that an attempt gave no result for.
NO_RESULT = "no result"


def retried(jobs: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], max_retries: int, folder: str | None = None, keys: tuple[str, ...] = KEYS) -> list[DataFrame]:
    """The attempts of all rounds, a table each: keys, attempt, ok, and whatever else `attempt` adds (reason and score, by custom).

    `attempt(pending, k)` gets the jobs without a pass and the number of the round, and
    returns rows of `keys` and ok. Jobs that it gives no row fail with NO_RESULT. Rounds
    end when all have passed, or after `max_retries` beyond the first.
    """
    folder, rounds, pending = folder or shared_folder(jobs.sparkSession, "retries"), [], jobs
    for k in range(max_retries + 1):
        made = attempt(pending, k)
        held = pending.select(*keys).join(made, list(keys), "left").withColumns({"attempt": F.lit(k), "ok": F.coalesce("ok", F.lit(False))})
        if "reason" in made.columns:
            held = held.withColumn("reason", F.when(~F.col("ok"), F.coalesce("reason", F.lit(NO_RESULT))))
        rounds.append(written(held, f"{folder}/attempt={k}"))
        if not rounds[-1].where("not ok").limit(1).count():
            break
        passed = rounds[-1].where("ok").select(*keys)
        pending = pending.join(passed, list(keys), "left_anti")
    return rounds


def outcome(rounds: list[DataFrame], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each job's pass, or its last attempt, with status SUCCESS or FAILED_FINAL.

    A job is in each round up to its pass, so its last row is what counts; no order is needed.
    """
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    row = F.struct("attempt", *[c for c in every.columns if c not in (*keys, "attempt")])
    last = every.groupBy(*keys).agg(F.max_by(row, "attempt").alias("r")).select(*keys, "r.*")
    return last.withColumn("status", F.when(F.col("ok"), "SUCCESS").otherwise("FAILED_FINAL"))


def work(rounds: list[DataFrame]) -> DataFrame:
    """attempt, n_jobs, n_passed of each round."""
    every = rounds[0].select("attempt", "ok")
    for more in rounds[1:]:
        every = every.unionByName(more.select("attempt", "ok"))
    return every.groupBy("attempt").agg(F.count("*").alias("n_jobs"), F.count_if("ok").alias("n_passed"))
