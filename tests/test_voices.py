import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lectern.operators import voices as V


def token(content):
    return sha256(f"{len(content.encode())}:{content}".encode()).hexdigest()


@pytest.mark.parametrize("capacity", [1, 4, 100])
def test_batches_match_a_plain_store(spark, capacity):
    rng, store, held, calls = random.Random(capacity), None, {}, []

    def compute(misses):
        calls.append(misses.count())
        return misses.select("token", F.array(F.length("content").cast("double")).alias("voice"))

    for now in range(4):
        batch = []
        for k in range(rng.choice([0, 12])):
            content = rng.choice(["a", "bb", "ccc", "dddd", "é", "f" * 40])
            batch.append((k, content, None) if rng.random() < 0.7 else (k, None, rng.choice([token(content), "none", None])))
        requests = spark.createDataFrame(batch, "request_id int, content string, token string")
        answers, after = V.served(V.empty_store(requests) if store is None else store, requests, compute, now, capacity)
        want, new = [], set()
        for k, content, t in batch:
            key = t or (token(content) if content else None)
            if content and key not in held:
                new.add(key)
        for k, content, t in batch:
            key = t or (token(content) if content else None)
            want.append((k, "miss" if key in new else "hit" if key in held else "invalid"))
        for (k, content, t), (_, outcome) in zip(batch, want):
            if outcome != "invalid":
                held[t or token(content)] = now
        held = dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[:capacity])
        assert sorted((r.request_id, r.outcome) for r in answers.collect()) == want
        assert all((r.voice is None) == (r.outcome == "invalid") for r in answers.collect())
        assert {r.token: r.used for r in after.collect()} == held and calls[-1] == len(new)
        store = after
