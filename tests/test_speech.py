"""Speech rules and resampling against plain loops."""

import random

import numpy as np
import pytest

from lectern.operators import retries as R
from lectern.operators import samples as P
from lectern.operators import speech as D
from lectern.options import PostOptions
from pyspark.sql import functions as F


def plain_segments(p, total, o, rate, frame, to):
    """The rules frame by frame."""
    of = lambda ms: rate * ms / 1000
    spoken, start, low = [], None, None
    for i, x in enumerate(p):
        if x >= o.vad_threshold:
            low = None
            start = i * frame if start is None else start
        elif x < o.vad_threshold - D.HYSTERESIS and start is not None:
            low = i * frame if low is None else low
            if i * frame - low >= of(o.vad_min_silence_ms):
                spoken.append([start, low])
                start = low = None
    if start is not None:
        spoken.append([start, total])
    spoken, pad = [s for s in spoken if s[1] - s[0] > of(o.vad_min_speech_ms)], int(of(o.vad_speech_pad_ms))
    for i, s in enumerate(spoken):
        if i == 0:
            s[0] = max(0, s[0] - pad)
        if i < len(spoken) - 1:
            gap = spoken[i + 1][0] - s[1]
            s[1], spoken[i + 1][0] = (s[1] + gap // 2, spoken[i + 1][0] - gap // 2) if gap < 2 * pad else (min(total, s[1] + pad), spoken[i + 1][0] - pad)
        else:
            s[1] = min(total, s[1] + pad)
    return [(int(a * (to / rate)), int(b * (to / rate))) for a, b in spoken]


@pytest.mark.parametrize("o", [PostOptions(), PostOptions(vad_threshold=0.7, vad_min_silence_ms=0, vad_min_speech_ms=0, vad_speech_pad_ms=0), PostOptions(vad_min_silence_ms=300, vad_min_speech_ms=60, vad_speech_pad_ms=200)])
def test_rules_frame_by_frame(spark, o):
    rng, frame, rate = random.Random(9), 32, 1000
    clips = {}
    for c in range(60):
        level, p = rng.random(), []
        for _ in range(rng.choice([1, 20, 90])):
            level = min(1.0, max(0.0, level + rng.uniform(-0.35, 0.35)))
            p.append(level)
        clips[c] = p
    total = {c: (len(p) - 1) * frame + 1 + c % frame for c, p in clips.items()}
    frames = spark.createDataFrame([(c, i, x) for c, p in clips.items() for i, x in enumerate(p)], "clip_id long, frame long, p double")
    found = D.speech_segments(frames, spark.createDataFrame(list(total.items()), "clip_id long, total long"), o, rate, frame, 1500).collect()
    got = {c: [(r.start, r.end) for r in sorted((r for r in found if r.clip_id == c), key=lambda r: r.seg_idx)] for c in clips}
    want = {c: plain_segments(p, total[c], o, rate, frame, 1500) for c, p in clips.items()}
    assert got == want and sum(map(len, want.values())) > 40


def plain_resampled(x, rate, to):
    """Each output sample as a sum over all input samples."""
    base = min(rate, to) * D.ROLLOFF
    out = []
    for m in range(-(-len(x) * to // rate)):
        t = np.clip((np.arange(len(x)) / rate - m / to) * base, -D.WIDTH, D.WIDTH)
        out.append(float((x * np.sinc(t) * np.cos(t * np.pi / D.WIDTH / 2) ** 2).sum() * base / rate))
    return out


@pytest.mark.parametrize("rate, to", [(24_000, 16_000), (16_000, 24_000), (22_050, 16_000), (8_000, 8_000)])
def test_resampling_in_chunks(spark, rate, to):
    rng = np.random.default_rng(1)
    size = 441 * 3 if rate == 22_050 else 60
    data = {1: rng.normal(size=5 * size + 17), 2: rng.normal(size=size), 3: rng.normal(size=5)}
    chunks = P.chunked(spark.createDataFrame([(c, i, float(v)) for c, x in data.items() for i, v in enumerate(x)], "clip_id long, pos long, x double"), size)
    made = D.resampled(chunks, rate, to, size).collect()
    for c, x in data.items():
        got = [v for _, s in sorted((r.chunk, r.samples) for r in made if r.clip_id == c) for v in s]
        want = plain_resampled(x, rate, to)
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-9)
        if rate != to:
            assert np.allclose(D.resampled_array(x, rate, to), want, atol=1e-9)


def test_a_tone_stays_the_tone():
    t = np.arange(2400) / 24_000
    got = D.resampled_array(np.sin(2 * np.pi * 440 * t), 24_000, 16_000)
    assert np.abs(got - np.sin(2 * np.pi * 440 * np.arange(1600) / 16_000))[40:-40].max() < 2e-3


def test_frame_probabilities(spark):
    x = [0.1] * 8 + [0.3] * 8 + [0.0] * 5
    chunks = P.chunked(spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "clip_id long, pos long, x double"), 16)
    got = [(r.frame, round(r.p, 6)) for r in D.frame_probabilities(chunks, 8).orderBy("frame").collect()]
    assert got == [(0, 0.5), (1, 0.75), (2, 0.0)]


# --- the retry loop ---------------------------------------------------------------------------


def grid(spark):
    """Three candidates, five segments; candidate c of segment s passes in attempt (s + c) % 6: some need more than three retries."""
    return spark.createDataFrame([(s, c, f"text {s}") for s in range(5) for c in range(3)], "segment_idx long, candidate_idx int, text string")


def attempts(seen, lost=()):
    def run(pending, k):
        seen.append((k, sorted((r.segment_idx, r.candidate_idx) for r in pending.collect())))
        made = pending.select("segment_idx", "candidate_idx", ((F.col("segment_idx") + F.col("candidate_idx")) % 6 == k).alias("ok"), F.concat(F.lit(f"reason {k} of "), "text").alias("reason"))
        return made.where(~F.concat_ws("-", "segment_idx", "candidate_idx").isin([f"{s}-{c}" for s, c in lost]))

    return run


def test_a_round_makes_only_jobs_without_a_pass(spark):
    seen = []
    rounds = R.retried(grid(spark), attempts(seen, [(0, 0)]), 3)
    jobs = [(s, c) for s in range(5) for c in range(3)]
    need = {(s, c): 99 if (s, c) == (0, 0) else (s + c) % 6 for s, c in jobs}
    assert seen == [(k, [j for j in jobs if need[j] >= k]) for k in range(4)]
    out = {(r.segment_idx, r.candidate_idx): (r.status, r.attempt, r.reason) for r in R.outcome(rounds).collect()}
    reason = lambda j: "no result" if j == (0, 0) else f"reason 3 of text {j[0]}"
    assert out == {j: ("SUCCESS", need[j], None) if need[j] < 4 else ("FAILED_FINAL", 3, reason(j)) for j in jobs}
    assert {r.attempt: (r.n_jobs, r.n_passed) for r in R.work(rounds).collect()} == {k: (sum(need[j] >= k for j in jobs), sum(need[j] == k for j in jobs)) for k in range(4)}


def test_rounds_end_when_all_pass(spark):
    seen = []
    R.retried(grid(spark).where("segment_idx + candidate_idx < 2"), attempts(seen), 9)
    assert [k for k, _ in seen] == [0, 1]


def test_a_restart_goes_on_from_the_last_round(spark, tmp_path):
    def failing(pending, k):
        if k == 2:
            raise RuntimeError("the engine is gone")
        return attempts([])(pending, k)

    with pytest.raises(RuntimeError):
        R.retried(grid(spark), failing, 3, str(tmp_path))
    times = {p: p.stat().st_mtime_ns for k in (0, 1) for p in (tmp_path / f"attempt={k}").glob("*.parquet")}
    out = R.outcome(R.retried(grid(spark), attempts([]), 3, str(tmp_path))).collect()
    assert times and all(p.stat().st_mtime_ns == t for p, t in times.items())
    assert sorted(map(tuple, out)) == sorted(map(tuple, R.outcome(R.retried(grid(spark), attempts([]), 3)).collect()))
