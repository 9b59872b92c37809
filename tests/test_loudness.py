"""Loudness of chunks against a plain loop over the whole clip."""

import math
import random

import numpy as np
import pytest

from lectern.operators import loudness as L
from lectern.operators import samples as P
from lectern.options import PostOptions

RATE = 4000


def plain_weighted(x, rate):
    for b, a in L.filters(rate):
        y = []
        for i in range(len(x)):
            at = lambda v, k: v[i - k] if i >= k else 0.0
            y.append(b[0] * x[i] + b[1] * at(x, 1) + b[2] * at(x, 2) - a[1] * at(y, 1) - a[2] * at(y, 2))
        x = y
    return x


def plain_loudness(x, rate):
    y, hop = plain_weighted(x, rate), rate // 10
    level = lambda m: -0.691 + 10 * math.log10(m)
    means = [m for s in range(0, len(y) - 4 * hop + 1, hop) if (m := sum(v * v for v in y[s : s + 4 * hop]) / (4 * hop)) > 0 and level(m) > -70]
    if not means:
        return None
    gate = level(sum(means) / len(means)) - 10
    kept = [m for m in means if level(m) > gate]
    return level(sum(kept) / len(kept))


def clips():
    rng = random.Random(4)
    tone = lambda n, g: [g * math.sin(i / 3) + g * rng.uniform(-0.5, 0.5) for i in range(n)]
    return {1: tone(8000, 0.3), 2: tone(4500, 0.5) + [0.0] * 4000 + tone(2500, 0.01), 3: tone(500, 0.5), 4: [0.0] * 4500, 5: tone(6303, 1e-6), 6: tone(1621, 0.9)}


@pytest.mark.parametrize("size", [250, 1777, 50_000])
def test_loudness_of_chunks(spark, size):
    data = clips()
    chunks = P.chunked(spark.createDataFrame([(c, i, v) for c, x in data.items() for i, v in enumerate(x)], "clip_id long, pos long, x double"), size)
    got = {r.clip_id: r for r in L.loudness(chunks, RATE).collect()}
    for c, x in data.items():
        want = plain_loudness(x, RATE)
        assert (got[c].loudness is None) == (want is None) and got[c].peak == max(map(abs, x))
        if want is not None:
            assert got[c].loudness == pytest.approx(want, abs=0.01)


@pytest.mark.parametrize("o", [PostOptions(), PostOptions(normalize_level=-6.0), PostOptions(normalize_method="peak"), PostOptions(normalize_audio=False)])
def test_gain(spark, o):
    data = clips()
    chunks = P.chunked(spark.createDataFrame([(c, i, v) for c, x in data.items() for i, v in enumerate(x)], "clip_id long, pos long, x double"), 1777)
    made = {c: [] for c in data}
    for r in sorted(L.normalized(chunks, RATE, o).collect(), key=lambda r: r.chunk):
        made[r.clip_id] += r.samples
    ceiling = 10 ** (-2 / 20)
    for c, x in data.items():
        before, peak = plain_loudness(x, RATE), max(map(abs, x))
        if not o.normalize_audio or peak == 0 or (before is None and o.normalize_method == "ebu"):
            assert made[c] == x
            continue
        assert max(map(abs, made[c])) <= ceiling + 1e-9
        gain = ceiling / peak if o.normalize_method == "peak" else min(ceiling / peak, 10 ** ((o.normalize_level - before) / 20))
        assert made[c] == pytest.approx([v * gain for v in x], rel=2e-3)


def test_weighting_of_a_full_scale_tone():
    """A stereo reference has its 997 Hz tone at -3.01; one channel is measured here."""
    x = [math.sin(2 * math.pi * 997 * i / 48_000) for i in range(48_000)]
    assert plain_loudness(x, 48_000) == pytest.approx(-3.01, abs=0.05)


def test_signals_filtered_together_are_those_filtered_alone():
    rng = np.random.default_rng(3)
    xs = [rng.normal(size=n) for n in [50] * 40 + [7] * 3 + [0] * 2 + [50]]
    states = rng.normal(size=(len(xs), 4))
    got = {i: (y, s) for i, y, s in L.weighted_batch(xs, 4000, states)}
    assert sorted(got) == list(range(len(xs)))
    for i, x in enumerate(xs):
        y, s = L.weighted(x, 4000, states[i])
        assert np.array_equal(got[i][0], y) and np.array_equal(got[i][1], s)
