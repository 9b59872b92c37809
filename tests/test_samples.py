"""Chunked waveforms, the sweep and the assembly against flat loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import signal as S
from lectern.operators import intervals as I
from lectern.operators import jobs as J
from lectern.operators import samples as P
from lectern.operators import validate as C
from lectern.options import AlignmentOptions, PostOptions, ValidationOptions


def level(x):
    rms = math.sqrt(sum(v * v for v in x) / len(x)) if x else 0.0
    return 20 * math.log10(rms) if rms >= 1e-9 else -180.0


def signals(rng, clips):
    """Loud, quiet and silent stretches, clipped samples."""
    return {c: [rng.choice([0.0, 1e-7, 0.3, 1.0]) * rng.uniform(-1, 1) if k % 7 else rng.choice([1.0, -1.0, 0.0]) for k in range(n)] for c, n in clips.items()}


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_levels_are_two_look_ups(spark, size):
    rng = random.Random(size)
    data = signals(rng, {1: 200, 2: 64, 3: 1})
    data[4] = [1.0] * 150 + [1e-8] * 150  # a quiet end behind loud sums
    segments = [(c, k, a := rng.randint(0, 320), a + rng.randint(0, 150)) for c in (1, 2, 3, 4, 5) for k in range(25)] + [(4, 90, 150, 300), (4, 91, 0, 300)]
    chunks = P.chunked(spark.createDataFrame([(c, i, x) for c, xs in data.items() for i, x in enumerate(xs)], "clip_id long, pos long, x double"), size)
    index = P.sample_index(chunks)
    totals = P.clip_levels(index)
    assert {r.clip_id: (r.total, pytest.approx(r.db)) for r in totals.collect()} == {c: (len(x), level(x)) for c, x in data.items()}
    got = {(r.clip_id, r.seg_idx): r for r in P.segment_levels(spark.createDataFrame(segments, "clip_id long, seg_idx int, start long, end long"), index, totals, size).collect()}
    assert len(got) == len(segments)
    for c, k, a, b in segments:
        x = data.get(c, [])[a:b]
        r = got[c, k]
        assert (r.n, r.clipped) == (len(x), sum(abs(v) >= 0.999 for v in x)) and r.db == pytest.approx(level(x), abs=1e-6)
    joined = {r.clip_id: r.samples for r in P.voiced_samples(spark.createDataFrame([s for s in segments if s[0] < 5], "clip_id long, seg_idx int, start long, end long"), chunks, size).collect()}
    assert all(joined.get(c, []) == [v for cc, _, a, b in sorted(segments) if cc == c for v in x[a:b]] for c, x in data.items())


@pytest.mark.parametrize("size, to", [(5, 3), (3, 5), (8, 8), (100, 7)])
def test_chunks_of_another_size(spark, size, to):
    rows = [(1, i, float(i)) for i in range(53)] + [(2, 0, 7.0)]
    chunks = P.chunked(spark.createDataFrame(rows, "clip_id long, pos long, x double"), size)
    got = sorted((r.clip_id, r.chunk, r.samples) for r in P.rechunked(chunks, size, to).collect())
    assert got == [(1, k, [float(i) for i in range(k * to, min(53, (k + 1) * to))]) for k in range(-(-53 // to))] + [(2, 0, [7.0])]


def test_sweep_is_the_overlap_join(spark):
    rng = random.Random(1)
    gaps = [(c, k, a := rng.randint(0, 400) / 8, a + rng.randint(1, 40) / 8) for c in range(6) for k in range(30)]
    speech = [(c, k, a := rng.randint(0, 450), a + rng.randint(0, 30)) for c in range(5) for k in range(40)]
    want = {}
    for c, k, a, b in gaps:
        n = sum(max(0, min(e, int(b * 8)) - max(s, int(a * 8))) for cc, _, s, e in speech if cc == c)
        if n:
            want[c, k] = n
    found = I.gap_speech(spark.createDataFrame(gaps, "clip_id long, idx int, start double, end double"), spark.createDataFrame(speech, "clip_id long, seg_idx int, start long, end long"), 8)
    assert {(r.clip_id, r.idx): r.speech for r in found.collect()} == want


def test_sweep_over_a_long_clip(spark):
    """100,000 gaps and segments of one clip: an overlap join within the clip would look at 10,000,000,000 pairs."""
    n = 100_000
    gaps = spark.range(n).select(F.lit(1).alias("clip_id"), F.col("id").cast("int").alias("idx"), (F.col("id") * 1.0).alias("start"), (F.col("id") + 0.5).alias("end"))
    speech = spark.range(n).select(F.lit(1).alias("clip_id"), (F.col("id") * 100 + 25).alias("start"), (F.col("id") * 100 + 75).alias("end"))
    assert I.gap_speech(gaps, speech, 100).groupBy("speech").count().collect() == [(25, n)]


def flat(segments, o, rate):
    """One document put together sample by sample."""
    silence = lambda ms: [0.0] * int((ms or 0) / 1000 * rate)
    out = silence(o.lead_in_ms)
    for i, (x, boundary, vad, word) in enumerate(segments):
        if i:
            out += silence({"SENTENCE": o.silence_sentence_ms, "PARAGRAPH": o.silence_paragraph_ms}.get(segments[i - 1][1], o.silence_fallback_ms))
        start, end = vad[0] if vad[0] is not None else 0, vad[1] if vad[1] is not None else len(x)
        start, end = min(start, word[0]) if word[0] is not None else start, max(end, word[1]) if word[1] is not None else end
        a = start if (i and o.trim_segment_silence) or (not i and o.lead_in_ms is not None) else 0
        last = i == len(segments) - 1
        b = end if (not last and o.trim_segment_silence) or (last and o.lead_out_ms is not None) else len(x)
        out += x[a:b] if a < b else []
    return out + silence(o.lead_out_ms)


OPTIONS = [PostOptions(), PostOptions(lead_in_ms=120, lead_out_ms=300), PostOptions(trim_segment_silence=False, lead_out_ms=0), PostOptions(silence_sentence_ms=0, silence_paragraph_ms=4000, silence_fallback_ms=35)]


@pytest.mark.parametrize("o", OPTIONS)
@pytest.mark.parametrize("size", [1, 16, 1000])
def test_assembly_is_the_flat_loop(spark, o, size):
    rng, rate, docs = random.Random(3), 100, {}
    for d in range(8):
        docs[d] = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 15, 40, 170])
            some = lambda: rng.choice([None, rng.randint(0, n + 9)])
            docs[d].append(([rng.uniform(-1, 1) for _ in range(n)], rng.choice(["SENTENCE", "PARAGRAPH", "HARD_LIMIT"]), (some(), some()), (some(), some())))
    rows = [(d, i, boundary, len(x), rate, *vad, *word) for d, s in docs.items() for i, (x, boundary, vad, word) in enumerate(s)]
    placed = J.placed_samples(spark.createDataFrame(rows, "doc_id long, idx int, boundary string, n long, rate int, vad_start long, vad_end long, word_start long, word_end long"), o)
    samples = spark.createDataFrame([(d, i, p, v) for d, s in docs.items() for i, (x, *_) in enumerate(s) for p, v in enumerate(x)], "doc_id long, idx int, pos long, x double")
    made = P.joined_chunks(placed, P.chunked(samples, size, ("doc_id", "idx")), size).collect()
    for d, s in docs.items():
        parts = sorted((r.chunk, r.samples) for r in made if r.doc_id == d)
        assert [k for k, _ in parts] == list(range(len(parts))) and all(len(x) == size for _, x in parts[:-1])
        assert [v for _, x in parts for v in x] == flat(s, o, rate)


def test_a_long_document_has_bounded_rows(spark):
    """Ten hours at 200 samples a second in chunks of 4,096: no row has more."""
    n, rate, size = 36_000 * 200 // 60, 200, 4096
    segments = spark.range(60).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("idx"), F.lit("SENTENCE").alias("boundary"), F.lit(n).cast("long").alias("n"), F.lit(rate).alias("rate"), *[F.lit(None).cast("long").alias(c) for c in ("vad_start", "vad_end", "word_start", "word_end")])
    chunks = spark.range(60).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit((n - 1) // size))).alias("chunk"))
    chunks = chunks.select("doc_id", "idx", F.col("chunk").cast("long").alias("chunk"), F.array_repeat(F.lit(1.0), F.least(F.lit(size), n - F.col("chunk") * size).cast("int")).alias("samples"))
    made = P.joined_chunks(J.placed_samples(segments, PostOptions(lead_in_ms=500, lead_out_ms=500)), chunks, size)
    total, most, ones = made.select(F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.sum("n"), F.max("n"), F.sum("s")).first()
    assert (total, most, ones) == (60 * n + 59 * 40 + 200, size, 60.0 * n)


def test_a_text_without_syllables_passes_duration(spark):
    o = ValidationOptions(min_syllables_for_duration_validation=None)
    clips = spark.createDataFrame([(1, 0, 3.0, 0.0), (2, 1, 3.0, 0.35)], "clip_id long, syllables int, voiced_s double, most_s double")
    assert {r.clip_id: r.is_ok for r in C.validated(clips, C.duration_check(o)).collect()} == {1: True, 2: False}


def test_checks_see_speech_that_passed_the_filter(spark):
    """A loud segment and a quiet one: voiced time, silence and clipping are the loud one's alone; the level is the clip's."""
    x = [0.0] * 100 + [1.0, -0.5] * 100 + [0.0] * 100 + [0.001] * 200 + [0.0] * 50
    chunks = P.chunked(spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "clip_id long, pos long, x double"), 64)
    speech = spark.createDataFrame([(1, 0, 100, 300), (1, 1, 400, 600)], "clip_id long, seg_idx int, start long, end long")
    words = spark.createDataFrame([(1, 0, "stone", 1.0, 3.0, 0.9)], "clip_id long, idx int, word string, start double, end double, score double")
    clips = spark.createDataFrame([(1, "stone"), (2, "no sound")], "clip_id long, text string")
    args = (clips, chunks, speech, words, 100, ValidationOptions(), PostOptions(), AlignmentOptions(), 64)
    held = {r.clip_id: r for r in C.judged_clips(*args, n_fft=16, hop=4, report=True).collect()}
    r = held[1]
    assert (r.n_found, r.n_removed, r.voiced_s, r.silence_s, r.clipping) == (1, 1, 2.0, 1.0, 50.0)
    assert r.db == pytest.approx(level(x)) and r.centroid_std == pytest.approx(S.centroid_deviation(x[100:300], 100, 16, 4))
    assert (r.is_ok, r.reason.split(":")[0]) == (False, "clipping")
    assert (held[2].n_found, held[2].db, held[2].reason.split(":")[0]) == (0, -180.0, "silence")
    everything = PostOptions(max_voiced_dynamic_range_db=None)
    assert C.judged_clips(*args[:6], everything, *args[7:], n_fft=16, hop=4).where("clip_id = 1").first().n_found == 2


def test_judged_clips_make_their_chunks_once(spark):
    from lectern.operators import validate as C
    from lectern.plans import clip_queries as Q

    clips, chunks, *rest = Q._parts(spark, "/root/testdata/sf0.001")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    chunks = chunks.localCheckpoint()
    held = C.judged_clips(clips, chunks.mapInArrow(counted, chunks.schema), *rest, n_fft=Q.TAKE_FFT, hop=Q.TAKE_HOP)
    want = C.judged_clips(clips, chunks, *rest, n_fft=Q.TAKE_FFT, hop=Q.TAKE_HOP)
    row = lambda r: (r.clip_id, r.is_ok, r.reason)
    assert sorted(map(row, held.collect())) == sorted(map(row, want.collect()))
    assert made.value == chunks.count()
