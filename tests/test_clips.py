import random

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import signal as S
from lectern.operators import engines as E
from lectern.operators import intervals as I
from lectern.operators import jobs as J
from lectern.operators import report as R
from lectern.operators import validate as C
from lectern.operators import words as W
from lectern.options import AlignmentOptions, PostOptions, ValidationOptions
from lectern.sources import audio as A


def merged(pairs):
    out = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_intervals_merge_like_a_loop(spark):
    rng = random.Random(1)
    clips = {c: [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(rng.randint(1, 12)))] for c in range(60)}
    df = spark.createDataFrame([(c, s, e) for c, v in clips.items() for s, e in v], "clip_id long, start long, end long")
    got = {}
    for r in I.coalesce_intervals(df).orderBy("clip_id", "start").collect():
        got.setdefault(r.clip_id, []).append((r.start, r.end))
    assert got == {c: merged(v) for c, v in clips.items()}
    quiet = {r.clip_id: r.silence for r in I.longest_silence(spark.createDataFrame([(c, s, e) for c, v in got.items() for s, e in v], "clip_id long, start long, end long")).collect()}
    assert quiet == {c: max(s - e for (_, e), (s, _) in zip([(0, 0), *v], v)) for c, v in got.items()}


def test_word_issues_like_a_loop(spark):
    o, rng = AlignmentOptions(), random.Random(2)
    clips = {c: [("w" * rng.randint(1, 9), rng.choice([None, *(k / 20 for k in range(2, 20))])) for _ in range(rng.randint(1, 25))] for c in range(80)}
    df = spark.createDataFrame([(c, i, w, s) for c, v in clips.items() for i, (w, s) in enumerate(v)], "clip_id long, idx int, word string, score double")

    def limit(table, n):
        return table[max((k for k in table if k <= n), default=min(table))]

    want = set()
    for c, v in clips.items():
        score = [1.0 if s is None else s for _, s in v]
        sev = [next((k for k, t in ((3, o.critical), (2, o.poor), (1, o.weak)) if s < limit(t, len(w))), 0) for (w, _), s in zip(v, score)]
        runs = {2: 0, 1: 0}
        for i, k in enumerate(sev):
            if k >= 3:
                want.add((c, i, "critical"))
                break
            for level, most, name in ((2, 2, "consecutive_poor"), (1, 3, "consecutive_weak")):
                runs[level] = runs[level] + 1 if k >= level else 0
                if runs[level] == most:
                    want.add((c, i, name))
                    runs[level] = 0
            a, b = i - 2, i + 2
            if a >= 0 and b <= len(v):
                if len(v[i][0]) >= 4 and round((sum(score[a:b]) - score[i]) / 3 - score[i], 9) > 0.4:
                    want.add((c, i, "dip"))
                weight = [1 + len(w) * 0.15 for w, _ in v[a:b]]
                if round(sum(x * y for x, y in zip(score[a:b], weight)) / sum(weight), 9) < 0.6:
                    want.add((c, i, "window"))
    assert {(r.clip_id, r.idx, r.type) for r in W.issues(df, o).collect()} == want


def test_signals(spark):
    x = np.sin(np.arange(5000) * 0.3) * 0.5
    df = spark.createDataFrame([(1, x.tolist()), (2, []), (3, [0.0] * 10)], "clip_id long, samples array<double>")
    got = {r.clip_id: r for r in df.select("clip_id", S.dbfs(F.col("samples")).alias("db"), S.spectral_deviation(F.col("samples"), 24000).alias("c"), S.clipping_percent(F.col("samples"), 0.49).alias("clip")).collect()}
    assert abs(got[1].db - 20 * np.log10(np.sqrt((x**2).mean()))) < 1e-9 and got[2].db == got[3].db == -180
    assert got[1].c > 0 and got[2].c is None and abs(got[1].clip - 100 * (abs(x) >= 0.49).mean()) < 1e-9
    assert S.energy_segments(np.array([0.0] * 8 + [0.5] * 8 + [0.0] * 4), 4, -40) == [(8, 16)]


def plain_deviation(x, rate):
    """Deviation of the spectral centroid by a plain Fourier sum over frames."""
    x = np.pad(np.array(x), 512, mode="reflect")
    k, t = np.arange(513), np.arange(1024)
    wave, window = np.exp(-2j * np.pi * np.outer(k, t) / 1024), 0.5 - 0.5 * np.cos(2 * np.pi * t / 1024)
    out = []
    for at in range(0, len(x) - 1023, 256):
        power = np.abs(wave @ (x[at : at + 1024] * window)) ** 2
        out.append((k * rate / 1024 * power).sum() / (power.sum() + 1e-9))
    mean = sum(out) / len(out)
    return (sum((c - mean) ** 2 for c in out) / (len(out) - 1)) ** 0.5


def test_spectrum_and_its_check(spark):
    rng = np.random.default_rng(8)
    clips = {1: np.sin(np.arange(6000) * 0.2), 2: rng.normal(size=4000) * np.repeat([0.1, 1, 0.2, 1], 1000), 3: np.concatenate([np.sin(np.arange(3000) * 0.05), np.sin(np.arange(3000) * 2.5)])}
    df = spark.createDataFrame([(c, x.tolist(), n, -20.0) for c, x in clips.items() for n in (6, 7)], "clip_id long, samples array<double>, syllables int, db double")
    o = ValidationOptions()
    held = C.with_spectrum(df, 24000, C.silence_check(o))
    for r in held.collect():
        if r.centroid_std is not None:
            assert abs(r.centroid_std - plain_deviation(clips[r.clip_id], 24000)) < 1e-6
    out = {(r.clip_id, r.syllables): r.is_ok for r in C.validated(held, C.spectral_check(o)).collect()}
    assert out == {(c, n): n < 7 or plain_deviation(x, 24000) >= 1800 for c, x in clips.items() for n in (6, 7)}


def test_denoised_like_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for c in range(40):
        n, at, segments = rng.randint(0, 60), 0, []
        while at < n + 5 and rng.random() < 0.8:
            start = at + rng.randint(0, 10)
            segments.append((start, start + rng.randint(1, 15)))
            at = segments[-1][1]
        rows.append((c, [rng.random() for _ in range(n)], segments))
    df = spark.createDataFrame(rows, "clip_id long, samples array<double>, segments array<struct<start:long,end:long>>")
    got = {r.clip_id: r.x for r in df.select("clip_id", S.denoised(F.col("samples"), F.col("segments"), 4).alias("x")).collect()}
    for c, x, segments in rows:
        want = [0.0] * len(x)
        for a, b in ((min(a, len(x)), min(b, len(x))) for a, b in segments):
            k = min(4, (b - a) // 2)
            for i in range(a, b):
                near = min(i - a, b - 1 - i)
                want[i] = x[i] * (1 if near >= k else 0 if k <= 1 else near / (k - 1))
        assert np.allclose(got[c], want)


def test_wav_of_24_bits():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(3), w.setframerate(8000)
        w.writeframes(b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in (0.5, -0.25, 0.0)))
    rate, samples = A.decode_wav(out.getvalue())
    assert rate == 8000 and samples.tolist() == [0.5, -0.25, 0.0]


def test_template_has_all_options(spark):
    import json

    found = json.loads(A.config_template(spark).first()[0])
    assert found["text"]["max_chunk_length"] == 500 and found["alignment"]["window_size"] == 4 and found["best_of"] == 1


def test_best_of_and_retries(spark):
    rows = [(0, c, a, c != 2 and a >= c, s, f"r{a}") for c, s in enumerate((0.8, 0.95, 0.7)) for a in range(3)] + [(1, c, a, False, 0.5, f"r{c}{a}") for c in range(2) for a in range(3)]
    jobs = J.settled(spark.createDataFrame(rows, "segment_idx long, candidate_idx int, attempt int, ok boolean, score double, reason string"))
    got = {(r.segment_idx, r.candidate_idx): (r.status, r.attempt) for r in jobs.collect()}
    assert got == {(0, 0): ("SUCCESS", 0), (0, 1): ("SUCCESS", 1), (0, 2): ("FAILED_FINAL", 2), (1, 0): ("FAILED_FINAL", 2), (1, 1): ("FAILED_FINAL", 2)}
    assert [(r.segment_idx, r.candidate_idx) for r in J.best_candidates(jobs).collect()] == [(0, 1)]
    lost = J.failed_segments(jobs, spark.createDataFrame([(0, "a"), (1, "b" * 200)], "segment_idx long, text string")).collect()
    assert [(r.segment_idx, len(r.text), r.reason) for r in lost] == [(1, 100, "r02")]


def test_seeds(spark):
    grid = J.job_grid(spark.createDataFrame([(0,)], "segment_idx long"), 4)
    seeds = [r.seed for r in J.assign_seeds(grid, [42, 0, 99], "segment_idx").orderBy("candidate_idx").collect()]
    assert seeds[0] == 42 and seeds[2] == 99 and seeds[1] > 0 and seeds[3] > 0
    assert seeds == [r.seed for r in J.assign_seeds(grid, [42, 0, 99], "segment_idx").orderBy("candidate_idx").collect()]
    assert [r.seed for r in J.assign_seeds(grid, 7).orderBy("candidate_idx").collect()] == [7, 1007, 2007, 3007]


def test_timeline_is_monotone(spark):
    rows = [(1, i, "PARAGRAPH" if i % 2 else "SENTENCE", 24000, 24000, 2400, 21600, None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, idx int, boundary string, n long, rate int, vad_start long, vad_end long, word_start long, word_end long")
    out = J.assemble(df, PostOptions()).orderBy("idx").collect()
    assert [r.pause_ms for r in out] == [0, 200, 600, 200, 600]
    assert (out[0].slice_start, out[0].slice_end, out[4].slice_start, out[4].slice_end) == (0, 21600, 2400, 24000)
    assert all(a.offset_s < b.offset_s for a, b in zip(out, out[1:]))


def test_sources_and_engines(spark, tmp_path):
    wave = E.ToneEngine().generate(["abc"], 1)[0]
    (tmp_path / "a.WAV").write_bytes(A.encode_wav(wave, 24000))
    (tmp_path / "b.wav").write_bytes(b"not audio")
    (tmp_path / "c.txt").write_text("hello")
    out = {r.path.rsplit("/", 1)[1]: r for r in A.decoded(A.audio_files(spark, str(tmp_path))).collect()}
    assert set(out) == {"a.WAV", "b.wav"} and out["b.wav"].error and np.allclose(out["a.WAV"].samples, wave, atol=1e-4)
    heads = {r.path.rsplit("/", 1)[1]: (r.rate, r.n, bool(r.error)) for r in A.probed(A.audio_files(spark, str(tmp_path))).collect()}
    assert heads == {"a.WAV": (24000, len(wave), False), "b.wav": (None, None, True)}
    assert E.retry_sizes(10) == [10, 8, 4, 2, 1] and E.retry_sizes(1) == [1] and E.retry_sizes(0) == []
    found, errors = E.load_engines({"tone": "lectern.operators.engines.ToneEngine", "gone": "no.such.Engine"})
    assert set(found) == {"tone"} and set(errors) == {"gone"}

    class Small(E.ToneEngine):
        def generate(self, texts, seed):
            if len(texts) > 3:
                raise MemoryError
            return super().generate(texts, seed)

    assert [len(x) for x in E.in_batches(Small(), ["ab"] * 10, 0)] == [len(E.ToneEngine().generate(["ab"], 0)[0])] * 10


def test_summary_of_one_and_of_none(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "metric string, value double")
    got = {r.metric: r for r in R.summary(m, ["a", "b", "c"]).collect()}
    assert (got["a"].std, got["b"].mean, got["c"].n, got["c"].mean) == (0.0, 2.0, 0, None)


def test_stream_gives_the_batch_result(spark, tmp_path):
    from lectern.operators.chunking import chunk_documents
    from lectern.streaming.text_stream import chunk_stream

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    run = chunk_stream(stream).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = chunk_documents(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("chunks").collect())) == sorted(map(tuple, want.collect()))


def test_engines_get_few_characters_and_probes_few_bytes(spark):
    assert list(E.text_ranges([5_000, 3_000, 900, 200])) == [(0, 1), (1, 3), (3, 4)] and list(E.text_ranges([])) == []
    assert list(E.text_ranges([1] * 70)) == [(0, 64), (64, 70)]
    plain = A.encode_wav(np.zeros(100_000), 8000)
    note = b"LIST" + (4).to_bytes(4, "little") + b"data"  # a chunk between format and samples
    files = spark.createDataFrame([("a", plain), ("b", plain[:36] + note + plain[36:]), ("c", b"RIFF"), ("d", None)], "path string, content binary")
    sizes = {r.path: r.n for r in files.select("path", F.length(A.wav_head(F.col("content"))).alias("n")).collect()}
    assert sizes == {"a": A.HEAD, "b": len(plain) + len(note), "c": 4, "d": None}
    got = {r.path: (r.rate, r.n, bool(r.error)) for r in A.probed(files.where("path < 'd'")).collect()}
    assert got == {"a": (8000, 100_000, False), "b": (8000, 100_000, False), "c": (None, None, True)}
