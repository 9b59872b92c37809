import io
import wave

import numpy as np

from pyspark.sql import functions as F

from lectern.operators import engines as E
from lectern.sources import audio as A


def tone(text, seed):
    t = np.arange(int(len(text) * 0.06 * 24_000)) / 24_000
    return 0.3 * np.sin(2 * np.pi * (110 + (sum(map(ord, text)) + seed) % 330) * t)


def wav(samples, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def test_a_tone_takes_the_sines_of_one_second(monkeypatch):
    seen, sin = [], np.sin
    monkeypatch.setattr(E.np, "sin", lambda x: seen.append(np.size(x)) or sin(x))
    texts = ["ab" * 700, "", "c", "dé " * 400]
    made = E.ToneEngine().generate(texts, 1042)
    monkeypatch.undo()
    assert sum(seen) <= 24_000 < sum(map(len, made))
    assert all(x.dtype == np.float32 and len(x) == len(tone(t, 1042)) and np.allclose(x, tone(t, 1042), atol=1e-6) for x, t in zip(made, texts))


def test_wav_data_of_many_clips_is_that_of_each(spark):
    long = np.sin(np.arange(3 * A.SAMPLES_AT_ONCE + 5)) * 1.5
    clips = [long.astype(np.float32), np.zeros(0, np.float32), long[:7], np.array([-2, -1, 0, 1, 2])]
    want = [wav(x, 8000) for x in clips]
    assert A.encode_wavs(clips, 8000).to_pylist() == want == [A.encode_wav(x, 8000) for x in clips]
    assert A.encode_wavs([], 8000).to_pylist() == []


def test_jobs_of_many_seeds_are_generated_whole(spark):
    rows = [(i, c, a, 40 + 10 * c + a, "word " * (i * 37 % 300)) for i in range(40) for c in range(2) for a in range(2)]
    jobs = spark.createDataFrame(rows, "segment_idx long, candidate_idx int, attempt int, seed long, text string")
    want = {r[:3]: tone(r[4], r[3]) for r in rows}
    sounds = {r[:3]: r.audio for r in E.generated(jobs, E.ToneEngine, A.encode_wavs).collect()}
    assert {k: A.decode_wav(bytes(v))[0] for k, v in sounds.items()} == dict.fromkeys(want, 24_000)
    assert all(len(x := A.decode_wav(bytes(sounds[k]))[1]) == len(w) and np.allclose(x, w, atol=1e-4) for k, w in want.items())
    few = E.generated(jobs.where("segment_idx < 4"), E.ToneEngine)
    assert few.dtypes[-1] == ("samples", "array<float>")
    assert all(np.allclose(r.samples, want[r[:3]], atol=1e-6) for r in few.collect())


def test_jobs_of_few_seeds_are_dealt_evenly(spark):
    jobs = spark.range(3000).select(F.col("id").alias("segment_idx"), (F.col("id") % 2).cast("int").alias("candidate_idx"), F.lit(0).alias("attempt"), (42 + 1000 * (F.col("id") % 2)).alias("seed"), F.lit("").alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        sizes = [r["count"] for r in E.generated(jobs, E.ToneEngine, A.encode_wavs).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) == 3000 and len(sizes) == 12 and max(sizes) < 1.5 * 3000 / 12
