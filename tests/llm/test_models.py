import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import quality_crf, toxicity


def accuracy(spark, query, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    return np.mean([r.predicted == r[label] for r in out]), len(out)


def test_toxicity_on_held_out_rows(spark):
    share, n = accuracy(spark, toxicity.toxicity, "toxic")
    assert n > 500 and share > 0.97


def test_quality_on_held_out_rows(spark):
    share, n = accuracy(spark, quality_crf.quality, "quality")
    assert n > 500 and share > 0.97


@pytest.mark.parametrize("query, parts, part", [(toxicity.toxicity, 5, 0), (quality_crf.quality, 3, 1)])
def test_edges(spark, docs, rows, empty, query, parts, part):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = query(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in out)
    assert query(empty, labels).count() == 0
    assert query(docs, labels.limit(0)).count() == len(rows)


@pytest.mark.parametrize("where", ["first", "all of a class"])
def test_long_documents_leave_both_classes(spark, where):
    """A document of more words (lines) than the bound takes no other from the sample, and a class of such ones alone stays."""
    texts = [(i, ("You utter fool of a person.\nNow. " if i % 2 else "Calm words of a fine day.\nHere. ") + f"Some text {i}.", i % 2) for i in range(400)]
    order = spark.createDataFrame(texts, "doc_id long, text string, y int").orderBy(F.xxhash64("doc_id")).collect()
    long = {next(r.doc_id for r in order if r.y == y and zlib.crc32(str(r.doc_id).encode()) % 15 not in (0, 1, 4, 5, 7, 10, 13)) for y in (0, 1)} if where == "first" else {r.doc_id for r in order if r.y}
    rows = [(i, t + " more words\n" * (20_000 if where == "first" else 1_200) * (i in long), y, y) for i, t, y in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    for query, bound in ((toxicity, {"sample_words": 4_000}), (quality_crf, {"sample_lines": 2_000})):
        sample = query.sampled_texts(df, df, "toxic", 5, 0, 1000, 2_000, F.size(F.split("text", r"\s+")))
        counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
        assert set(counts) == {0, 1} and (where != "first" or min(counts.values()) > 100) and max(counts.values()) > 100
        model = query.train(df.select("doc_id", "text"), df, **bound)
        scored = query.score(df.select("doc_id", "text"), model).join(df.select("doc_id", "toxic"), "doc_id").collect()
        if query is toxicity:
            assert sum((r.score >= 0.5) == (r.toxic == 1) for r in scored) > 390


def test_the_long_document_of_a_labelled_class_is_fitted_last(spark):
    """5,000,000 words in the first document of each class."""
    rows = [(i, "fool stone" if i % 2 else "fine stone", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    first = {df.where(F.col("toxic") == y).where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").orderBy(F.xxhash64("doc_id")).first().doc_id for y in (0, 1)}
    df = df.withColumn("text", F.when(F.col("doc_id").isin(first), F.repeat(F.lit("stone "), 5_000_000)).otherwise(F.col("text")))
    sample = toxicity.sampled_texts(df, df, "toxic", 5, 0, 4000, toxicity.SAMPLE_WORDS, F.size(F.split("text", r"\s+")))
    assert {r.label: r["count"] > 15 for r in sample.groupBy("label").count().collect()} == {0: True, 1: True}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    x, sizes = rng.normal(size=(9, 3)), np.array([4, 1, 4])
    field = quality_crf.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
    got, expected = quality_crf.marginals(field, x, sizes)
    at, want, moves = 0, [], np.zeros((2, 2))
    for n in sizes:
        z, total, good = x[at : at + n] @ field.emission, 0.0, np.zeros(n)
        step = np.zeros((2, 2))
        for k in range(1 << n):
            y = [k >> i & 1 for i in range(n)]
            p = np.exp(sum(z[i] * y[i] for i in range(n)) + sum(field.transition[a, b] for a, b in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
            for a, b in zip(y, y[1:]):
                step[a, b] += p
        want += list(good / total)
        moves += step / total
        at += n
    assert np.allclose(got, want) and np.allclose(expected, moves)


def test_offending_sentence_is_located(spark):
    rows = [(i, ("Fine words here. You utter fool. More words." if i % 2 else "Fine words here. Nothing else. More words."), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    assert all([s.sentence for s in r.sentences] == ([1] if r.doc_id % 2 else []) for r in out)


def test_lines_of_spliced_documents_are_told_apart(spark):
    """Halves of good and bad documents that are held out, joined: their lines keep their states."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    field = quality_crf.train(docs, labels)
    held = docs.join(labels, "doc_id").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1").orderBy("doc_id").select("text", "quality").collect()
    lines = [[r.text.split("\n") for r in held if r.quality == q] for q in (0, 1)]
    rng, right, total, mixed = __import__("random").Random(1), 0, 0, 0
    for _ in range(300):
        parts = [(rng.choice(lines[1])[:8], 1), (rng.choice(lines[0])[1:9], 0)]
        rng.shuffle(parts)
        x, _ = quality_crf.lines_of("\n".join(line for p, _ in parts for line in p))
        good = quality_crf.marginals(field, x, np.array([len(x)]))[0] >= 0.5
        want = np.array([v for p, v in parts for _ in p], bool)
        right, total, mixed = right + (good == want).sum(), total + len(want), mixed + (good.any() and not good.all())
    assert right / total >= 0.9 and mixed > 200


def test_document_quality_is_the_weighted_mean_of_marginals():
    rng = np.random.default_rng(3)
    field = quality_crf.Field(rng.normal(size=3 * quality_crf.WIDTH + 1), rng.normal(size=(2, 2)), 1.7, -0.4)
    text = "Some words here.\n\nMORE!! WORDS!!\nand | a | table"
    x, lengths = quality_crf.lines_of(text)
    z, paths = x @ field.emission, []
    for k in range(1 << len(x)):
        y = np.array([k >> i & 1 for i in range(len(x))])
        paths.append((np.exp(z @ y + sum(field.transition[a, b] for a, b in zip(y, y[1:]))), y))
    total = sum(p for p, _ in paths)
    good = sum(p * y for p, y in paths) / total
    raw = (good * lengths).sum() / lengths.sum()
    want = 1 / (1 + np.exp(-(1.7 * np.log(raw / (1 - raw)) - 0.4)))
    got, _ = quality_crf.marginals(field, x, np.array([len(x)]))
    assert field.scaled(np.array([field.document(got, lengths)]))[0] == pytest.approx(want)
