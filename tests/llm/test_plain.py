"""Operators without SQL against their plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, licenses, quality_rules, toxicity
from lectern.llm.common import staged
from tests.llm import plain

ITEMS = [
    "Janet has 12 apples. Janet eats 3 and gives 4 to Tom. Janet sells the rest for 2 dollars each. How much money does Janet make?",
    "A bus goes from Paris to the coast with 1200 people at 60 miles per hour and comes back at night with half of them",
    "if the river rises by two feet in the night then how high does it stand at noon on the next day",
    "Maria and Peter walk 5 km from Rome to Pisa. Peter walks 3 km more than Maria.",
    "river",
    "Paris",
    "42",
    "12 30 45 50 7 19",
    "Tom Janet, Maria, Peter, Ann",
    "two words",
    "",
    None,
]
VALUES = {"Janet": ["Ann", "New York"], "Tom": ["Zoe"], "12": ["30", "1 200"], "3": ["9"], "Paris": ["Oslo", "San Marino"], "60": ["75"], "miles per hour": ["km/h"], "Peter": ["Karl"], "5 km": ["6 miles"], "Maria": ["Eva"], "4": ["5"]}


def table(rng):
    texts = [None, "", "river", "the Rivers, river!", "42", "a 42 b", "12 30 45 50 7 19", "12 30 45 50 7 20", "Tom Janet, Maria, Peter, Ann", "Ann Janet, Maria, Peter, Tom", "two words", "two more words"]
    for item in ITEMS[:4]:
        for _ in range(14):
            t = item
            for old, new in VALUES.items():
                if rng.random() < 0.4:
                    t = t.replace(old, rng.choice(new), rng.choice([-1, -1, 1]))
            w = t.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(["other", "", "some thing", "7"])
            texts.append(" ".join(rng.choices("the of a by and Anna 17 cold".split(), k=rng.randrange(9))) + rng.choice(["\n", " "]) + " ".join(w))
    return texts


def test_templates_match_the_plain_version(spark):
    texts = table(random.Random(3))
    want = {(d, i): s for d, t in enumerate(texts) for i, item in enumerate(ITEMS) if t and item and (s := plain.share_found(item, t)) is not None}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    for options in ({}, {"filter_keys": 0, "shared_items": 0}):  # unfiltered, all windows by way of the pairs
        got = {(r.doc_id, r.item_id): r.share for r in decontaminate.contaminated(docs, bench, **options).collect()}
        assert got == pytest.approx(want)
    assert 25 < len(want) < len(texts) * 4


def test_long_and_short_items(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**6)}" for _ in range(2000)] + ["river"]
    texts = ["a calm river ran by", " ".join(long), " ".join(long[:1700]), " ".join(long[:1000]), "x " * 20_000 + "river", " ".join(long[:900] + ["new", "words"] + long[900:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda items: sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert found([(1, " ".join(long))]) == [(1, 1), (2, 1), (5, 1)]
    assert found([(1, "River.")]) == [(0, 1), (1, 1), (4, 1), (5, 1)]
    assert found([(1, "calm river"), (1, "calm river"), (None, "ran by")]) == [(0, 1), (0, 1), (0, None)]


def test_equal_alignments_give_the_first(spark):
    item = "if the river rises by two feet in the night"
    docs = spark.createDataFrame([(1, f"{item} and {item}"), (1, item), (None, item)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert sorted(map(str, [(r.doc_id, r.first_word, r.n_words, r.share) for r in got])) == sorted(map(str, [(1, 0, 10, 1.0), (1, 0, 10, 1.0), (None, 0, 10, 1.0)]))


def brute_places(words):
    out = []
    for label, notice in licenses.NOTICES:
        k, found = licenses.errors_allowed(notice), []
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + 14) + 1):
                t = " ".join(words[i:j])
                if abs(len(t) - len(notice)) <= k and (e := plain.edit_distance(t, notice)) <= k:
                    found.append((e, i, j))
        taken = []
        for e, i, j in sorted(found):
            if all(j <= a or b <= i for a, b in taken):
                taken.append((i, j))
                out.append((label, i, j - i, e))
    return sorted(out)


def test_notices_with_edits_match_edit_distances():
    rng, search, n = random.Random(7), licenses.Searcher(), 0
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += rng.choices("a the under of mit license foo gnu version 2 by cc".split(), k=rng.randint(0, 6))
            t = list(rng.choice(licenses.NOTICES)[1])
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "x", " ", "b"])
            words += "".join(t).split()
        want = brute_places(words)
        assert sorted((p["label"], p["first_word"], p["n_words"], p["errors"]) for p in search._fuzzy(f" {' '.join(words)} ")) == want
        n += len(want)
    assert n > 200


def test_notices_in_other_scripts_match_edit_distances():
    rng, search, n = random.Random(11), licenses.Searcher(), 0
    for _ in range(60):
        words = rng.choices("слово é 字字 the".split(), k=rng.randint(0, 3))
        t = list(rng.choice(licenses.NOTICES)[1])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t))
            t[at : at + rng.choice([0, 1, 1])] = rng.choice(["é", "і", " ", "字"])
        words += "".join(t).split()
        want = brute_places(words)
        assert sorted((p["label"], p["first_word"], p["n_words"], p["errors"]) for p in search._fuzzy(f" {' '.join(words)} ")) == want
        n += len(want)
    assert n > 50


@pytest.mark.parametrize("text, places", [
    ("under teh mit license under the mit license", [("mit", 0, 2, False), ("mit", 4, 0, True)]),
    ("permission is heerby granted free of charge permission is hereby granted free of charge", [("mit", 0, 2, False), ("mit", 7, 0, False)]),
    ("xunder the mit licensey", [("mit", 0, 2, False)]),
    ("all rights reservedly", []),
    ("all rights reserved all rights reserved", [("reserved", 0, 0, False), ("reserved", 3, 0, False)]),
    ("gnu lesser general public license", [("lgpl", 0, 0, False)]),
    ("licensed under cc by nc 4 0", [("cc-by-nc", 0, 0, False), ("cc-by-nc", 2, 0, True)][1:]),
])
def test_places_of_notices(text, places):
    got = [(p["label"], p["first_word"], p["errors"], p["base"]) for p in licenses.Searcher()(text)[1]]
    assert sorted(got) == sorted(places)


def test_verdicts_and_limits_match_exact_quantiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(700)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    base, kept, limit = plain.quality(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert [out[i].base_failed for i in range(len(rows))] == base
    assert [out[i].kept for i in range(len(rows))] == kept
    cuts = {(r.group_lang, r.group_source): r.limits for r in quality_rules.limits(staged(quality_rules.figures(df).drop("text"), "figures")).collect()}
    spread = 0
    for group, want in limit.items():
        for k, (low, high) in want.items():
            assert cuts[group][f"{k}_least"] == pytest.approx(low) and cuts[group][f"{k}_most"] == pytest.approx(high)
            spread += high > low
    assert spread > 0.7 * 4 * len(limit) and 0.5 < sum(kept) / len(kept) < 1


def test_noisy_or_of_sentences(spark):
    rng = np.random.default_rng(4)
    model = toxicity.Model(np.zeros(toxicity.BUCKETS + 1), -1.0)
    for w in ("bad", "worse", "fine"):
        model.weights[toxicity.features(w)[0]] = rng.normal()
    texts = ["Bad words. Fine ones!\nWorse", "fine", "", None, "bad bad bad. x y z? worse fine"]
    want, z = [], {w: model.weights[toxicity.features(w)[0]] for w in ("bad", "worse", "fine")}
    for t in texts:
        sentences = [s for line in (t or "").split("\n") for s in line.replace("!", ".").replace("?", ".").split(".") if s.strip()] or [""]
        p = [1 / (1 + np.exp(-(model.bias + sum(z.get(w, 0) for w in s.lower().split())))) for s in sentences]
        want.append(1 - np.prod([1 - x for x in p]))
    out = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.score for r in out] == pytest.approx(want)


def test_sample_is_bounded_in_words_and_whole(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1)) for i in range(400)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    sample = toxicity.sampled_texts(docs, labels, "toxic", 5, 0, 4000, 600, F.size(F.split("text", " ")))
    found = sample.groupBy("label").agg(F.sum(F.size(F.split("text", " "))).alias("n"), F.count("*").alias("rows")).collect()
    assert len(found) == 2 and all(500 < r.n <= 600 and r.rows > 5 for r in found)


@pytest.mark.parametrize("text, errors", [
    ("under the mít license", 1),
    ("under the mít licénse", 2),
    ("gnu général public license", 2),
    ("under the міt license", 2),
    ("all rights reservèd", 1),
])
def test_an_accent_is_one_edit(text, errors):
    _, spans = licenses.Searcher()(f"слово {text} 字字")
    assert [(s["first_word"], s["errors"]) for s in spans if not s["base"]] == [(1, errors)]


@pytest.mark.parametrize("phrase", ["cc by nc", "all rights reserved", "licensed under cc by nc 4 0", "all rights reservd"])
def test_many_places_in_one_text_take_linear_time(phrase):
    search = licenses.Searcher()
    search("warm " * 10)
    began = time.process_time()
    n, spans = search(f"{phrase} " * 100_000)
    assert time.process_time() - began < 12 and len({s["first_word"] for s in spans}) >= 100_000


def test_limits_of_a_large_group_are_near_exact_quantiles(spark):
    """50,000 documents of one source: the sketches sample there, their ranks are right to within 0.015."""
    rows = spark.range(0, 50_000, 1, 8).select(
        F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(1000).cast("long").alias("n_words"), F.lit(10).cast("long").alias("n_lines"),
        (F.lit(3000) + F.pmod(F.xxhash64("id"), F.lit(2001))).alias("word_chars"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300)).alias("n_symbols"),
        F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"),
    )
    got = quality_rules.limits(rows).first().limits
    for name, values in {"word_length": rows.select(F.col("word_chars") / 1000), "symbols": rows.select(F.col("n_symbols") / 1000)}.items():
        x = np.sort(np.array([r[0] for r in values.collect()]))
        at = lambda q: x[int(q * len(x))]
        outer, far, e = quality_rules.OUTER[name], quality_rules.SPREADS, 0.015
        most = [far * at(1 - outer - s * e) - (far - 1) * at(0.5 + s * e) for s in (1, -1)]
        least = [far * at(outer - s * e) - (far - 1) * at(0.5 + s * e) for s in (1, -1)]
        assert most[0] <= got[f"{name}_most"] <= most[1]
        assert least[0] <= got[f"{name}_least"] <= least[1]
