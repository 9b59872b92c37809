import re
import random

from pyspark.sql import functions as F

from lectern.operators import sentence_ends as E
from lectern.operators.chunking import chunk_documents
from lectern.options import TextOptions

SHORT = {"en": ["capt", "approx", "e.g"], "de": ["bzgl", "zzgl"]}


def corpus(n=120, seed=5):
    """Documents with planted abbreviations, and how many sentences and abbreviations each has."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(80)]
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        sentences, planted = [], 0
        for _ in range(r.randint(3, 9)):
            ws = [r.choice(words) for _ in range(r.randint(5, 12))]
            ws[0] = ws[0].title() if r.random() < 0.7 else "The"
            if r.random() < 0.6:
                ws.insert(r.randint(1, len(ws) - 1), r.choice(SHORT[lang]) + ".")
                planted += 1
            sentences.append(" ".join(ws) + r.choice("..?!"))
        rows.append((i, lang, " ".join(sentences), len(sentences), planted))
    return rows


def test_planted_abbreviations(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, n int, planted int")
    learned = E.learned_ends(docs)
    got = {r.lang: r for r in learned.collect()}
    assert {k: set(v.abbreviations) for k, v in got.items()} == {k: set(v) for k, v in SHORT.items()}
    assert "the" in got["en"].starters
    sizes = E.with_ends(docs, learned).select("n", F.size(E.split_learned(F.col("text"), F.col("__ends"))).alias("m")).collect()
    wrong = sum(abs(r.n - r.m) for r in sizes)
    assert wrong <= 0.02 * sum(r[4] for r in rows)


def test_starter_ends_a_sentence_behind_an_abbreviation(spark):
    learned = spark.createDataFrame([("en", ["capt", "e.g"], ["the"])], "lang string, abbreviations array<string>, starters array<string>")
    texts = ["He met Capt. Ahab. (Capt. The crew left.", "Capt. the ship", "See e.g. this? \"Yes.\" No", "ends capt.", "", None, "a.  \n\n b. \tc"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)] + [(9, None, "Capt. Ahab"), (10, "xx", "Capt. Ahab")], "doc_id long, lang string, text string")
    got = {r.doc_id: r.s for r in E.with_ends(docs, learned).select("doc_id", E.split_learned(F.col("text"), F.col("__ends")).alias("s")).collect()}
    assert got == {
        0: ["He met Capt. Ahab.", "(Capt.", "The crew left."], 1: ["Capt. the ship"], 2: ["See e.g. this?", '"Yes."', "No"], 3: ["ends capt."],
        4: [], 5: None, 6: ["a.", "b.", "c"], 9: ["Capt.", "Ahab"], 10: ["Capt.", "Ahab"],
    }


def test_copies_and_empty_tables(spark):
    # one context repeated is no evidence, and neither are nulls
    rows = [(i, "en", "some words stand here before zot. Next one") for i in range(50)] + [(90, None, None), (91, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert [r.abbreviations for r in E.learned_ends(docs).collect()] == [[]]
    assert E.learned_ends(docs.where("false")).count() == 0


def test_chunks_by_learned_ends(spark):
    learned = spark.createDataFrame([("en", ["zzgl"], [])], "lang string, abbreviations array<string>, starters array<string>")
    docs = spark.createDataFrame([(1, "en", "Short intro here. The cost zzgl. Taxes of some kind, paid late.")], "doc_id long, lang string, text string")
    o = TextOptions(chunking_strategy="greedy", max_chunk_length=60, ideal_chunk_length=50)
    text = lambda d: [r.text for r in d.orderBy("chunk_idx").collect()]
    assert text(chunk_documents(docs, o, learned=learned)) == ["Short intro here.", "The cost zzgl. Taxes of some kind, paid late."]
    assert text(chunk_documents(docs, o)) == ["Short intro here. The cost zzgl.", "Taxes of some kind, paid late."]


def test_long_text_is_linear(spark):
    learned = spark.createDataFrame([("en", ["capt"], ["the"])], "lang string, abbreviations array<string>, starters array<string>")
    docs = spark.range(1).select(F.lit("en").alias("lang"), F.repeat(F.lit("A capt. went. "), 40_000).alias("text"))
    assert E.with_ends(docs, learned).select(F.size(E.split_learned(F.col("text"), F.col("__ends"))).alias("n")).first().n == 40_000


def test_words_are_counted_before_patterns_run(spark):
    import random

    rng = random.Random(5)
    words = ["Dr.", "dr.", "(dr.)", "etc..", "a", "Bee", "bee,", "3.", "x.y.", "—", "No?", "yes!"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame([(rng.choice(["en", None]), t) for t in texts] + [("en", None)], "lang string, text string")
    want, kinds = {}, {}
    for lang, text in df.collect():
        ws = (text or "").split()
        for w, ahead in zip(ws, ws[1:] + [""]):
            f = re.sub(r"^[^\w]+|[^\w.]+$", "", w).lower()
            if not re.search("[a-z]", f):
                continue
            key = (lang or "", f.rstrip("."))
            n = want.setdefault(key, [0, 0])
            n[0] += 1
            if re.search(r"[^.]\.$", f):
                n[1] += 1
                kinds.setdefault(key, set()).update({(ord(ahead[0]) * 31 + len(ahead)) % 63} if ahead else set())
    got = {(r.lang, r.form): (r.n_all, r.n_dot, r.kinds) for r in E.form_counts(df).collect()}
    assert got == {k: (*n, len(kinds.get(k, ()))) for k, n in want.items()}
    plan = E.form_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # no text is split again for its neighbours or by a filter
