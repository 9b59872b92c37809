import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Text` string, `DOC_ID` string"


def sentence(rng, n):
    return " ".join(rng.choice("the of and to in is that for with stone river lamp green ninety train") + rng.choice(["", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, hot lines, nulls, empty and long ones, repeated rows, and columns whose names clash."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(1, 120)) + "\n" + sentence(rng, 30) for _ in range(60)]
    hot = "one very common line that stands in a great many documents of this small table as it does in large ones too indeed yes"
    texts = [*base, *base[:5], *(t + " tail" for t in base[5:10]), *(f"{t}\n{hot}\n{t[:40]}" for t in base[10:30]), hot, hot, "", None, " \n\t ", "word", "a b a b a b " * 40, sentence(rng, 6000)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return [*out, out[3], (None, base[7], "en", "a", 1, "x", "y"), (2, "another text under one id", "en", "b", 1, "x", "y")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, t2 string, d2 string")
    return df.toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT", "DOC_ID")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
