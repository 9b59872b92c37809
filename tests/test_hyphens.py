import random

from pyspark.sql import functions as F

from lectern.functions import hyphens as H


def plain_breaks(word, patterns):
    """Every pattern tried at every place."""
    text, best = f".{word.lower()}.", {}
    for p in patterns:
        letters, points = H.parsed(p)
        for at in range(len(text) - len(letters) + 1):
            if text[at : at + len(letters)] == letters:
                for k, x in enumerate(points):
                    best[at + k] = max(best.get(at + k, 0), x)
    return [i for i in range(2, len(word) - 1) if best.get(i + 1, 0) % 2]


def test_patterns_are_read():
    assert H.parsed(".ab3c2") == (".abc", [0, 0, 0, 3, 2]) and H.parsed("1a") == ("a", [1, 0])


def test_priorities():
    patterns = ["a1b", "1ba", "ab2a", ".ab3a", "na4b."]
    trie = H.Trie(patterns)
    for word, want in (("cabana", [2]), ("aaba", [2]), ("banab", [])):
        assert trie.breaks(word) == plain_breaks(word, patterns) == want


def test_trie_matches_the_plain_matcher_on_all_words(spark):
    rng = random.Random(3)
    patterns = ["".join(rng.choice(["", "", str(rng.randint(1, 5))]) + c for c in rng.choices("aeioubcdlrst", k=rng.randint(1, 4))) for _ in range(300)] + [".re1", "1tion.", "4ed."]
    words = {w for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").collect() for w in r.text.split()}
    trie = H.Trie(patterns)
    assert len(words) > 500 and all(trie.breaks(w) == plain_breaks(w, patterns) for w in words)


def test_syllables_of_texts(spark):
    table = H.broadcast_patterns(spark.createDataFrame([(p,) for p in H.vowel_patterns()] + [(None,)], "pattern string"))
    rows = [("banana", 2), ("ba-na-na computer", 3 + 3), ("", 0), (None, 0), ("xyz ... winter", 1 + 1 + 2)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string")
    got = [r.n for r in df.select("i", H.hyphen_syllables(F.col("text"), table).alias("n")).orderBy("i").collect()]
    assert got == [sum(len(plain_breaks(w, H.vowel_patterns())) + w.count("-") + 1 for w in (t or "").split()) for t, _ in rows]
