import random

import pytest

from lectern.llm import decontaminate
from tests.llm import plain

JANET = "Janet has 12 apples. Janet eats 3 and gives 4 to Tom. Janet sells the rest for 2 dollars each. How much money does Janet make?"
TRIP = "A bus goes from Paris to the coast with 1200 people at 60 miles per hour and comes back at night with half of them while the others stay by the sea"


def found(spark, item, text):
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    return [tuple(r) for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()]


@pytest.mark.parametrize("text, hit", [
    (JANET, True),
    (JANET.replace("Janet", "Maria"), True),
    (JANET.replace("Janet", "Maria").replace("12", "30").replace("Tom", "Ann"), True),
    (JANET.replace("Janet eats", "Maria eats").replace("Janet sells", "Zoe sells"), False),
])
def test_names_that_start_sentences(spark, text, hit):
    assert bool(found(spark, JANET, text)) == hit


@pytest.mark.parametrize("text", [
    TRIP.replace("Paris", "New York"),
    TRIP.replace("1200", "1 200"),
    TRIP.replace("miles per hour", "km/h"),
    TRIP.replace("back at", "back late at"),
    TRIP.replace("the others", "others"),
])
def test_values_of_other_lengths_and_words_put_in(spark, text):
    assert found(spark, TRIP, text)


def test_spans_are_in_words_of_the_document(spark):
    text = TRIP.replace("Paris", "New York")
    assert found(spark, TRIP, f"Some words before\n{text}\nand after") == [(5, 1, 1.0, 3, len(text.split()))]


TWELVES = "if a box takes 12 jars and every jar takes 12 plums then how many plums are in 12 boxes when 12 of the jars in all of those boxes are broken on the way to the shop by the road"


@pytest.mark.parametrize("values", [("30", "30", "30", "30"), ("31", "30", "30", "30"), ("30", "30", "30", "31"), ("30", "31", "30", "30")])
def test_an_odd_value_counts_alike_wherever_it_stands(spark, values):
    parts = TWELVES.split("12")
    text = parts[0] + "".join(v + p for v, p in zip(values, parts[1:]))
    [(_, _, share, *_)] = found(spark, TWELVES, text)
    assert share == pytest.approx(plain.share_found(TWELVES, text)) and (share == 1.0) == (len(set(values)) == 1)


def test_most_windows_against_all_mappings():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(1, 14)
        pairs = [[(rng.randint(1, 4), rng.randint(1, 4)) for _ in range(rng.randint(0, 3))] for _ in range(n)]
        slots, values = {p: [a for a, _ in w] for p, w in enumerate(pairs)}, {p: [b for _, b in w] for p, w in enumerate(pairs)}
        want = plain.most_windows(pairs)
        assert decontaminate.consistent([(p, p) for p in range(n)], slots, values) == want
        assert decontaminate.consistent([(p, p) for p in range(n)], slots, values, want + 1) == 0


def test_repeated_windows_stay_as_many_rows_as_the_document_has_words(spark):
    line = "the calm old river runs by the small grey town "
    docs = spark.createDataFrame([(1, line * 700), (2, line * 5)], "doc_id long, text string")
    item = spark.createDataFrame([(1, line * 6)], "item_id long, text string")
    out = decontaminate.contaminated(docs, item).collect()
    assert [(r.doc_id, r.item_id, r.share) for r in out if r.share == 1.0] == [(1, 1, 1.0)]
