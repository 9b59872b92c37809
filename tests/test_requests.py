import json

import pytest

from lectern.options import AlignmentOptions, PostOptions, RequestOptions, TextOptions, ValidationOptions
from lectern.sources import requests as Q

BAD = [
    ("{", [("", "malformed JSON")]),
    ("[1]", [("", "malformed JSON")]),
    (None, [("", "malformed JSON")]),
    ('{"text": ""}', [("text", "text is empty")]),
    ("{}", [("text", "text is empty")]),
    ('{"text": "a", "best_of": 11}', [("best_of", "outside 1 to 10")]),
    ('{"text": "a", "best_of": 0, "max_retries": -1}', [("best_of", "outside 1 to 10"), ("max_retries", "outside 0 to 20")]),
    ('{"text": "a", "best_of": "many"}', [("best_of", "not of type int")]),
    ('{"text": "a", "best_of": null}', [("best_of", "null is not allowed")]),
    ('{"text": "a", "seed": [1, "x"]}', [("seed", "not of type seeds")]),
    ('{"text": "a", "return_timestamps": "maybe"}', [("return_timestamps", "not of type bool")]),
    ('{"text": "a", "text_processing": {"chunking_strategy": "other", "min_scene_break_length": 1}}', [("text_processing.chunking_strategy", "none of paragraph, balanced, greedy, simple"), ("text_processing.min_scene_break_length", "outside 2 to any")]),
    ('{"text": "a", "validation": {"alignment": {"window_size": 2}, "max_clipping_percentage": 101}}', [("validation.alignment.window_size", "outside 3 to 15"), ("validation.max_clipping_percentage", "outside 0 to 100")]),
    ('{"text": "a", "validation": 5}', [("validation", "not an object")]),
    ('{"text": "a", "validation": {"alignment": [1]}}', [("validation.alignment", "not an object")]),
    ('{"text": "a", "post_processing": {"export_format": "ogg"}}', [("post_processing.export_format", "none of mp3, wav, flac")]),
]


def check(spark, texts, engine="tone"):
    df = spark.createDataFrame([(i, t, engine) for i, t in enumerate(texts)], "i int, json string, engine string")
    return Q.checked(df, ["tone"]).orderBy("i").collect()


def test_every_kind_of_error_has_its_path(spark):
    for r, (_, want) in zip(check(spark, [t for t, _ in BAD]), BAD):
        assert [(e.path, e.problem) for e in r.errors] == want and r.status == 422 and r.request is None


def test_the_template_is_valid_and_has_the_defaults(spark):
    (r,) = check(spark, [json.dumps(Q.template())])
    assert r.status == 200 and r.unknown == []
    q = r.request.asDict(recursive=True)
    assert q["post_processing"]["silence_paragraph_ms"] == 600 and q["seed"] == [0] and q["validation"]["alignment"]["critical"] == {1: 0.15, 4: 0.20}
    (plain,) = check(spark, ['{"text": "Your text goes here."}'])
    assert plain.request == r.request
    for cls, part in ((TextOptions, q["text_processing"]), (ValidationOptions, {k: v for k, v in q["validation"].items() if k != "alignment"}), (AlignmentOptions, q["validation"]["alignment"]), (PostOptions, q["post_processing"])):
        assert cls(**part) == cls()


def test_values_are_typed(spark):
    text = '{"text": "a", "seed": [4, 0], "best_of": 3.0, "validation": {"max_silence_dbfs": null, "alignment": {"poor": {"1": 0.2}}}, "post_processing": {"normalize_audio": false, "lead_in_ms": 250}}'
    (r,) = check(spark, [text])
    q = r.request
    assert (q.seed, q.best_of, q.validation.max_silence_dbfs, q.validation.alignment.poor, q.post_processing.normalize_audio, q.post_processing.lead_in_ms) == ([4, 0], 3, None, {1: 0.2}, False, 250)


def test_unknown_fields_are_named_and_engines_checked(spark):
    text = '{"text": "a", "speed": 2, "validation": {"x": 1, "alignment": {"y": {}}}}'
    (r,) = check(spark, [text])
    assert (r.status, r.unknown) == (200, ["speed", "validation.alignment.y", "validation.x"])
    assert check(spark, [text], "other")[0].status == 404 and check(spark, [text], None)[0].status == 404


@pytest.mark.parametrize("o", [o for o in Q.compiled() if o.limit.get("low") is not None], ids=lambda o: ".".join(o.path))
def test_ranges_are_those_of_the_classes(o):
    """What the compiled range says is out of range is an error of the class, and its ends are not."""
    place = {v: k for k, v in Q.PLACES.items()}.get(o.path[:-1])
    cls = {"text": TextOptions, "validation": ValidationOptions, "alignment": AlignmentOptions, "post": PostOptions, None: RequestOptions}[place]
    cls(**{o.path[-1]: o.limit["low"]})
    with pytest.raises(ValueError):
        cls(**{o.path[-1]: o.limit["low"] - 1})
    if o.limit["high"] is not None:
        cls(**{o.path[-1]: o.limit["high"]})
        with pytest.raises(ValueError):
            cls(**{o.path[-1]: o.limit["high"] + 1})
