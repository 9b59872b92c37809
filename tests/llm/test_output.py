import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import mixing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_mix_meets_targets(docs, rows, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.source_size].append(r)
    total = sum(k for k in by)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total)
    for k, v in by.items():
        assert abs(sum(r.taken for r in v) - v[0].target) <= 1 and v[0].target <= 2 * k
    assert mixing.mix(empty).count() == 0


def test_water_level(spark):
    s = spark.createDataFrame([(5.0, 100), (2.0, 1000), (1.0, 1000)], "weight double, source_size long")
    level = mixing.water_level(s, 2100.0, 2)
    assert min(5 * level, 200) + 2 * level + level == pytest.approx(2100)
    assert mixing.water_level(s, 1e9, 2) == float("inf")


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 65536, 65537):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        payload, index = tokens.pack(ids, planes)
        assert (tokens.unpack(payload, index, n, planes, tokens.BLOCK_IDS) == ids).all()


def test_token_files_hold_the_library_ids(docs, rows, empty):
    tk, start, want = Tokenizer.from_file(PATH), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tk.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_files(docs, PATH).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    assert tokens.token_files(empty, PATH).count() == 0


@pytest.mark.parametrize("text", ["", "  ", "it's\t'll", "a\x1cb é é 'S don't <|endoftext|>x ΟΔΟΣ Σ q ́z\ń 12 3.5km ﬁ", "Ü" * 5000])
def test_word_encoder_is_the_tokenizer(text):
    assert tokens.WordEncoder(PATH).encode(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_word_encoder_on_odd_pieces():
    import random

    rng, tk, own = random.Random(1), Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)
    for _ in range(2000):
        text = "".join(rng.choice("abcXYé.,'!#<|>19\"-_sdtm \ń") for _ in range(rng.randint(1, 30)))
        assert own.encode(text).tolist() == tk.encode(text, add_special_tokens=False).ids


def test_tokenizers_that_keep_white_space_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  words,\n and a third."
    assert tokens.WordEncoder(path).encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_mixed_is_the_same_again_with_repeated_ids(docs, rows):
    one, two = (sorted(map(str, mixing.mixed(docs).collect())) for _ in range(2))
    assert one == two and len(one) > 0


def test_copies_share_what_is_taken_of_them(spark):
    rows = [(None, "one two three", "s")] * 9 + [(i, "w " * (i + 1), "t") for i in range(30)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    copies = [r for r in out if r.doc_id is None]
    assert len(copies) == 9 and sum(r.taken for r in copies) == pytest.approx(copies[0].target, abs=1) and all(r.taken <= 6 for r in copies)


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from lectern.llm.common import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))
