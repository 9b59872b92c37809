import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, licenses, quality_rules, urls


def test_license_places_and_edits(spark, docs, rows, empty):
    texts = ["Released under the MIT License.", "x Apache License, Version 2.0 and under the mit license", "released under teh mit license", "Licensed under CC BY-NC 4.0.", "the GNU General Publc License", "nothing here", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.license_summary(licenses.find_licenses(df)).collect()}
    assert (out[0].n_base, out[0].first_word, out[0].base_labels, out[0].labels, out[0].score) == (1, 1, "mit", "mit", 1.0)
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (2, 1, 7, "apache-2,mit")
    assert out[2].n_base == 0 and out[2].labels == "mit" and 0 < out[2].score < 1
    assert out[3].labels == "cc-by-nc" and out[4].labels == "gpl"
    assert all(out[k].labels == "" and out[k].score == 0 and out[k].first_word is None for k in (5, 6, 7))
    assert licenses.find_licenses(docs).count() == len(rows) and licenses.find_licenses(empty).count() == 0


def test_every_match_within_the_bound_has_a_seed():
    rng = __import__("random").Random(4)
    search = licenses.Searcher()
    for label, notice, errors, _ in search.notices:
        for _ in range(20):
            t = list(notice)
            for _ in range(errors):
                k = rng.randrange(len(t))
                t[k] = "q"
            assert any(s in "".join(t) for _, s in licenses.pieces(notice, errors))


def brute_figures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:]))
    cover = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality_figures_match_brute_force(docs, rows, empty):
    found = quality_rules.quality_rules(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert got == Counter((r[0], *brute_figures(r[1])) for r in rows)
    assert all(not r.kept for r in found if r.base_failed)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_limits_follow_the_group(spark):
    rows = [(i, " ".join(f"w{j}x{i}" for j in range(60)) + (" # # #" if i % 2 else ""), "en", "a" if i < 500 else None) for i in range(1000)]
    rows.append((1000, "#! " * 60 + " ".join(f"v{j}" for j in range(60)), "en", "a"))
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(out[i].kept for i in range(1000)) == 1000 and not out[1000].kept


def brute_url(url, rules, hosts):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(k), k, v) for v, ks in rules.items() for k in ks for h, p in [(k[: k.index("/")], k[k.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = [h for h in hosts if host == h or host.endswith("." + h)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if listed else "allow"


def test_url_cascade_matches_brute_force(spark):
    rules = {"allow": ["org/", "com/fr/"], "block": ["example.org/es/", "example.org/en/1", "com/de/"]}
    list_ = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.ORG/en/12?q", "https://example.org#f", "http://org/", "http://org", "http://xorg/fr/", "http://b.com/de", "http://b.com/de/é"]
    list_ += [f"http://h{i}.example.{t}/{p}/{i}" for i in range(150) for t in ("com", "net", "org") for p in ("en", "es", "fr", "de")]
    hosts = [f"h{i}.example.net" for i in range(0, 150, 3)] + ["b.com", "missing.net"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(list_)], "page_id long, url string, u2 string").toDF("page_id", "url", "URL")
    out = urls.filter_urls(pages, rules, spark.createDataFrame([(h,) for h in [*hosts, None]], "host string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: brute_url(u, rules, hosts) for i, u in enumerate(list_)}
    assert urls.filter_urls(pages.limit(0), rules, spark.createDataFrame([], "host string")).count() == 0


def test_cascade_in_shards(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%7'")
    many = urls.build(universe, listed, shard_keys=40, broadcast_bytes=200)
    assert len(many) > 1
    rows = universe.select("key", F.array("key").alias("keys"))
    out = urls.first_listed(rows, "keys", {"x": many}, "hit")
    assert {r.key for r in out.where("hit is not null").collect()} == {r.key for r in listed.collect()}


ITEM = "A train leaves Boston at 60 km per hour and then Alice counts 12 apples while Alice eats 3 of them on the way home"


@pytest.mark.parametrize("text, found", [
    (ITEM, True),
    ("Intro words.\n" + ITEM + "\nand more", True),
    (ITEM.replace("60", "75").replace("Alice", "Maria").replace("12", "40"), True),
    (ITEM.replace("km", "miles"), True),
    (ITEM.replace("Alice eats", "Zoe eats"), False),
    (ITEM[: len(ITEM) // 2], False),
    ("", False),
    (None, False),
])
def test_templates(spark, text, found):
    docs = spark.createDataFrame([(5, text, "q")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    assert [r.item_id for r in decontaminate.contaminated(docs, bench).collect()] == ([1] if found else [])


def test_planted_passages_are_found_and_others_left(spark, docs, rows, empty):
    bench = spark.createDataFrame([(k, rows[k][1]) for k in range(40)], "item_id long, text string")
    hits = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert all((k, k) in hits for k in range(40) if len(rows[k][1].split()) >= 5)
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
