import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lectern.llm import components, simhash, substrings


def brute_fingerprint(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, fps, budget):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[find(i)].append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_near_duplicates_match_brute_force(docs, rows, empty):
    found = simhash.near_duplicates(docs, shingle=3, budget=2).collect()
    fps = [brute_fingerprint(r[1], 3) for r in rows]
    want = brute_groups([r[0] for r in rows], fps, 2)
    key = lambda x: tuple(map(str, x))
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in found], key=key) == sorted([(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want)], key=key)
    assert simhash.near_duplicates(empty, shingle=3).count() == 0


def test_trie_walk_and_split_lose_no_link(spark):
    rng = np.random.default_rng(3)
    seed = rng.integers(0, 2**63, 6, dtype=np.uint64)
    keys = {int(seed[rng.integers(6)]) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for _ in range(400)}
    fps = sorted(keys)
    pairs = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}
    got = {tuple(sorted((int(x), int(y)))) for p, q in simhash.walk(*[np.array(fps, np.uint64)] * 1, np.array(fps, np.uint64), 2, brute=4) for x, y in zip(p, q)}
    assert got == pairs
    signed = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for node_rows in (8, 2048):  # 8: nodes are split by joins
        links = simhash.close_links(signed, 2, node_rows)
        roots = {r.node: r.root for r in components.connected_components(links).collect()}
        sign = lambda f: int(np.uint64(f).view(np.int64))
        want = brute_groups([sign(f) for f in fps], fps, 2)
        assert [roots.get(sign(f), sign(f)) for f in fps] == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    roots = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(texts, n):
    seen, out = set(), []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone[i : i + n] = [True] * n
            seen.add(k)
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_repeats_match_brute_force(spark, rows, empty):
    plain = sorted({r[0]: r for r in rows if r[0] is not None}.values())
    docs = spark.createDataFrame([r[:2] for r in plain], "doc_id long, text string")
    for window in (20, 5):
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, window=window).collect()}
        assert [found[r[0]] for r in plain] == brute_removed([r[1] for r in plain], window)
    assert substrings.remove_repeats(empty).count() == 0


def test_spans_hold_the_words_of_their_source(docs, rows):
    one = docs.toDF(*"abcdefg").where("a is not null").select(F.col("a").alias("at"), F.col("b").alias("text")).dropDuplicates(["at"])
    words = {r.at: (r.text or "").split() for r in one.collect()}
    spans = [r for r in substrings.repeated_spans(one, 20).collect() if r.source is not None]
    assert len(spans) > 20 and max(min(r.stop, 10_000) - r.start for r in spans) > 40
    for r in spans:
        own, first = words[r.at][r.start : r.stop], words[r.source][r.source_start :][: r.stop - r.start]
        assert own == first and (r.source, r.source_start) < (r.at, r.start)


def test_copies_broadcast_or_salted(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else f"t{i}") for i in range(60)] + [(100, None), (101, None)], "at long, text string")
    one, two = (sorted(map(tuple, substrings.copies_of(df, n).collect())) for n in (1000, 0))
    assert one == two == [(i, 1) for i in range(2, 60) if i % 3]


def test_repeats_of_null_and_shared_ids(docs, rows):
    found = substrings.remove_repeats(docs, window=20).collect()
    assert len(found) == len(rows)
    null = next(r for r in found if r.doc_id is None)
    assert null.n_removed == 0 and null.n_words > 0


def test_both_ways_to_find_repeated_kmers_agree(docs, rows):
    one = docs.toDF(*"abcdefg").where("a is not null").select(F.col("a").alias("at"), F.col("b").alias("text")).dropDuplicates(["at"])

    def cover(df):
        return {(r.at, k) for r in df.collect() for k in range(r.start, min(r.stop, 10_000))}

    assert cover(substrings.repeated_spans(one, 20, filter_keys=0)) == cover(substrings.repeated_spans(one, 20))


def test_chains_of_paths_end_where_the_graph_branches(spark):
    # paths of five windows; p2 goes on to p3 or p4, p4 also begins a document
    places = {1: [(1, 0), (2, 5), (3, 10)], 2: [(1, 20), (2, 25), (3, 30)], 3: [(1, 7), (2, 12), (4, 17)], 4: [(4, 0)], 5: [(5, 0), (6, 5)], 6: [(5, 0), (6, 9)]}
    found = spark.createDataFrame([(p, -p, at, pos) for at, ps in places.items() for p, pos in ps], "d0 long, d1 long, at long, pos int")
    paths = found.groupBy("d0", "d1").agg(F.count("*").alias("n"), F.lit(5).alias("length"), F.min(F.struct("at", "pos")).alias("first"))
    got = {tuple(r) for r in substrings.repeated_chains(found, paths).select("at", "pos", "length", "source", "source_pos").collect()}
    # p5 and p6 are apart in document 6, so they are no chain
    assert got == {(2, 20, 10, 1, 0), (3, 7, 10, 1, 0), (2, 30, 5, 1, 10), (4, 0, 5, 3, 17), (6, 0, 5, 5, 0), (6, 9, 5, 5, 5)}


def test_long_passages_are_one_span_of_chains(spark):
    def text(*parts):
        return " ".join(f"{p}{i}" for p, n in parts for i in range(n))

    rows = [(1, text(("a", 300), ("b", 200))), (2, text(("x", 10), ("a", 300), ("b", 200), ("y", 5))), (3, text(("b", 200), ("z", 30))), (4, text(("a", 300), ("w", 40)))]
    docs = spark.createDataFrame(rows, "at long, text string")
    spans = {(r.at, r.start, r.stop, r.source, r.source_start) for r in substrings.repeated_spans(docs, 20).collect()}
    covered = {at: sorted({w for a, s, e, *_ in spans if a == at for w in range(s, e)}) for at in (2, 3, 4)}
    assert covered == {2: list(range(10, 510)), 3: list(range(200)), 4: list(range(300))}
    assert max(e - s for a, s, e, src, _ in spans if a == 2 and src == 1) >= 450
