import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import exponion, merkle, substrings, suffixes


# --- repeated bytes ---------------------------------------------------------------------------


def brute_removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    often = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if often[r[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def removed(df, **more):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in suffixes.remove_repeated_bytes(df, **more).collect())


@pytest.mark.parametrize("length, keys", [(400, 1 << 26), (60, 0), (11, 1 << 26), (3, 1 << 26)])
def test_repeated_bytes_match_brute_force(docs, rows, empty, length, keys):
    want = sorted((str(r[0]), *x) for r, x in zip(rows, brute_removed([r[1] for r in rows], length)))
    assert removed(docs, length=length, filter_keys=keys) == want
    assert suffixes.remove_repeated_bytes(empty, length=length).count() == 0


def test_repeats_at_every_edge(spark):
    """Passages cut at all places, periods, ties, overlaps, other scripts, and a text of 400 bytes to the byte."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh é字") for _ in range(n))
    base = word(900)
    texts = [base[:450] + word(300), word(10) + base[20:430] + word(50), base[200:620], "a" * 1000, "ab" * 700, "ab" * 199, "x" * 400, "x" * 400, "y" * 399, "y" * 399, word(2000), base, "z" * 401, "é" * 250]
    texts += [word(k) + base[400 + k : 660 + 7 * k] + word(30) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (400, 64):
        want = sorted((str(i), *x) for i, x in enumerate(brute_removed(texts, length)))
        assert removed(df, length=length) == want


def test_batches_of_texts_are_small(spark, monkeypatch):
    """What Python holds of texts at once is a shard's, not 10,000 documents; the session's own setting stays."""

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, real = spark.conf.get(name), {}, suffixes.staged
    most = lambda df, rows: real(df.mapInArrow(sizes, "n long"), "sizes", rows).agg(F.max("n")).first()[0]
    whole = spark.range(0, 3000, 1, 1)
    assert most(whole, None) == 3000
    assert most(whole, 500) == 500
    spark.conf.set(name, 70)
    assert most(whole, 500) == 70
    assert spark.conf.get(name) == "70"
    spark.conf.set(name, before)

    def watched(df, table, rows=None):
        seen[table] = rows
        return real(df, table, rows)

    monkeypatch.setattr(suffixes, "staged", watched)
    docs = spark.createDataFrame([(i, "x" * 30 + f"{i % 3} and more") for i in range(9)], "doc_id long, text string")
    assert suffixes.remove_repeated_bytes(docs, length=20, texts=False).count() == 9
    assert {seen.get(t) for t in ("repeated", "runs", "strings", "removed")} == {suffixes.SHARD_ROWS}
    assert spark.conf.get(name) == before


def test_interleaving_gives_common_prefixes(spark):
    """Two shards' runs: depth is the number of symbols shared with another suffix."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (60, suffixes.SYMBOLS)).tolist()
    sure = suffixes.sampler(400).sure
    rows = [(i, hash(tuple(s[:sure])), s[sure:], i, i, 1) for i, s in enumerate(x)]
    runs = spark.createDataFrame(rows, "run long, m long, symbols array<long>, w0 long, w1 long, n long")
    found = suffixes.interleaved(runs, 400).collect()
    known = Counter(r.interval for r in found)
    got = {r.run: (r.depth, r.repeated) for r in found if known[r.interval] > 1}
    shared = lambda a, b: next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), suffixes.SYMBOLS)
    want = {i: (d, False) for i, s in enumerate(x) if (d := max(shared(s, o) for j, o in enumerate(x) if j != i)) >= sure}
    assert got == want and len(want) > 10


def test_transform_is_in_order():
    rng = np.random.default_rng(1)
    symbols, digests = rng.integers(0, 2, (50, 3)).astype(np.uint64), rng.integers(0, 2, (50, 2))
    order, begins = suffixes.transform(symbols, digests)
    held = [(*symbols[i].tolist(), *digests[i].tolist()) for i in order]
    assert held == sorted(held) and [held[b] for b in begins] == sorted(set(held))


# --- k-means ----------------------------------------------------------------------------------


def plain_clusters(vectors, k, rounds, seed="3"):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    points = [v for _, v in sorted(kept, key=key)[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        at = [min(range(len(points)), key=lambda c: (d(v, points[c]), c)) for _, v in kept]
        if n < rounds:
            for c in range(len(points)):
                own = [v for (_, v), a in zip(kept, at) if a == c]
                if own:
                    points[c] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, a, d(v, points[a]), hashlib.sha256(",".join(map(str, points[a])).encode()).hexdigest()) for (i, v), a in zip(kept, at)]


@pytest.mark.parametrize("k", [1, 2, 7, 40])
def test_clusters_match_plain_loops(spark, k):
    rng = random.Random(k)
    vectors = [(i, [rng.choice([0.0, 0.25, 0.5, 1.0]) + rng.choice([0, 0, rng.random()]) for _ in range(4)]) for i in range(300)]  # many ties
    vectors += [(i, vectors[i][1]) for i in range(10)] + [(None, [0.1] * 4), (None, [0.1] * 4)]
    vectors += [(900, [0.1] * 3), (901, None), (902, [None, 1.0, 1.0, 1.0]), (903, [math.nan] * 4), (904, [math.inf] * 4), (905, [])]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<double>, label int, e2 string").toDF("vec_id", "embedding", "LABEL", "VEC_ID")
    got = exponion.cluster(df, k=k, rounds=6, size=4).collect()
    want = plain_clusters(vectors, k, 6)
    assert sorted(map(str, want)) == sorted(str((r.vec_id, r.cluster, r.distance, r.centroid_sha256)) for r in got)
    sums = Counter()
    for r in got:
        sums[r.cluster] += r.distance
    assert all(r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values()) for r in got)
    assert exponion.cluster(df.limit(0), k=k, size=4).count() == 0


def test_balls_spare_distances(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 50
    rows = [(i, (centres[i % 40] + rng.normal(size=8)).tolist()) for i in range(4000)]
    out = exponion.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=40, rounds=8, size=8).first()
    assert out.scanned < 0.35 * 4000 * 40 * 9


def test_exponion_round_is_a_full_scan():
    """Bounds carried over rounds of arbitrary moves, with equal centroids among them, give what a full scan gives."""
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (500, 3)) * 10
    points = rng.integers(-3, 4, (12, 3)) * 10
    state = (None, np.zeros(0), np.zeros(0))
    moved = np.zeros(12)
    for _ in range(12):
        now = exponion.Centroids(points, moved)
        *state, _ = exponion.assigned(v, *state, now)
        d = ((v[:, None] - points[None]) ** 2).sum(axis=2)
        assert (state[0] == d.argmin(axis=1)).all()
        step = rng.integers(-2, 3, points.shape) * rng.integers(0, 2, (12, 1)) * 5
        points, moved = points + step, np.sqrt((step**2).sum(axis=1).astype(float))


# --- manifests --------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes):
    """Root, and for each node its siblings from below (before, after) up."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, merged = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j in range(len(run)):
                for i in groups[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            parents.append(sha(*run))
            merged.append([i for g in groups[k : k + 3] for i in g])
        nodes, groups = parents, merged
    return nodes[0], paths


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n = r[:5]
        leaf = plain_leaf((doc_id, source, lang, n, text))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        trees[source].append((doc_id is not None, doc_id or 0, leaf, plain_leaf((doc_id, source, lang, n, text.replace("\n", ""))) if hit else leaf, doc_id))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = [plain_tree([x[2] for x in sorted(trees[s])]) for s in sources]
    root, above = plain_tree([m[0] for m in made])
    out = []
    for s, (subroot, paths), more in zip(sources, made, above):
        for x, path in zip(sorted(trees[s]), paths):
            node = x[3]
            for a, b in path + more:
                node = sha(a, node, b)
            out.append((str(x[4]), x[2], subroot, root, sha(*(h for p in path + more for h in p)), node, node == root))
    return sorted(out)


def manifest_rows(df):
    found = merkle.document_manifest(df, tampered=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    return sorted(tuple(v if isinstance(v, bool) else str(v) for v in r[:7]) for r in found.collect())


def test_manifest_matches_plain_trees(docs, rows, empty):
    assert manifest_rows(docs) == plain_manifest(rows)
    assert merkle.document_manifest(empty).count() == 0


def test_manifest_of_several_passes(spark):
    """A source above one bundle, sources above one bundle, sources of one row, many rows that are alike."""
    rows = [(i, f"text\n{i}", "en", "big", i) for i in range(1500)] + [(7, "same\n", "en", "big", 1)] * 800
    rows += [(10_000 + i, "t", None, f"s{i}é" if i else None, 1) for i in range(760)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_rows(df.repartition(5)) == plain_manifest(rows)


def test_proofs_verify_and_show_a_change(docs):
    for r in merkle.document_manifest(docs, proofs=True).collect():
        assert r.verified and sha(r.proof) == r.proof_sha256 and len(r.proof) % 64 == 0


def test_slots_are_cut_and_spliced():
    path = [(1, "a" * 64 + "b" * 64 + "c" * 64), (0, "d" * 64)]
    assert merkle.siblings(path) == "a" * 64 + "c" * 64
    assert merkle.fold("x" * 64, path) == sha(sha("a" * 64 + "x" * 64 + "c" * 64))


def test_op5_brings_few_texts_to_python_at_once(spark, monkeypatch):
    """As op12: batches of 500 texts, and none of them come back from Python."""
    seen, real = {}, substrings.staged

    def watched(df, table, rows=None):
        seen[table] = (rows, df.columns)
        return real(df, table, rows)

    monkeypatch.setattr(substrings, "staged", watched)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 3) * 5 + k}" for k in range(40 + i))) for i in range(9)] + [(9, None), (10, "")], "doc_id long, text string")
    short = substrings.remove_repeats(docs, window=20, texts=False)
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert short.columns == columns
    got = sorted(map(tuple, short.collect()))
    assert got == sorted(map(tuple, substrings.remove_repeats(docs, window=20).select(*columns).collect())) and len(got) == 11
    assert sum(r[2] for r in got) > 0
    assert {seen[t][0] for t in ("repeated", "runs", "removed")} == {substrings.BATCH_ROWS} and "kept" not in seen["removed"][1]
