"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of 64 bits can't tell that similarity: at 0.8 a pair differs in about ten
bits, and a trie with so wide an error budget compares almost all with all. So
candidates come from SimHash links of two bits and from bands of MinHash values: two
documents at 0.8 share none of the bands with a chance of 5 in a million, and a smaller
one the more alike they are. Every candidate is then compared by its exact sets.

Equal sets are one from the start. Each member of a bucket is compared with a centre of
it, in a few rounds: one by chance, then the one with most of its shingles in common with
many others, and each time only where the bucket still has several components. Chance
ranks rows alike in all buckets, so buckets of the same rows have one centre, and a pair
is not made anew for each of them. A round hands on components, not all links. So a large
group of near copies is joined without taking its pairs. Of two documents still apart,
those that share a shingle that few have are found by it. Others share only what many
have, so the number of such shingles in each bounds their similarity, which leaves out
nearly all pairs of a bucket before they are made; one of the two is never in the bucket's
largest component. What is left is compared exactly.

Pages of one template are alike in nearly all they have, so common shingles bound nothing.
In a bucket with many components, where some members would get over a hundred partners
each, a text is therefore described by its difference from
what most of the group have: shingles of its own and common ones that it lacks. What two
texts have in common cancels: at similarity s their differences may differ in (n + m) *
(1 - s) / (1 + s) shingles at most. So they have to share most of their differences, less
what that allows, and texts whose differences are their own match none. Shingles that the
same texts have or lack count as one part with a weight. A text that can miss k of its
parts has JOINT of those shared among its k + JOINT rarest: pairs are made of texts with a
set of JOINT such parts in common, which few have who aren't alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import by_id, pick, portions, small, staged
from lectern.llm.components import connected_components
from lectern.llm.simhash import close_links

#: MinHash values of a band, and bands: (1 - 0.8 ** 6) ** 40 is 5e-6.
BAND, BANDS = 6, 40
#: Rounds in which the members of a bucket are compared with a centre.
CENTRES = 3
#: Buckets with more components than LARGE, where common shingles leave over DENSE pairs a member (by those of about SEEKERS members), are searched by what texts differ in.
LARGE, DENSE, SEEKERS = 64, 100, 64
#: Parts of differences that have to be shared together, and most that a text may miss for that; with more one part is a key.
JOINT, MISSED = 4, 8
#: A shingle is common in more documents than that, else pairs are made of those that have it.
FEW = 16
#: Classes of set sizes have this ratio.
SIZE_STEP = 1.05
#: Shingles whose MinHash values are taken at once.
STEP = 1024

_FACTORS = np.random.default_rng(29).integers(1 << 62, 1 << 63, BAND * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(31).integers(1 << 62, 1 << 63, (BANDS, BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; a shorter text is one shingle, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line, size = b" ".join(words), min(shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts)))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band of MinHash values."""
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(found), STEP):
        np.minimum(least, np.multiply.outer(_FACTORS, found[at : at + STEP]).min(1), out=least)
    mixed = ((least ^ least >> np.uint64(31)).reshape(BANDS, BAND) * _MIX).sum(1, dtype=np.uint64)
    return (mixed ^ mixed >> np.uint64(29)) * _FACTORS[:BANDS]


def bits(found: np.ndarray) -> int:
    """SimHash of a set of shingles; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 65536):
        counts += np.unpackbits(found[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _key(found: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(found.tobytes())


def _signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th, key (of the set), fp, n, bands of every row (doc_id, text, th: a hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions([batch]):
                sets = [grams(t.as_py(), shingle) for t in part.column(1)]
                key = pa.array([_key(s) for s in sets], pa.string())
                fp = pa.array(np.array([bits(s) for s in sets], np.uint64).view(np.int64))
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.record_batch([part.column(0), part.column(2), key, fp, n, _lists([bands(s) if len(s) else s for s in sets])], names=["doc_id", "th", "key", "fp", "n", "bands"])

    return rows.mapInArrow(run, "doc_id long, th long, key string, fp long, n long, bands array<long>")


def _sets(rows: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """row, grams of the needed rows (row, doc_id, th, key; staged), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions([batch]):
                sets = [grams(t.as_py(), shingle) for t in part.column(0)]
                yield pa.record_batch([pa.array([_key(s) for s in sets], pa.string()), _lists(sets)], names=["key", "grams"])

    asked = small(needed.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct())
    texts = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_semi").select("text")
    found = texts.mapInArrow(run, "key string, grams array<long>").groupBy("key").agg(F.first("grams").alias("grams"))
    return staged(found.join(needed.select("key", "row"), "key").select("row", "grams"), "grams")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose sets are that similar, compared exactly; staged."""
    left, right = sets.toDF("a", "ga"), sets.toDF("b", "gb")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ga", "gb")))
    union = F.size("ga") + F.size("gb") - F.col("common")
    return staged(both.where(F.col("common") >= F.lit(similarity) * union - 1e-9).select("a", "b"), "alike")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (row, n, value) with their root, of buckets that have several; staged."""
    held = members.select("row", "n", "value").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    several = held.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("value")
    return staged(held.join(several, "value", "left_semi"), "apart")


def _common(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows of members: row, root, n, f (shingles that more than FEW rows have, staged), and row, root, n, g (shingles that fewer rows, but several components have)."""
    rows = staged(members.select("row", "root", "n").distinct(), "rows")
    each = sets.join(rows, "row").select("row", "root", "n", F.explode("grams").alias("g"))
    counts = each.groupBy("g").agg(F.count("*").alias("k"), F.min("root").alias("x"), F.max("root").alias("y"))
    counts = staged(counts.where(f"k > {FEW} or x <> y").select("g", "k"), "shared")
    common = each.join(counts.where(f"k > {FEW}"), "g", "left_semi").groupBy("row").agg(F.count("*").alias("f"))
    held = staged(rows.join(common, "row", "left").withColumn("f", F.coalesce("f", F.lit(0))), "common")
    return held, each.join(counts.where(f"k <= {FEW}"), "g", "left_semi")


def _families(members: DataFrame, sets: DataFrame, large: DataFrame) -> DataFrame:
    """row, root, n, family (rows that large buckets connect), d (shingles that either the row or most of its family has); staged."""
    held = staged(members.join(large, "value").select("row", "root", "n", "head").distinct(), "large")
    roots = connected_components(held.select(F.col("row").alias("a"), F.col("head").alias("b")))
    rows = staged(held.select("row", "root", "n").distinct().join(roots.toDF("row", "family"), "row"), "families")
    total = rows.groupBy("family").agg(F.count("*").alias("t"))
    each = sets.join(rows, "row").select("family", F.explode("grams").alias("g"))
    most = each.groupBy("family", "g").agg(F.count("*").alias("k")).join(total, "family").where("2 * k > t")
    most = most.groupBy("family").agg(F.collect_list("g").alias("q"))  # at most twice as many as a text of the family has on the average
    both = rows.join(sets, "row").join(most, "family", "left").withColumn("q", F.coalesce("q", F.array().cast("array<long>")))
    return staged(both.select("row", "root", "n", "family", F.concat(F.array_except("grams", "q"), F.array_except("q", "grams")).alias("d")), "differences")


def _by_difference(members: DataFrame, sets: DataFrame, large: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of large buckets that may be that similar, by their differences from the family."""
    rows = _families(members, sets, large)
    rows = rows.withColumn("e", F.size("d") - F.col("n") * ((1 - similarity) / (1 + similarity)))
    least = rows.groupBy("family").agg(F.min(F.struct("e", "row")).alias("m")).select("family", F.col("m.e").alias("e0"), F.col("m.row").alias("middle"))
    rows = staged(rows.join(least, "family").withColumn("need", F.greatest((F.col("e") + F.col("e0")) / 2, F.lit(1e-3))), "needs")
    # texts that need to share nothing with each other need to share nothing with the one nearest to the family
    star = rows.where("e + e0 <= 1e-6 and row <> middle").select(F.least("row", "middle").alias("a"), F.greatest("row", "middle").alias("b"))
    each = rows.select("row", "family", F.explode("d").alias("g"))
    kinds = each.groupBy("family", "g").agg(F.count("*").alias("c"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("h")).where("c > 1")
    kinds = kinds.select("family", "g", F.struct("c", F.xxhash64("family", "c", "h").alias("id")).alias("part"))
    parts = each.join(kinds, ["family", "g"]).groupBy("row", "part").agg(F.count("*").alias("w"))
    parts = parts.groupBy("row").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.array_sort(F.collect_list("w")).alias("ws"))  # as many as the difference has shingles
    held = rows.select("row", "root", "family", "need").join(parts, "row")
    slack = F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w) - F.col("need")
    missed = F.aggregate("ws", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s")), lambda a, w: F.struct((a["n"] + F.when(a["s"] + w <= F.col("slack") + 1e-6, 1).otherwise(0)).cast("long").alias("n"), (a["s"] + w).alias("s")))
    held = held.withColumn("slack", slack).where("slack >= -1e-6").withColumn("k", missed["n"].cast("int"))
    held = staged(held.withColumn("tight", (F.size("parts") - F.col("k") >= JOINT) & (F.col("k") <= MISSED)).select("row", "root", "family", "parts", "k", "tight"), "parts")
    some = held.where("tight").withColumn("ids", F.transform(F.slice("parts", 1, F.col("k") + JOINT), lambda p: p["id"]))
    for j in range(JOINT):  # every set of JOINT of them, in order
        at = F.posexplode("ids") if j == 0 else F.posexplode(F.slice("ids", F.col("at") + 2, F.size("ids")))
        some = some.select("row", "root", "ids", *(["at", "key"] if j else []), at.alias("step", "id"))
        at = F.col("step") if j == 0 else F.col("at") + 1 + F.col("step")
        some = some.select("row", "root", "ids", at.cast("int").alias("at"), (F.xxhash64("key", "id") if j else F.xxhash64("id")).alias("key"))
    other = some.select("key", F.col("row").alias("other"), F.col("root").alias("other_root"))
    joint = some.join(other, "key").where("row < other and root <> other_root").select(F.col("row").alias("a"), F.col("other").alias("b"))
    single = held.select("row", "root", "tight", F.explode(F.transform(F.slice("parts", 1, F.col("k") + 1), lambda p: p["id"])).alias("key"))
    other = single.select("key", F.col("row").alias("other"), F.col("root").alias("other_root"), F.col("tight").alias("also"))
    loose = single.where("not tight").join(other, "key").where("root <> other_root and (also or row < other)")
    return star.unionByName(joint).unionByName(loose.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"))).distinct()


def _seeking(members: DataFrame, held: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Members that seek others of their bucket by size (all but the largest component's), a row for each size, and those sought."""
    bound = (1 + similarity) / similarity
    of = lambda size: F.floor(F.log(F.greatest(size, F.lit(1.0))) / math.log(SIZE_STEP)).cast("int")
    in_bucket = members.select("row", "value").join(held, "row")
    main = members.groupBy("value", "root").agg(F.count("*").alias("k")).groupBy("value").agg(F.max(F.struct("k", "root"))["root"].alias("main"))
    least, most = F.col("n") * similarity, F.least(F.col("f") * bound - F.col("n"), F.col("n") / similarity)
    seekers = in_bucket.join(main, "value").where((F.col("root") != F.col("main")) & (most >= least - 1e-6)).drop("main")
    seekers = seekers.withColumn("size", F.explode(F.sequence(of(least - 1e-6), of(most + 1e-6))))
    other = in_bucket.select("value", of(F.col("n").cast("double")).alias("size"), F.col("row").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("m"), F.col("f").alias("h"))
    return seekers, other.where(F.col("h") * bound + 1e-6 >= F.col("m") * (1 + similarity))


def _by_size(seekers: DataFrame, other: DataFrame, similarity: float) -> DataFrame:
    """Pairs that the numbers of their common shingles leave possible."""
    may = F.least("f", "h") * ((1 + similarity) / similarity) + 1e-6 >= F.col("n") + F.col("m")
    return seekers.join(other, ["value", "size"]).where((F.col("root") != F.col("other_root")) & may)


def _dense(members: DataFrame, seekers: DataFrame, other: DataFrame, similarity: float) -> DataFrame:
    """value, head of large buckets in which common shingles would leave over DENSE pairs a member; estimated from some SEEKERS members each. Staged."""
    large = members.groupBy("value").agg(F.countDistinct("root").alias("k"), F.count("*").alias("t"), F.min("row").alias("head")).where(f"k > {LARGE}").select("value", "head", "t")
    large = staged(large, "large_buckets")
    if not large.limit(1).count():
        return large.select("value", "head")
    step = F.ceil(F.col("t") / SEEKERS)
    some = seekers.join(large.select("value", "t"), "value").where(F.pmod(F.xxhash64("row", "value"), step) == 0)
    found = _by_size(some, other, similarity).groupBy("value", "t").agg(F.count("*").alias("c"))
    return staged(large.join(found.where(F.col("c") * F.ceil(F.col("t") / SEEKERS) > DENSE * F.col("t")).select("value"), "value", "left_semi").select("value", "head"), "dense_buckets")


def _possible(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of different components that may be that similar: no other pair of a bucket is."""
    held, few = _common(members, sets)
    bound = (1 + similarity) / similarity  # common >= similarity * union says: common * bound >= n + m
    may = lambda common: common * bound + 1e-6 >= F.col("n") + F.col("m")
    apart = F.col("root") != F.col("other_root")
    few = few.join(held.select("row", "f"), "row")
    other = few.select("g", F.col("row").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("m"), F.col("f").alias("h"))
    by_few = few.join(other, "g").where(apart & (F.col("row") < F.col("other"))).groupBy("row", "other", "n", "m", "f", "h").agg(F.count("*").alias("r"))
    by_few = by_few.where(may(F.least("f", "h") + F.col("r"))).select(F.col("row").alias("a"), F.col("other").alias("b"))
    # by common shingles alone: a row seeks the sizes that its own number of them leaves possible
    seekers, other = _seeking(members, held, similarity)
    dense, by_difference = _dense(members, seekers, other, similarity), None
    if dense.limit(1).count():
        by_difference = _by_difference(members, sets, dense, similarity)
        seekers = seekers.join(dense.select("value"), "value", "left_anti")
    by_size = _by_size(seekers, other, similarity).select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b"))
    found = by_few.unionByName(by_size)
    return (found if by_difference is None else found.unionByName(by_difference)).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.8 or more (bands are made for that) of their word shingles.

    Returns doc_id, component_id (smallest doc_id of the group, its own included) for
    every row. Null texts and texts without words are alike; repeated rows stay; null ids
    form no id of a group; an empty table gives none. Other columns are not read.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    every = staged(_signatures(rows, shingle).withColumn("row", F.monotonically_increasing_id()), "signatures")
    one = staged(every.groupBy("key").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")), "distinct")
    held = staged(every.join(one.select("row"), "row", "left_semi"), "bands")
    bits_roots = connected_components(close_links(staged(held.select("fp").distinct(), "fingerprints"), 2))
    by_bits = held.join(bits_roots, held["fp"] == bits_roots["node"], "left").select("row", "n", F.xxhash64(F.lit("bits"), F.coalesce("root", "fp")).alias("value"))
    members = held.select("row", "n", F.explode("bands").alias("value")).unionByName(by_bits)
    enough = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9

    done = docs.sparkSession.createDataFrame([], "a long, b long")
    roots, sets = done.toDF("node", "root"), None
    joined = lambda roots, alike: connected_components(roots.toDF("a", "b").unionByName(alike))  # noqa: E731  a link to the root for each row, however many links there were
    for k in range(CENTRES):
        members = _apart(members, roots)
        rank = F.xxhash64("row", F.lit(k))  # the same in all buckets
        if k == 1:
            held_common, _ = _common(members, sets)
            members = staged(members.join(held_common.select("row", (-F.col("f") / F.col("n")).alias("rank")), "row"), "ranked")
        centre = members.groupBy("value").agg(F.min(F.struct((F.col("rank") if k == 1 else rank).alias("r"), rank.alias("h"), "row", "n", "root")).alias("c"))
        centre = centre.select("value", F.col("c.row").alias("other"), F.col("c.n").alias("m"), F.col("c.root").alias("other_root"))
        pairs = members.join(centre, "value").where((F.col("root") != F.col("other_root")) & enough("n", "m"))
        pairs = pairs.select(F.least("row", "other").alias("a"), F.greatest("row", "other").alias("b")).distinct()
        pairs = staged(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if sets is None:
            asked = staged(members.select("row").distinct(), "asked")
            sets = _sets(rows, staged(held.join(asked, "row", "left_semi").select("row", "doc_id", "th", "key"), "needed"), shingle)
        roots, done = staged(joined(roots, _alike(pairs, sets, similarity)), "roots"), done.unionByName(pairs)
    rest = staged(_possible(_apart(members, roots), sets, similarity), "rest")
    roots = joined(roots, _alike(rest.join(done, ["a", "b"], "left_anti"), sets, similarity))
    known = staged(one.join(roots, one["row"] == roots["node"], "left").select("key", "least", F.coalesce("root", "row").alias("root")), "roots")
    group = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return every.select("doc_id", "key").join(known.join(group, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, whose id is the smallest of a group of near copies.

    Rows that share that id all stay; rows with a null id stay if their group has no other id.
    """
    found = near_copies(docs, id_col, text_col, shingle, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return by_id(docs, id_col, found.select("doc_id").distinct(), "left_semi")
