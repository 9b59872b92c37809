"""A Merkle manifest of a table: hashes of rows, a tree for each source, a tree of the sources.

A parent is stored as its preimage, the concatenated hashes of its children. Six levels of
a tree (729 nodes of its lowest) are one row of Spark, a bundle: its preimages level by
level, and the node on top of them. The tops are the nodes of the next pass, so a table of
n rows has about log(n) / 6.6 passes, each a shuffle 729 times smaller than the last. On
the way down every bundle gets the preimages above it once; its leaves join their
ancestors' preimages there, cut their own 64 characters out of each, which leaves the
siblings, or put another hash in that place and hash again, which folds a changed row up
to the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import pick, small, staged

#: Consecutive nodes that become one parent.
RUN = 3
#: Levels of a tree in a bundle, and so the nodes of its lowest level.
LEVELS = 6
BUNDLE = RUN**LEVELS
#: Characters of a digest.
DIGEST = 64

_PATH = "array<struct<slot: int, preimage: string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(*fields: Column) -> Column:
    """SHA-256, in hex, of the fields one after the other: `-` for null, else UTF-8 byte count, `:`, value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]), 256)


def ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`rows` with i, the place among those of the same keys from 0, and n, how many they are.

    Rows are dealt by ranges of keys and order, so that one key may take many tasks; what
    tells a task's rows their places is the count of each key in each task.
    """
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = staged(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranked")
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("m").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = held.groupBy(*keys, "part").agg(F.count("*").alias("m"), F.min("at").alias("first"))
    counts = counts.select(*keys, "part", (before - F.col("first")).alias("shift"), F.sum("m").over(own).alias("n"))
    return held.join(small(staged(counts, "counts")), [*keys, "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def climb(hashes: list[str], alone: bool) -> tuple[list[list[str]], str]:
    """Preimages of a bundle's levels, the lowest first, and the node on top; a tree's only bundle ends at one node, others have all levels."""
    levels: list[list[str]] = []
    while len(hashes) > 1 or not alone and len(levels) < LEVELS:
        levels.append(["".join(hashes[k : k + RUN]) for k in range(0, len(hashes), RUN)])
        hashes = [digest(p) for p in levels[-1]]
    return levels, hashes[0]


def ancestors(levels: list[list[str]], j: int) -> list[tuple[int, str]]:
    """Of a bundle's j-th node: slot and preimage, level by level."""
    out = []
    for level in levels:
        out.append((j % RUN, level[j // RUN]))
        j //= RUN
    return out


def siblings(path: list[tuple[int, str]]) -> str:
    """Hashes of the siblings on a path: each preimage without its own slot."""
    return "".join(p[: DIGEST * s] + p[DIGEST * (s + 1) :] for s, p in path)


def fold(node: str, path: list[tuple[int, str]]) -> str:
    """The root that a path gives for a node put in its slot."""
    for s, p in path:
        node = digest(p[: DIGEST * s] + node + p[DIGEST * (s + 1) :])
    return node


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """known, source, b, n, kids: and preimages, hash."""
    more = pa.schema([("preimages", pa.list_(pa.list_(pa.string()))), ("hash", pa.string())])
    for b in batches:
        done = []
        for n, kids in zip(b.column("n").to_pylist(), b.column("kids")):
            done.append(climb(kids.values.field("hash").to_pylist(), n <= BUNDLE))
        made = _table(done, more)
        yield pa.record_batch([*b.columns, *made.columns], names=[*b.schema.names, *more.names])


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles (known, source, b, kids, preimages, subroot, path): the path of every kid."""
    schema = pa.schema([("known", pa.int32()), ("source", pa.string()), ("b", pa.int64()), ("subroot", pa.string()), ("path", pa.list_(pa.struct([("slot", pa.int32()), ("preimage", pa.string())])))])
    for batch in batches:
        for r in batch.to_pylist():
            rows = [(r["known"], r["source"], kid["i"], r["subroot"], [{"slot": s, "preimage": p} for s, p in ancestors(r["preimages"], j)] + r["path"]) for j, kid in enumerate(r["kids"])]
            yield _table(rows, schema)


def _proved(batches: Iterator[pa.RecordBatch], root: str, proofs: bool) -> Iterator[pa.RecordBatch]:
    """Bundles of leaves: the result of every leaf."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * proofs]
    schema = pa.schema([(x, pa.int64() if x == "id" else pa.bool_() if x == "verified" else pa.string()) for x in names])
    for batch in batches:
        for r in batch.to_pylist():
            above = [(p["slot"], p["preimage"]) for p in r["path"]]
            tail, rows = siblings(above), []
            for j, kid in enumerate(r["kids"]):
                own = ancestors(r["preimages"], j)
                proof, folded = siblings(own) + tail, fold(kid["changed"] or kid["hash"], own + above)
                rows.append((kid["id"], kid["hash"], r["subroot"], root, digest(proof), folded, folded == root, *[proof] * proofs))
            yield _table(rows, schema)


def _bundles(nodes: DataFrame, kid: list[str], name: str) -> DataFrame:
    """Nodes (known, source, i, n, hash, ...) as bundles; the kids of a bundle are in order."""
    b = F.floor(F.col("i") / BUNDLE).alias("b")
    held = nodes.groupBy("known", "source", b).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", *kid))).alias("kids"))
    kids = held.schema["kids"].dataType.simpleString()
    return staged(held.mapInArrow(_climbed, f"known int, source string, b long, n long, kids {kids}, preimages array<array<string>>, hash string"), name)


def _passes(nodes: DataFrame, kid: list[str]) -> list[DataFrame]:
    """Bundles of all passes, the leaves' first; a tree is done in the pass where it has one bundle."""
    out = [_bundles(nodes, kid, "bundles")]
    while out[-1].where(F.col("n") > BUNDLE).limit(1).count():
        tops = out[-1].where(F.col("n") > BUNDLE)
        tops = tops.select("known", "source", F.col("b").alias("i"), F.ceil(F.col("n") / BUNDLE).alias("n"), "hash")
        out.append(_bundles(tops, ["hash"], "bundles"))
    return out


def _paths(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """known, source, b, subroot, path of the first pass's bundles; `above` has known, source, subroot and path of each tree."""
    found = None
    for held in reversed(passes):
        alone = held.where(F.col("n") <= BUNDLE).select("known", "source", "b").join(above, ["known", "source"])
        found = alone.select("known", "source", "b", "subroot", "path") if found is None else alone.select("known", "source", "b", "subroot", "path").unionByName(found)
        if held is not passes[0]:
            both = held.join(found, ["known", "source", "b"]).select("known", "source", "kids", "preimages", "subroot", "path")
            found = staged(both.mapInArrow(_descended, f"known int, source string, b long, subroot string, path {_PATH}"), "paths")
    return found


def manifest(leaves: DataFrame, proofs: bool = False) -> DataFrame:
    """The tree of leaves (id, source, hash, changed): id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a source ascend by id, null first, then by hash; every RUN consecutive nodes
    become one, the last run may be shorter. The sources' roots, null first and then by
    bytes, make a tree likewise. proof_sha256 is the digest of the siblings from the leaf
    to the root; `proofs` adds them as proof. folded_root comes from `changed`, or the
    leaf where that is null, and the siblings; verified says whether it is the root.
    Rows that are alike are leaves each; an empty table gives no rows.
    """
    spark = leaves.sparkSession
    known = leaves.select("id", F.when(F.col("source").isNull(), 0).otherwise(1).alias("known"), F.coalesce("source", F.lit("")).alias("source"), "hash", "changed")
    known = staged(known.withColumn("row", F.monotonically_increasing_id()), "leaves")  # the last tie: rows that are alike may be many
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("row")]
    documents = _passes(ranked(known, ["known", "source"], order), ["id", "hash", "changed"])
    subroots = [p.where(F.col("n") <= BUNDLE).select(F.col("known").alias("k"), F.col("source").alias("s"), "hash") for p in documents]
    for more in subroots[1:]:
        subroots[0] = subroots[0].unionByName(more)
    one = subroots[0].select(F.lit(0).alias("known"), F.lit("").alias("source"), "k", "s", "hash")
    sources = _passes(ranked(one, ["known", "source"], [F.col("k"), F.col("s")]), ["hash", "k", "s"])
    top = sources[-1].first()
    root = top["hash"] if top else ""
    none = spark.range(1).select(F.lit(0).alias("known"), F.lit("").alias("source"), F.lit("").alias("subroot"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    kids = sources[0].join(_paths(sources, none), ["known", "source", "b"]).select("kids", "preimages", "path")
    above = staged(kids.mapInArrow(_source_paths, f"known int, source string, subroot string, path {_PATH}"), "source_paths")
    held = documents[0].join(_paths(documents, above), ["known", "source", "b"]).select("kids", "preimages", "subroot", "path")
    kinds = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * proofs
    return held.mapInArrow(lambda b: _proved(b, root, proofs), kinds)


def _source_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles of sources: known, source, subroot and the path from its subroot to the root, for each source."""
    schema = pa.schema([("known", pa.int32()), ("source", pa.string()), ("subroot", pa.string()), ("path", pa.list_(pa.struct([("slot", pa.int32()), ("preimage", pa.string())])))])
    for batch in batches:
        for r in batch.to_pylist():
            yield _table([(kid["k"], kid["s"], kid["hash"], [{"slot": s, "preimage": p} for s, p in ancestors(r["preimages"], j)] + r["path"]) for j, kid in enumerate(r["kids"])], schema)


def document_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tampered: Column | None = None, proofs: bool = False) -> DataFrame:
    """The manifest of a table, each row a leaf of the named fields; see manifest(). Returns doc_id in place of id.

    `tampered`, a condition on doc_id, names rows whose text loses its line feeds after
    the manifest was made: their fold starts from the changed row. Null fields, empty
    texts, null sources and ids are fields like others (a null id is never tampered with);
    other columns, with any names, are not read.
    """
    names = {f"f{k}": f for k, f in enumerate(fields)}
    rows = pick(docs, doc_id=id_col, source=source_col, text=text_col, **names)
    whole = [F.col(k).cast("string") for k in names]
    less = [F.replace(c, F.lit("\n"), F.lit("")) if f == text_col else c for c, f in zip(whole, fields)]
    hit = (tampered if tampered is not None else F.lit(False)) & F.col("text").contains("\n")
    changed = F.when(hit, leaf_hash(*less))
    leaves = rows.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), leaf_hash(*whole).alias("hash"), changed.alias("changed"))
    return manifest(leaves, proofs).withColumnRenamed("id", "doc_id")
