"""SimHash near-duplicates: fingerprints, a binary trie self-join and components.

Fingerprints within a few bits of each other agree on at least one of `budget + 1`
blocks of bits, so there is one trie per block, with that block's bits first: there
the two sides of a pair share one node and the error budget is untouched. Below, node
pairs are walked together; differing bits add up, and a pair over the budget is
pruned. Nodes too large for a task are split into pairs of deeper nodes by Spark joins
before any of their fingerprints move; the rest of the walk runs inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import by_id, pick, small, staged
from lectern.llm.components import connected_components

#: Bits by which a node that is too large is split.
STRIDE = 6
#: Fingerprints of a node, or a pair of nodes, that one task takes at once.
NODE_ROWS = 2048


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
    ends = ends[shingle - 1 :].tolist()
    counts, digest, total = np.zeros(64, np.int64), xxhash.xxh64_intdigest, len(starts)
    for at in range(0, total, 65536):
        h = np.array([digest(line[s:e], 42) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536])], ">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row, whole texts; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """First bit and width of each of the budget + 1 blocks."""
    cuts = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _rotated(fp: str, by: int) -> Column:
    return F.col(fp) if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _prefix(depth: Column | int) -> Column:
    """The first `depth` bits of the key; depth is 1 to 64."""
    return F.expr(f"shiftrightunsigned(key, {64 - depth})")


def close_links(fps: DataFrame, budget: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links between distinct fingerprints (column fp, staged) that differ in 1 to `budget` bits.

    Returns a, b: not all pairs, but a spanning forest of the links inside each node
    pair, so that components stay whole and a dense group costs as many rows as it has
    members.
    """
    keys, parts = None, []
    for r, (first, width) in enumerate(blocks(budget)):
        one = fps.select(F.lit(r).alias("r"), _rotated("fp", first).alias("key")).withColumn("node", _prefix(width))
        keys = one if keys is None else keys.unionByName(one)
    counts = keys.groupBy("r", "node").count().where("count > 1")
    counts = staged(counts, "nodes")
    large = counts.where(F.col("count") > node_rows).select("r", "node")
    whole = counts.where(F.col("count") <= node_rows).select("r", "node")
    top = keys.join(whole, ["r", "node"], "left_semi")
    parts.append(top.select("r", F.lit(0).alias("depth"), F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("diff"), "key"))
    for r, (_, width) in enumerate(blocks(budget)):
        parts += _split(keys.where(F.col("r") == r).drop("node"), large.where(F.col("r") == r).select("node"), r, width, budget, node_rows)
    units = parts[0]
    for part in parts[1:]:
        units = units.unionByName(part)
    shifts = [first for first, _ in blocks(budget)]
    by = ["r", "depth", "a", "b"]
    dealt = units.repartition(*by).sortWithinPartitions(*by, "key")
    return dealt.mapInArrow(lambda batches: _walk_units(batches, budget, shifts), "a long, b long")


def _split(keys: DataFrame, nodes: DataFrame, r: int, depth: int, budget: int, node_rows: int) -> list[DataFrame]:
    """Node pairs under nodes that are too large, split level by level until each fits; with their keys."""
    pairs = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("diff"))
    out: list[DataFrame] = []
    while pairs.limit(1).count():
        deeper = min(64, depth + STRIDE)
        held = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        under = keys.withColumn("node", _prefix(depth)).join(small(held), "node", "left_semi")
        child = staged(under.groupBy("node", _prefix(deeper).alias("child")).count(), "children")
        left = child.select(F.col("node").alias("a"), F.col("child").alias("ca"), F.col("count").alias("na"))
        right = child.select(F.col("node").alias("b"), F.col("child").alias("cb"), F.col("count").alias("nb"))
        grown = pairs.join(left, "a").join(right, "b").where("a <> b or ca <= cb")
        grown = grown.withColumn("diff", F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))).where(F.col("diff") <= budget)
        size = F.when(F.col("ca") == F.col("cb"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        grown = staged(grown.select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("diff").cast("int").alias("diff"), size.alias("size")), "pairs").where("size > 1")
        done, pairs = grown.where((F.col("size") <= node_rows) | F.lit(deeper == 64)), grown.where((F.col("size") > node_rows) & F.lit(deeper < 64))
        depth = deeper
        at = keys.withColumn("node", _prefix(depth))
        ends = [at.join(done.withColumn("node", F.col("a")), "node"), at.join(done.where("a <> b").withColumn("node", F.col("b")), "node")]
        out += [x.select(F.lit(r).alias("r"), F.lit(depth).alias("depth"), "a", "b", "diff", "key") for x in ends]
        pairs = pairs.select("a", "b", "diff")
    return out


def _walk_units(batches: Iterator[pa.RecordBatch], budget: int, shifts: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; a unit may span batches, and holds a bounded number of rows."""
    rest = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        cut = _unit_starts(rows)
        rest = [x[cut[-1] :] for x in rows]
        yield _links([x[: cut[-1]] for x in rows], cut[:-1], budget, shifts)
    if rest is not None:
        yield _links(rest, _unit_starts(rest), budget, shifts)


def _unit_starts(rows: list[np.ndarray]) -> np.ndarray:
    if not len(rows[0]):
        return np.zeros(1, np.int64)
    new = np.any([x[1:] != x[:-1] for x in rows[:4]], axis=0)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _links(rows: list[np.ndarray], starts: np.ndarray, budget: int, shifts: list[int]) -> pa.RecordBatch:
    r, depth, a, b, diff, key = rows
    left, right = [], []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
        if e <= s:
            continue
        keys = np.sort(key[s:e].view(np.uint64))
        if a[s] == b[s]:
            found = walk(keys, keys, budget)
        else:
            head = keys >> np.uint64(64 - int(depth[s]))
            found = walk(keys[head == np.uint64(a[s])], keys[head == np.uint64(b[s])], budget)
        by = np.uint64(shifts[int(r[s])])
        for x, y in forest(found):
            left.append(x >> by | x << np.uint64(64) - by if by else x)
            right.append(y >> by | y << np.uint64(64) - by if by else y)
    return pa.record_batch([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right)], names=["a", "b"])


def walk(left: np.ndarray, right: np.ndarray, budget: int, brute: int = 4096) -> list[tuple[np.ndarray, np.ndarray]]:
    """Trie self-join of sorted keys: pairs differing in 1 to `budget` bits, as arrays of both sides.

    The arrays are the tries: a node is a range of keys with one prefix. Pairs of nodes
    split at the first bit below either prefix; bits that differ are counted, and pairs
    over the budget are dropped. Pairs with few keys are compared outright.
    """
    same, out = left is right, []
    stack = [(0, len(left), 0, len(right), 0, 0)]
    while stack:
        a0, a1, b0, b1, depth, diff = stack.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= brute or depth == 64:
            x, y = left[a0:a1], right[b0:b1]
            bits = np.bitwise_count(x[:, None] ^ y[None, :])
            i, j = np.nonzero((bits <= budget) & (bits > 0))
            if same and a0 == b0:
                i, j = i[i < j], j[i < j]
            if len(i):
                out.append((x[i], y[j]))
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        am, bm = _half(left, a0, a1, bit), _half(right, b0, b1, bit)
        stack.append((a0, am, b0, bm, depth + 1, diff))
        stack.append((am, a1, bm, b1, depth + 1, diff))
        if diff < budget:
            stack.append((a0, am, bm, b1, depth + 1, diff + 1))
            if not (same and a0 == b0 and a1 == b1):
                stack.append((am, a1, b0, bm, depth + 1, diff + 1))
    return out


def _half(keys: np.ndarray, lo: int, hi: int, bit: np.uint64) -> int:
    """Where the keys with that bit begin in a range with one prefix above it."""
    above = keys[lo] & ~(bit | (bit - np.uint64(1)))
    return lo + int(np.searchsorted(keys[lo:hi], above | bit))


def forest(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.uint64, np.uint64]]:
    """A star for each component of the pairs: its least key with every other."""
    if not found:
        return []
    x, y = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j, root = at[: len(x)], at[len(x) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == was).all() and (root[i] == root[j]).all():
            return [(nodes[k], nodes[m]) for m, k in enumerate(root.tolist()) if k != m]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 2) -> DataFrame:
    """Groups of documents whose fingerprints are linked at `budget` or fewer bits.

    Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the
    group, its own included) for every row. Null or empty texts have fingerprint zero
    and are linked like any other; repeated rows stay; null ids form no id of a group;
    an empty table gives none. Other columns are not read.
    """
    fp = staged(simhash(docs, id_col, text_col, shingle), "fingerprints")
    one = staged(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(close_links(one.select("fp"), budget))
    known = staged(one.join(roots, one["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    group = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(group, "root").select(F.col("fp").alias("f"), "component_id")
    return fp.join(named, fp["fp"] == named["f"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 2) -> DataFrame:
    """The rows of `docs`, all columns, whose id is the smallest of a group of near-duplicates.

    Rows that share that id all stay; rows with a null id stay if their group has no other id.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, budget).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return by_id(docs, id_col, found.select("doc_id").distinct(), "left_semi")
