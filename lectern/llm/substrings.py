"""Repeated passages: token k-mers as edges of a De Bruijn graph, compacted into unbranched paths.

An edge is a window of `window` words. Every word sequence of that length has a least
short k-mer (by hash), the same one wherever it stands, so only windows matter whose
least k-mer is the least of some other window too. Successive edges of a document with
one least k-mer form a path and are one row from the start, which carries a 128-bit digest
of all its words; joins on the digest find its occurrences, whose words are thereby the
same. A path has one way in if all its occurrences follow the same path, and that one has
one way out if it occurs no more often: such paths are linked, and links are followed into
chains, the unbranched paths of the graph. Only a chain's head is then joined with its
occurrences: all but the first are repeats of the whole chain, from the source coordinates
of the first. Chains that follow each other in both documents are put together into long
spans. Where a k-mer has several paths, the windows of each path's first occurrence are
compared one by one besides.

An occurrence is where a document first has an edge; what it has again is a repeat
without any join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.bloom import filled, sized
from lectern.llm.common import pick, portions, small, staged
from lectern.llm.vocabulary import Vocabulary

#: Words of a sampled k-mer.
SEED_WORDS = 8
#: Exact copies are left out by a broadcast of their ids up to so many, else by a join.
COPIES_ROWS = 1_000_000
#: Parts that the copies of a text are dealt to in that join.
SALTS = 32
#: Repeated k-mers go to the tasks as a Bloom filter up to so many (under a byte each), else by a join; its false positives.
FILTER_KEYS = 64_000_000
FILTER_RATE = 0.03
#: Most texts that an Arrow batch brings to Python.
BATCH_ROWS = 500
#: Stands for a null id.
_NULL = -(2**63)
_MASK = (1 << 64) - 1


def _weights(n: int, seed: int) -> list[np.uint64]:
    """n odd multipliers, by a linear congruential rule."""
    out = []
    for _ in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407) & _MASK
        out.append(np.uint64((seed ^ seed >> 29) | 1))
    return out


def _rolled(h: np.ndarray, weights: list[np.uint64]) -> np.ndarray:
    """A hash of every run of len(weights) hashes, finished so that all bits count."""
    n = len(h) - len(weights) + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j, w in enumerate(weights if n > 0 else []):
        out += h[j : j + n] * w
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(29)


def _slid(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over every run of n values, by doubling."""
    size = 1
    while size * 2 <= n:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


class _Hasher:
    """Hashes of words, windows and sampled k-mers."""

    def __init__(self, window: int) -> None:
        self.window, self.seed = window, min(SEED_WORDS, window)
        self.known = Vocabulary(lambda w: (xxhash.xxh64_intdigest(w, 7),), [np.uint64])
        self.first, self.short = _weights(window, 1), _weights(self.seed, 3)

    def words(self, words: list[bytes]) -> np.ndarray:
        self.known.begin()
        rows = self.known.rows(words)
        return self.known.columns[0][rows]

    def sampled(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the k-mers that are the least in some window."""
        m = _rolled(h, self.short)
        span = self.window - self.seed + 1
        if len(m) < span:
            return np.zeros(0, np.int64), m[:0]
        least = _slid(m, span, np.minimum)
        pad = np.zeros(span - 1, np.uint64)
        at = np.flatnonzero(_slid(np.concatenate([pad, least, pad]), span, np.maximum) == m)
        return at, m[at]

    def least(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every window its least k-mer's hash, and its own hash."""
        return _slid(_rolled(h, self.short), self.window - self.seed + 1, np.minimum), _rolled(h, self.first)


def split_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than the space and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _repeated(ids: pa.Array, sizes: list[int]) -> pa.Array:
    return ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))


def _sample(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Sampled k-mers of each document, once each; `more` if the document holds it twice."""
    make = _Hasher(window)
    for batch in portions(batches):
        found, none = [], (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for t in batch.column(1):
            words = split_words(t.as_py())
            found.append(np.unique(make.sampled(make.words(words))[1], return_counts=True) if len(words) >= window else none)
        if found:
            yield pa.record_batch([_signed(np.concatenate([m for m, _ in found])), _repeated(batch.column(0), [len(m) for m, _ in found]), pa.array(np.concatenate([c for _, c in found]) > 1)], names=["m", "at", "more"])


def _runs(batches: Iterator[pa.RecordBatch], window: int, may_repeat) -> Iterator[pa.RecordBatch]:
    """Paths of each document: runs of windows with one least k-mer, and what repeats inside the document.

    Only windows whose least k-mer may repeat count, where the document first has them. A
    path has its k-mer m, a digest of its words (d0, d1), its number of windows and their
    hashes, and stop 0. A run of windows that the document had before is one row from pos to stop.
    """
    make = _Hasher(window)
    for batch in portions(batches):
        sizes, parts = [], []
        for row in range(batch.num_rows):
            words = split_words(batch.column(1)[row].as_py())
            sizes.append(0)
            if len(words) < window:
                continue
            m, h = make.least(make.words(words))
            pos = np.flatnonzero(may_repeat(m, batch, row))
            if not len(pos):
                continue
            first = np.zeros(len(pos), bool)
            first[np.unique(h[pos], return_index=True)[1]] = True
            again, pos = pos[~first], pos[first]
            head = again[np.flatnonzero(np.diff(again, prepend=-2) != 1)]
            tail = again[np.flatnonzero(np.diff(again, append=len(m) + 2) != 1)]
            new = np.concatenate([[True], (np.diff(pos) != 1) | (m[pos[1:]] != m[pos[:-1]])])
            group = np.cumsum(new) - 1  # runs are cut so that their first and last window have all their words
            step = np.arange(len(pos)) - np.flatnonzero(new)[group]
            start = np.flatnonzero(step % (window - make.seed + 1) == 0)
            size = np.diff(np.append(start, len(pos)))
            digest = b"".join(xxhash.xxh3_128_digest(b" ".join(words[p : p + n])) for p, n in zip(pos[start].tolist(), (size + (window - 1)).tolist()))
            parts.append((m[pos[start]], pos[start], size, h[pos], head, tail + window, *np.frombuffer(digest, np.int64).reshape(-1, 2).T))
            sizes[-1] = len(start) + len(head)
        if not parts:
            continue
        none = np.zeros(0, np.int64)
        ones = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.concatenate([x for p in parts for x in (p[2], np.zeros(len(p[4]), np.int64))]))]).astype(np.int32)),
            _signed(np.concatenate([p[3] for p in parts])),
        )
        both = lambda k, j: np.concatenate([x for p in parts for x in (p[k], p[j] if j else np.zeros(len(p[4]), p[k].dtype))] or [none])
        stop = np.concatenate([x for p in parts for x in (np.zeros(len(p[1]), np.int64), p[5])])
        digests = [pa.array(both(k, None)) for k in (6, 7)]
        ints = [pa.array(x.astype(np.int32)) for x in (both(1, 4), stop, both(2, None))]
        yield pa.record_batch([_signed(both(0, None)), *digests, _repeated(batch.column(0), sizes), *ints, ones], names=["m", "d0", "d1", "at", "pos", "stop", "length", "ones"])


def _removed(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, BATCH_ROWS):
        ids, rows = batch.column(0), []
        for t, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            words = split_words(t.as_py())
            n = len(words)
            gone = np.zeros(n, bool)
            if spans and n >= window:
                change = np.zeros(n + 1, np.int64)
                for s in spans:
                    change[s["start"]] += 1
                    change[min(n, s["stop"])] -= 1
                gone = np.cumsum(change)[:-1] > 0
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept = b" ".join(words)
            ends = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            rows.append((n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), *((kept.decode("utf-8", "surrogatepass"), ends.astype(np.int64)) if texts else ())))
        kinds = (pa.int64(), pa.int64(), pa.string(), *[pa.string(), pa.list_(pa.int64())] * texts)
        yield pa.record_batch([ids, *(pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds))], names=["at", "n_words", "n_removed", "kept_sha256", *["kept", "spans"] * texts])


def copies_of(docs: DataFrame, rows: int = COPIES_ROWS) -> DataFrame:
    """at of each document whose text a smaller at has too, and the least such (least).

    Texts that repeat are broadcast if they are at most `rows`; else they are joined with
    each text's documents dealt over SALTS keys, for one text may have very many.
    """
    keyed = docs.select("at", F.unhex(F.md5(F.col("text").cast("binary"))).alias("k")).where("k is not null")
    least = keyed.groupBy("k").agg(F.min("at").alias("least"), F.count("*").alias("n")).where("n > 1").select("k", "least")
    least = staged(least, "repeated_texts")
    if least.limit(rows + 1).count() <= rows:
        found = keyed.join(F.broadcast(least), "k")
    else:
        found = keyed.withColumn("s", F.pmod(F.xxhash64("at"), F.lit(SALTS))).join(least.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["k", "s"])
    return found.where("at <> least").select("at", "least")


def repeated_runs(docs: DataFrame, seeds: DataFrame, window: int, kind: str, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """The rows of _runs() of documents (at, text) with sampled k-mers (m, at, more).

    The k-mers that repeat go to the tasks as a Bloom filter, up to `filter_keys` of them;
    it lets a few others pass, which costs time alone. Beyond, each document is joined
    with its own repeated k-mers.
    """
    often = seeds.groupBy("m").agg(F.count("*").alias("n"), F.max("more").alias("more")).where("n > 1 or more").select("m")
    often = staged(often, "repeated", BATCH_ROWS)
    schema = f"m long, d0 long, d1 long, at {kind}, pos int, stop int, length int, ones array<long>"
    n = often.count()
    if n <= filter_keys:
        keys = _bloom_keys(often)
        held = docs.sparkSession.sparkContext.broadcast(filled(sized(0, max(n, 1), 1, FILTER_RATE), keys, 1))

        def passes(m: np.ndarray, batch: pa.RecordBatch, row: int) -> np.ndarray:
            one, back = np.unique(m, return_inverse=True)
            return held.value.passes(one.view(np.int64), second_hash(one), np.zeros(len(one), np.int64))[back]

        return docs.select("at", "text").mapInArrow(lambda b: _runs(b, window, passes), schema)

    def listed(m: np.ndarray, batch: pa.RecordBatch, row: int) -> np.ndarray:
        return np.isin(m, batch.column(2)[row].values.to_numpy(zero_copy_only=False).view(np.uint64))

    own = seeds.select("m", "at").join(often, "m", "left_semi").groupBy("at").agg(F.collect_list("m").alias("ms"))
    return docs.join(own, "at").select("at", "text", "ms").mapInArrow(lambda b: _runs(b, window, listed), schema)


def _bloom_keys(often: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([b.column(0), pa.array(second_hash(m.view(np.uint64))), pa.array(np.zeros(len(m), np.int64))], names=["one", "two", "shard"])

    return often.mapInArrow(run, "one long, two long, shard long")


def second_hash(x: np.ndarray) -> np.ndarray:
    """Second hash of k-mers, by a multiplicative rule."""
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ x >> np.uint64(29)).view(np.int64)


def repeated_spans(docs: DataFrame, window: int = 20, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """Spans that repeat an earlier span of at least `window` words: at, start, stop (words, half open; stop may be beyond the end), and where the words stand first: source (an at), source_start; null for a document's repeats of itself.

    Expects at (unique) and text; earlier means a smaller at, or the same and an earlier
    start. Of documents with one text only the first takes part; the others repeat it whole.
    """
    kind = docs.schema["at"].dataType.simpleString()
    copies = staged(copies_of(docs), "copies")
    first_texts = docs.join(small(copies.select("at"), COPIES_ROWS), "at", "left_anti").select("at", "text")
    seeds = first_texts.mapInArrow(lambda b: _sample(b, window), f"m long, at {kind}, more boolean")
    runs = staged(repeated_runs(first_texts, seeds, window, kind, filter_keys), "runs", BATCH_ROWS)
    # a path is known by its k-mer and the digest of its words
    path = ["m", "d0", "d1"]
    found = runs.where("stop = 0")
    paths = found.groupBy(*path).agg(F.count("*").alias("n"), F.max("length").alias("length"), F.min(F.struct("at", "pos")).alias("first"))
    paths = staged(paths, "paths")
    whole = compacted(repeated_chains(found, paths), window)
    # where paths branch at a k-mer, their windows are compared one by one, each path's first occurrence alone
    forks = small(staged(paths.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m"), "forks"), COPIES_ROWS)
    firsts = found.join(forks, "m", "left_semi").groupBy(*path).agg(F.min(F.struct("at", "pos", "ones")).alias("first"))
    steps = firsts.select("m", "first.at", "first.pos", F.posexplode("first.ones").alias("step", "one"))
    steps = staged(steps.select("m", "one", "at", (F.col("pos") + F.col("step")).alias("pos")), "steps")
    earliest = steps.groupBy("m", "one").agg(F.count("*").alias("n"), F.min(F.struct("at", "pos")).alias("f")).where("n > 1").drop("n")
    part = steps.join(earliest, ["m", "one"]).where(F.struct("at", "pos") != F.col("f")).select("at", F.col("pos").alias("start"), (F.col("pos") + window).alias("stop"), F.col("f.at").alias("source"), F.col("f.pos").alias("source_start"))
    inside = runs.where("stop > 0").select("at", F.col("pos").alias("start"), "stop", F.lit(None).cast(kind).alias("source"), F.lit(None).cast("int").alias("source_start"))
    same = copies.select("at", F.lit(0).alias("start"), F.lit(2**31 - 1).alias("stop"), F.col("least").alias("source"), F.lit(0).alias("source_start"))
    return whole.unionByName(part).unionByName(inside).unionByName(same)


def repeated_chains(found: DataFrame, paths: DataFrame) -> DataFrame:
    """Repeats of chains of paths: at, pos, length in windows, source, source_pos (the chain's first occurrence).

    Expects the occurrences of paths (d0, d1, at, pos), of which a document has each once,
    and the paths (d0, d1, n, length, first).
    """
    key = ["d0", "d1"]
    often = paths.where("n > 1")
    order = Window.partitionBy("at").orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    held = found.select(*key, "at", "pos").join(often.select(*key, "n", "length"), key)
    # a path as frequent as the one that all its occurrences follow is the only way on from there
    follows = (before(F.col("pos") + F.col("length")) == F.col("pos")) & (before(F.col("n")) == F.col("n"))
    held = staged(held.select(*key, "at", "pos", "n", F.when(follows, before(F.col("d0"))).alias("back")), "occurrences")
    ways = held.where("back is not null").groupBy(*key).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.min("back").alias("low"), F.max("back").alias("high"))
    linked = ways.where("k = n and low = high").select(*key, F.lit(True).alias("linked"))
    # linked paths have their first occurrences in one document, one after the other
    nodes = often.join(linked, key, "left").select(*key, "length", "first.at", "first.pos", F.when(F.col("linked"), 0).otherwise(1).alias("opens"))
    nodes = nodes.withColumn("chain", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chains = nodes.groupBy("at", "chain").agg(F.min(F.struct("pos", *key)).alias("head"), F.sum("length").cast("int").alias("length"))
    chains = chains.select("head.d0", "head.d1", "length", F.col("at").alias("source"), F.col("head.pos").alias("source_pos"))
    return held.select(*key, "at", "pos").join(chains, key).where(F.struct("at", "pos") != F.struct("source", "source_pos")).drop(*key)


def compacted(paths: DataFrame, window: int) -> DataFrame:
    """Spans of chains (at, pos, length in windows, source, source_pos) that follow each other in both documents: at, start, stop, source, source_start."""
    order = Window.partitionBy("at", "source", "shift").orderBy("pos")
    follows = F.lag(F.col("pos") + F.col("length")).over(order).eqNullSafe(F.col("pos"))
    held = paths.withColumn("shift", F.col("source_pos") - F.col("pos")).withColumn("opens", F.when(follows, 0).otherwise(1))
    held = held.withColumn("g", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = held.groupBy("at", "source", "shift", "g").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("length") + (window - 1)).alias("stop"), F.min("source_pos").alias("source_start"))
    return spans.select("at", "start", "stop", "source", "source_start")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, texts: bool = True) -> DataFrame:
    """Every document without the words of passages that start earlier in the table.

    A word goes if a window of `window` consecutive words covers it whose words also
    start earlier (smaller doc_id, or same document and earlier start); windows are
    judged on the input. Returns doc_id, n_words, n_removed, kept_sha256, and with `texts`
    kept (the kept words joined by spaces) and spans (starts and ends of removed runs, in words).

    Null and empty texts have no words. A null id comes before all others. Rows of one id
    with other texts are documents in the order of a hash of the text; rows with the same
    id and text are one document, and each of them is returned with its result. An empty
    table gives no rows; other columns are not read. Without `texts` the rows are written
    and read again, so that no large batches of texts go to Python at the end either.
    """
    rows = pick(docs, at=id_col, text=text_col).select(F.coalesce(F.col("at").cast("long"), F.lit(_NULL)).alias("at"), "text")
    unclear = rows.groupBy("at").count().where(F.col("count") > 1).limit(1).count()
    doc_id = F.col("at")
    if unclear:
        rows = rows.select(F.struct("at", F.xxhash64("text").alias("th")).alias("at"), "text")
        doc_id = F.col("at.at")
    spans = repeated_spans(rows.dropDuplicates(["at"]) if unclear else rows, window)
    spans = spans.groupBy("at").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    held = rows.join(spans, "at", "left").select("at", "text", "spans")
    names = ["n_words", "n_removed", "kept_sha256", *["kept", "spans"] * texts]
    kinds = f"at {rows.schema['at'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<long>" * texts
    done = held.mapInArrow(lambda b: _removed(b, window, texts), kinds)
    if not texts:
        done = staged(done, "removed", BATCH_ROWS)
    return done.select(F.when(doc_id != _NULL, doc_id).alias("doc_id"), *names)
