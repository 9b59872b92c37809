"""Repeated byte strings by merging the Burrows-Wheeler transforms of shards.

Suffixes are sampled: of the grams of any `sample` successive places the least (by hash,
the leftmost of equals) is taken, so that every string of `length` bytes has a first
taken place, at the same distance from its start wherever the string stands. From a taken
place on, a suffix is a row of ten symbols of length / 10 bytes each, and what precedes
it, back to the first start whose taken place it is, is its symbol in the transform.

A shard is a bounded part of a task's documents. It sorts its suffixes once and
run-length encodes its transform. Runs of all shards are then interleaved symbol by
symbol: a round splits every interval of the merged order by the next symbol, with counts
that are combined before they are shuffled, and a run that is alone in its interval
retires; the depth at which it does is its common prefix with the rest. No suffix is
sorted again. An interval that ends with two suffixes or more, alike in what precedes
them too, is repeated. For those that retire on the way the common prefix says which
starts can still be repeated, and the strings of those alone are compared by their
digests. Suffixes whose first symbols stand once in the table take no part at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.bloom import filled, sized
from lectern.llm.common import pick, portions, released, small, staged
from lectern.llm.substrings import COPIES_ROWS, FILTER_KEYS, FILTER_RATE, SALTS, second_hash

#: Symbols of a suffix.
SYMBOLS = 10
#: Documents of a shard.
SHARD_ROWS = 500
#: Lists of places go to the tasks of the texts by broadcast up to so many entries (some 30 MB), else texts and lists are joined.
LISTED = 1_500_000
#: Stands for a null id.
_NULL = -(2**63)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)


class Sampler:
    """Taken places of texts and hashes of their bytes, for strings of `length` bytes."""

    def __init__(self, length: int) -> None:
        self.length, self.gram = length, max(1, min(16, length // 8))
        self.sample = max(1, min(length - self.gram + 1, length * 8 // 25))
        self.ends = np.array([length * j // SYMBOLS for j in range(SYMBOLS + 1)])
        #: Symbols that all starts of a taken place have in full.
        self.sure = int(np.searchsorted(self.ends, length - self.sample + 1, side="right")) - 1
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def sums(self, raw: bytes) -> np.ndarray:
        """Sums of bytes times powers up to each place: the hash of a part is their difference, moved to power 0."""
        n = len(raw)
        if len(self.powers) <= n:
            size = max(1 << 16, n + n // 8)
            one = np.ones(1, np.uint64)
            self.powers = np.cumprod(np.concatenate([one, np.full(size, _BASE)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([one, np.full(size, _INVERSE)]), dtype=np.uint64)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(7)) * self.powers[:n], out=out[1:])
        return out

    def part(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (sums[stop] - sums[start]) * self.inverse[start]
        return (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)

    def owners(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Taken places, with the first and last start whose first taken place they are."""
        n = len(sums) - 1
        h = (sums[self.gram :] - sums[: n - self.gram + 1]) * self.inverse[: n - self.gram + 1]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        h = h & ~_LOW | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost is the least
        size = 1
        while size * 2 <= self.sample:
            h, size = np.minimum(h[:-size], h[size:]), size * 2
        if size < self.sample:
            h = np.minimum(h[: len(h) - (self.sample - size)], h[self.sample - size :])
        at = (h[: n - self.length + 1] & _LOW).astype(np.int64)
        lo = np.flatnonzero(np.diff(at, prepend=-1))
        return at[lo], lo, np.append(lo[1:], len(at)) - 1

    def keys(self, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the sure symbols of each taken place."""
        return self.part(sums, at, at + self.ends[self.sure])


@lru_cache(maxsize=2)
def sampler(length: int) -> Sampler:
    return Sampler(length)


def raw_text(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _first_symbols(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Keys of each document's taken places, once each; `more` if the document has one twice."""
    s = sampler(length)
    for batch in portions(batches, SHARD_ROWS):
        found = []
        for t in batch.column(0):
            raw = raw_text(t.as_py())
            if len(raw) >= length:
                sums = s.sums(raw)
                found.append(np.unique(s.keys(sums, s.owners(sums)[0]), return_counts=True))
        if found:
            yield pa.record_batch([pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), pa.array(np.concatenate([c for _, c in found]) > 1)], names=["m", "more"])


def transform(symbols: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffixes in order, by symbols and then by what they and their left side are, and where its runs begin."""
    order = np.lexsort((digests[:, 1], digests[:, 0], *symbols.T[::-1]))
    held = np.concatenate([symbols[order].view(np.int64), digests[order]], axis=1)
    return order, np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]).any(axis=1)])) if len(held) else np.zeros(0, np.int64)


_RUNS = "run long, m long, symbols array<long>, w0 long, w1 long, n long, places array<struct<at: {0}, lo: int, hi: int, p: int>>"


def _shards(batches: Iterator[pa.RecordBatch], length: int, passes) -> Iterator[pa.RecordBatch]:
    """Runs of each shard's transform: key (of the sure symbols), the other symbols, digest of all bytes of its starts (w0, w1), how many suffixes, and where they are."""
    s, number = sampler(length), TaskContext.get().partitionId() << 32
    for batch in portions(batches, SHARD_ROWS):
        keys, symbols, places, rows, digests = [], [], [], [], []
        for row in range(batch.num_rows):
            raw = raw_text(batch.column(1)[row].as_py())
            if len(raw) < length:
                continue
            sums = s.sums(raw)
            at, lo, hi = s.owners(sums)
            m = s.keys(sums, at)
            live = np.flatnonzero(passes(m, batch, row))
            if not len(live):
                continue
            at, lo, hi, m = at[live], lo[live], hi[live], m[live]
            edge = np.minimum(at[:, None] + s.ends[None, :], len(raw))
            symbol = s.part(sums, edge[:, s.sure : -1].ravel(), edge[:, s.sure + 1 :].ravel()).reshape(len(at), -1)
            symbols.append(np.concatenate([m[:, None], symbol + (edge[:, s.sure + 1 :] - edge[:, s.sure : -1]).astype(np.uint64)], axis=1))
            digests.append(b"".join(xxhash.xxh3_128_digest(raw[a : b + length] + (p - a).to_bytes(4, "little")) for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist())))
            keys.append(m), places.append((lo, hi, at)), rows.append(np.full(len(at), row))
        if not keys:
            continue
        m, lo, hi, at, row = (np.concatenate(x) for x in (keys, *zip(*places), rows))
        digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        symbol = np.concatenate(symbols)
        order, begins = transform(symbol, digest)
        first = order[begins]
        ends = np.append(begins, len(order)).astype(np.int32)
        inner = pa.StructArray.from_arrays([batch.column(0).take(pa.array(row[order])), *(pa.array(x[order].astype(np.int32)) for x in (lo, hi, at))], ["at", "lo", "hi", "p"])
        rest = np.ascontiguousarray(symbol[first, 1:])
        listed = pa.ListArray.from_arrays(pa.array((np.arange(len(first) + 1) * rest.shape[1]).astype(np.int32)), pa.array(rest.ravel().view(np.int64)))
        yield pa.record_batch(
            [pa.array(number + np.arange(len(first))), pa.array(m[first].view(np.int64)), listed, *(pa.array(np.ascontiguousarray(digest[first, k])) for k in (0, 1)), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), inner)],
            names=["run", "m", "symbols", "w0", "w1", "n", "places"],
        )
        number += len(first)


def shard_runs(docs: DataFrame, length: int, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """Runs of the transforms of all shards of documents (at, text), of suffixes whose sure symbols may stand twice.

    Repeated keys go to the tasks as a Bloom filter up to `filter_keys` of them (under a
    byte each); beyond, runs are joined with them.
    """
    often = docs.select("text").mapInArrow(lambda b: _first_symbols(b, length), "m long, more boolean")
    often = staged(often.groupBy("m").agg(F.count("*").alias("n"), F.max("more").alias("more")).where("n > 1 or more").select("m"), "repeated", SHARD_ROWS)
    kinds, n = _RUNS.format(docs.schema["at"].dataType.simpleString()), often.count()
    if n > filter_keys:
        every = docs.select("at", "text").mapInArrow(lambda b: _shards(b, length, lambda m, batch, row: np.ones(len(m), bool)), kinds)
        return staged(every.join(often, "m", "left_semi").select("run", "m", "symbols", "w0", "w1", "n", "places"), "runs", SHARD_ROWS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([b.column(0), pa.array(second_hash(m.view(np.uint64))), pa.array(np.zeros(len(m), np.int64))], names=["one", "two", "shard"])

    keys = often.mapInArrow(keyed, "one long, two long, shard long")
    held = docs.sparkSession.sparkContext.broadcast(filled(sized(0, max(n, 1), 1, FILTER_RATE), keys, 1))

    def passes(m: np.ndarray, batch: pa.RecordBatch, row: int) -> np.ndarray:
        return held.value.passes(m.view(np.int64), second_hash(m), np.zeros(len(m), np.int64))

    return staged(docs.select("at", "text").mapInArrow(lambda b: _shards(b, length, passes), kinds), "runs", SHARD_ROWS)


def interleaved(runs: DataFrame, length: int) -> DataFrame:
    """The merged order of shards' runs: run, interval (of the sure symbols), depth, repeated, id; staged.

    Each round splits the intervals by one symbol more; the last one by the digest of all
    bytes, those before the suffix too. depth counts the symbols that a run shares with
    another one, or with itself where it holds two suffixes (the sure ones are taken as
    shared); repeated says that it got through the last round; runs of one id are alike.
    A round needs its own symbol and those to come; the table of the round before is deleted.
    """
    sure = sampler(length).sure
    rest = [F.col("symbols")[k].alias(f"s{sure + k + 1}") for k in range(SYMBOLS - sure)]
    live, done = runs.select("run", F.col("m").alias("i"), F.col("m").alias("interval"), "n", *rest, "w0", "w1"), []
    for depth in range(sure + 1, SYMBOLS + 2):
        names = [f"s{depth}"] if depth <= SYMBOLS else ["w0", "w1"]
        some = live.groupBy("i", *names).agg(F.sum("n").alias("t"), F.min("run").alias("next")).where("t > 1").drop("t")
        held = staged(live.join(some, ["i", *names], "left").drop("i", *names), "interleave")
        done.append(staged(held.where("next is null").select("run", "interval", F.lit(depth - 1).alias("depth"), F.lit(False).alias("repeated"), F.col("run").alias("id")), "retired"))
        if depth > sure + 1:
            released(before)
        before, live = held, held.where("next is not null").withColumnRenamed("next", "i")
    done.append(live.select("run", "interval", F.lit(SYMBOLS).alias("depth"), F.lit(True).alias("repeated"), F.col("i").alias("id")))
    for more in done[1:]:
        done[0] = done[0].unionByName(more)
    return done[0]


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Digests (96 bits) of the strings of documents' doubtful starts."""
    for batch in portions(batches, SHARD_ROWS):
        at, start, digests = [], [], []
        for row in range(batch.num_rows):
            raw = raw_text(batch.column(1)[row].as_py())
            for lo, hi in unpacked(batch.column(2)[row]):
                some = range(lo, hi + 1)
                digests += [xxhash.xxh3_128_digest(raw[s : s + length]) for s in some]
                start += some
                at += [row] * len(some)
        two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(np.ascontiguousarray(two[:, 0])), pa.array(two[:, 1].astype(np.int32))], names=["at", "start", "w0", "w1"])


def packed(a: str, b: str) -> Column:
    """Pairs of a group, each as one long."""
    return F.collect_list(F.col(a).cast("long") + F.shiftleft(F.col(b).cast("long"), 32))


def unpacked(pairs: pa.ListScalar) -> list[list[int]]:
    x = pairs.values.to_numpy(zero_copy_only=False) if pairs.is_valid else np.zeros(0, np.int64)
    return np.stack([x & 0xFFFFFFFF, x >> 32], axis=1).tolist()


def listed(lists: DataFrame, name: str, most: int = LISTED) -> DataFrame:
    """at with a list, staged: to be broadcast if all lists together have at most `most` entries, else joined."""
    held = staged(lists, name)
    entries = held.agg(F.sum(F.size(name))).first()[0] or 0
    return F.broadcast(held) if entries <= most else held


def copied_texts(docs: DataFrame, length: int, rows: int = COPIES_ROWS) -> DataFrame:
    """at of each document of at least `length` bytes whose text another row has too, and the least such at (least)."""
    keyed = docs.where(F.octet_length("text") >= length).select("at", F.unhex(F.md5(F.col("text").cast("binary"))).alias("k"))
    least = staged(keyed.groupBy("k").agg(F.min("at").alias("least"), F.count("*").alias("n")).where("n > 1").select("k", "least"), "repeated_texts")
    if least.limit(rows + 1).count() <= rows:
        return keyed.join(F.broadcast(least), "k").select("at", "least")
    dealt = least.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return keyed.withColumn("s", F.pmod(F.xxhash64("at"), F.lit(SALTS))).join(dealt, ["k", "s"]).select("at", "least")


def repeated_spans(docs: DataFrame, length: int = 400, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """Spans (at, start, stop: bytes, half open) that strings of `length` bytes cover which start twice or more in the table.

    Expects at and text; spans of a document neither overlap nor touch. Of rows with one
    text the first takes part in the search, all are spans whole (stop is beyond the end).
    """
    s, kind = sampler(length), docs.schema["at"].dataType.simpleString()
    copies = staged(copied_texts(docs, length), "copies")
    others = small(staged(copies.where("at <> least").select("at").distinct(), "others"), COPIES_ROWS)
    first_texts = docs.join(others, "at", "left_anti").select("at", "text")
    runs = shard_runs(first_texts, length, filter_keys)
    found = staged(interleaved(runs, length), "intervals")
    places = lambda df: df.select("*", F.explode("places").alias("x")).select("*", "x.at", "x.lo", "x.hi", "x.p").drop("places", "x")
    whole = places(runs.select("run", "places").join(found.where("repeated").select("run"), "run", "left_semi"))
    # intervals of the sure symbols that hold suffixes of different bytes: one of each is compared
    mixed = found.groupBy("interval").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("interval")
    doubt = found.where("run = id").join(mixed, "interval", "left_semi").select("run", "depth")
    least = F.element_at(F.array(*[F.lit(int(length - s.ends[min(d + 1, SYMBOLS)] + (d < SYMBOLS))) for d in range(SYMBOLS + 1)]), F.col("depth") + 1)
    first = runs.select("run", F.col("places")[0].alias("x")).join(doubt.withColumn("least", least), "run")
    starts = first.select("x.at", "x.lo", F.least("x.hi", F.col("x.p") - F.col("least")).alias("hi")).where("lo <= hi")
    starts = listed(starts.groupBy("at").agg(packed("lo", "hi").alias("starts")), "starts")  # bounded by a document
    texts = first_texts.dropDuplicates(["at"]) if isinstance(docs.schema["at"].dataType, StructType) else first_texts  # rows alike have one at
    strings = staged(texts.join(starts, "at").select("at", "text", "starts").mapInArrow(lambda b: _strings(b, length), f"at {kind}, start int, w0 long, w1 int"), "strings", SHARD_ROWS)
    again = strings.groupBy("w0", "w1").agg(F.count("*").alias("n")).where("n > 1").select("w0", "w1")
    own = Window.partitionBy("at").orderBy("start")
    opens = F.when(F.lag("start").over(own).eqNullSafe(F.col("start") - 1), 0).otherwise(1)
    again = strings.join(again, ["w0", "w1"], "left_semi").select("at", "start", opens.alias("o")).withColumn("g", F.sum("o").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    again = staged(again.groupBy("at", "g").agg(F.min("start").alias("start"), (F.max("start") + length).alias("stop")).select("at", "start", "stop"), "again")
    released(strings)
    same = copies.select("at").distinct().select("at", F.lit(0).alias("start"), F.lit(2**31 - 1).alias("stop"))
    spans = whole.select("at", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop")).unionByName(again).unionByName(same)
    own = Window.partitionBy("at").orderBy("start", "stop")
    opens = F.when(F.col("start") <= F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    spans = spans.withColumn("o", opens).withColumn("g", F.sum("o").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("at", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("g")


def _removed(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, SHARD_ROWS):
        rows = []
        for t, spans in zip(batch.column(1), batch.column(2)):
            raw = raw_text(t.as_py())
            kept, at, gone = [], 0, []
            for start, stop in sorted(unpacked(spans)):  # they neither overlap nor touch
                kept.append(raw[at:start])
                at = min(stop, len(raw))
                gone += [start, at]
            left = b"".join([*kept, raw[at:]])
            rows.append((len(raw), len(raw) - len(left), len(gone) // 2, hashlib.sha256(left).hexdigest(), *[left, gone] * texts))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary(), pa.list_(pa.int64())] * texts)
        yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds))], names=["at", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "spans"] * texts])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, filter_keys: int = FILTER_KEYS, texts: bool = True) -> DataFrame:
    """Every document without the bytes of strings of `length` bytes that start more than once in the table.

    Strings are of UTF-8 bytes, never cross documents and are judged on the input; all
    occurrences go, the first too. Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, and with `texts` kept (bytes; a character may be cut) and
    spans (starts and ends of removed runs).

    Null and empty texts have no bytes. Rows are documents of their own, those with a null
    id or with one id too, so a repeated row of at least `length` bytes goes whole. An
    empty table gives no rows; other columns are not read. Without `texts` the rows are
    written and read again, so that no large batches of texts go to Python at the end either.
    """
    rows = pick(docs, at=id_col, text=text_col).select(F.coalesce(F.col("at").cast("long"), F.lit(_NULL)).alias("at"), "text")
    doc_id = F.col("at")
    if rows.groupBy("at").count().where(F.col("count") > 1).limit(1).count():
        rows = rows.select(F.struct("at", F.xxhash64("text").alias("th")).alias("at"), "text")
        doc_id = F.col("at.at")
    spans = listed(repeated_spans(rows, length, filter_keys).groupBy("at").agg(packed("start", "stop").alias("spans")), "spans")
    held = rows.join(spans, "at", "left").select("at", "text", "spans")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept", "spans"] * texts]
    kinds = f"at {rows.schema['at'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<long>" * texts
    removed = held.mapInArrow(lambda b: _removed(b, texts), kinds)
    if not texts:
        removed = staged(removed, "removed", SHARD_ROWS)
    return removed.select(F.when(doc_id != _NULL, doc_id).alias("doc_id"), *names)
