"""URL filters by Bloom filter cascades.

A key is a host, or the end of one at a dot, and the beginning of a path. A cascade
holds the listed keys of a complete key universe: its first level is a Bloom filter of
the listed keys, the next holds the other keys that pass it, the next the listed keys
that pass that one, until none is left. For every key of the universe the level at which
it first fails tells exactly whether it is listed, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bloom import Level, filled, mixed, sized
from lectern.llm.common import pick, staged

#: False positives of the first level and of the others.
FIRST_RATE, RATE = 0.05, 0.5
#: Listed keys of a shard; a shard has filters of its own.
SHARD_KEYS = 4_000_000
#: Bytes of filters that go to the tasks at once, at 2 a listed key; more shards take another pass.
BROADCAST_BYTES = 128 << 20


def hashes(key: Column) -> list[Column]:
    """Two hashes of a key; every level mixes its own from them."""
    return [F.xxhash64(key, F.lit(k)) for k in (1, 2)]


@dataclass
class Cascade:
    """Levels for `held` of all `shards`, from shard `first` on."""

    shards: int
    first: int
    held: int
    levels: list[Level] = field(default_factory=list)

    def listed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether each key of the universe, by its two hashes, is listed; false in shards that aren't held."""
        shard = (mixed(one, 99) % np.uint64(self.shards)).astype(np.int64) - self.first
        out = np.zeros(len(one), bool)
        alive = np.flatnonzero((shard >= 0) & (shard < self.held))
        for level in self.levels:
            passed = level.passes(one[alive], two[alive], shard[alive])
            out[alive[~passed]] = level.number % 2 == 1
            alive = alive[passed]
        out[alive] = len(self.levels) % 2 == 1
        return out


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.passes(*(c.to_numpy(zero_copy_only=False) for c in b.columns))))

    return staged(keys.mapInArrow(run, "one long, two long, shard long"), "passing")


def build(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> list[Cascade]:
    """Cascades for the listed keys of a universe (a column key each, no nulls).

    Keys are dealt to shards so that a shard's filters stay small; there is one cascade
    for each run of shards that may be sent to the tasks together, usually one. Listed
    keys outside the universe are left out.
    """
    named = lambda df: df.select(*[h.alias(n) for h, n in zip(hashes(F.col("key")), ("one", "two"))]).distinct()
    inside = staged(named(listed.join(universe, "key", "left_semi")), "listed")
    outside = staged(named(universe).join(inside, ["one", "two"], "left_anti"), "others")
    n = inside.count()
    shards = max(1, math.ceil(n / shard_keys))
    at_once = max(1, int(broadcast_bytes // (2 * shard_keys)))
    out = []
    for first in range(0, shards, at_once):
        cascade = Cascade(shards, first, min(at_once, shards - first))
        now, other = (_sharded(x, cascade) for x in (inside, outside))
        while n := now.count():
            level = filled(sized(len(cascade.levels), n, cascade.held, RATE if cascade.levels else FIRST_RATE), now, cascade.held)
            cascade.levels.append(level)
            now, other = _passing(other, level), now
        out.append(cascade)
    return out


def _sharded(keys: DataFrame, cascade: Cascade) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one = b.column(0).to_numpy(zero_copy_only=False)
            shard = (mixed(one, 99) % np.uint64(cascade.shards)).astype(np.int64) - cascade.first
            mine = pa.array((shard >= 0) & (shard < cascade.held))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(shard)], names=["one", "two", "shard"]).filter(mine)

    return keys.select("one", "two").mapInArrow(run, "one long, two long, shard long")


def split_url(rows: DataFrame) -> DataFrame:
    """`rows` with host (A-Z lower-cased) and path of column url; both empty for null or without ://."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def candidate_keys(lengths: list[int]) -> Column:
    """Every key of columns host and path, longest first: ends of the host at dots, with the beginnings of the path of the given lengths."""
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length("path") >= n)
    heads = F.transform(heads, lambda n: F.expr("path").substr(F.lit(1), n))
    keys = F.flatten(F.transform(ends, lambda e: F.transform(heads, lambda p: F.concat(e, p))))
    ordered = F.sort_array(F.transform(F.array_distinct(keys), lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))), asc=False)
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(ordered, lambda s: s["k"]))


def first_listed(rows: DataFrame, keys: str, lists: dict[str, list[Cascade]], hit: str) -> DataFrame:
    """`rows` with `hit`: struct of the place (from 0) of the first of a row's keys that a list holds, and the list's name; else null.

    Lists must not share keys, and the keys must be of the cascades' universe. Runs of
    shards are one pass each; of their hits the first key counts.
    """
    width, passes = len(rows.columns), max(map(len, lists.values()), default=0)
    out = rows.withColumn(hit, F.lit(None).cast("struct<place:int,list:string>"))
    for turn in range(passes):
        held = rows.sparkSession.sparkContext.broadcast({k: v[turn] for k, v in lists.items() if turn < len(v)})
        named = out.select("*", *[_hash_each(keys, i).alias(f"__{i}") for i in range(2)])
        out = named.mapInArrow(_finder(held, width), out.schema)
    return out


def _hash_each(keys: str, which: int) -> Column:
    return F.transform(keys, lambda k: hashes(k)[which])


def _finder(held, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(width + 1).offsets.to_numpy())
            one, two = (b.column(width + 1 + i).flatten().to_numpy(zero_copy_only=False) for i in range(2))
            row = np.repeat(np.arange(b.num_rows), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            best: dict[int, tuple[int, str]] = {k: (v["place"], v["list"]) for k, v in enumerate(b.column(width).to_pylist()) if v}
            for name, cascade in held.value.items():
                for at in np.flatnonzero(cascade.listed(one, two)).tolist():
                    now = (int(place[at]), name)
                    best[row[at]] = min(best.get(row[at], now), now)
            found = [dict(zip(("place", "list"), best[k])) if k in best else None for k in range(b.num_rows)]
            kind = pa.struct([("place", pa.int32()), ("list", pa.string())])
            yield pa.record_batch([*b.columns[:width], pa.array(found, kind)], names=b.schema.names[: width + 1])

    return run


def filter_urls(pages: DataFrame, rules: dict[str, list[str]], hosts: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and listed_host of every row.

    `rules` has keys (host, then path) by verdict; the longest key that fits decides.
    Without one the url is blocked if its host, or what stands after a dot of it, is in
    `hosts` (column host), else allowed. Null urls and those without :// have neither
    host nor path and are allowed; repeated rows are each judged; an empty table gives
    none; null hosts in the list are passed over. Other columns are not read.
    """
    lengths = sorted({len(k.partition("/")[1] + k.partition("/")[2]) for v in rules.values() for k in v})
    rows = split_url(pick(pages, page_id=id_col, url=url_col).select("page_id", F.col("url").cast("string").alias("url")))
    rows = staged(rows.select("page_id", "host", "path").withColumn("keys", candidate_keys(lengths)).withColumn("ends", candidate_keys([0])), "urls")
    spark = pages.sparkSession
    universe = lambda c: rows.select(F.explode(c).alias("key")).distinct()
    keys, ends = staged(universe("keys"), "keys"), staged(universe("ends"), "hosts")
    lists = {verdict: build(keys, spark.createDataFrame([(k,) for k in v], "key string")) for verdict, v in rules.items()}
    blocked = build(ends, hosts.select(F.col("host").alias("key")).where("key is not null").distinct())
    out = first_listed(first_listed(rows, "keys", lists, "by_rule"), "ends", {"block": blocked}, "by_host")
    return out.select(
        "page_id",
        "host",
        "path",
        F.get("keys", F.col("by_rule.place")).alias("rule"),
        F.coalesce("by_rule.list", "by_host.list", F.lit("allow")).alias("verdict"),
        F.get("ends", F.col("by_host.place")).alias("listed_host"),
    )
