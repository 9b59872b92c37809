"""Bloom filters: bits set by Spark's bitmap aggregate, tested in numpy inside tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = x.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@dataclass
class Level:
    """A Bloom filter of `bits` for each of the shards held."""

    number: int
    bits: int
    functions: int
    bitmap: np.ndarray | None = None

    def places(self, one: np.ndarray, two: np.ndarray, shard: np.ndarray) -> Iterator[np.ndarray]:
        a, b = mixed(one, self.number), mixed(two, self.number)
        for i in range(self.functions):
            yield ((a + np.uint64(i) * b) % np.uint64(self.bits)).astype(np.int64) + shard * self.bits

    def passes(self, one: np.ndarray, two: np.ndarray | Callable, shard: np.ndarray) -> np.ndarray:
        """Which keys may be in the filter; `two`, the second hashes, may be a function of the first ones."""
        a, left = mixed(one, self.number), np.arange(len(one))
        for i in range(self.functions):  # each on those that passed so far
            if i:
                step = mixed(two(one[left]) if callable(two) else two[left], self.number) if i == 1 else step[kept]
                at = (a[left] + np.uint64(i) * step) % np.uint64(self.bits)
            else:
                at = a % np.uint64(self.bits)
            at = at.astype(np.int64) + shard[left] * self.bits
            kept = self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            left = left[kept]
        ok = np.zeros(len(one), bool)
        ok[left] = True
        return ok


def sized(number: int, n: int, shards: int, rate: float) -> Level:
    """A level for n keys in all shards, with a share `rate` of false positives."""
    per = max(1, math.ceil(n / shards))
    return Level(number, max(64, 8 * math.ceil(per * -math.log(rate) / math.log(2) ** 2 / 8)), max(1, round(-math.log2(rate))))


def filled(level: Level, keys: DataFrame, shards: int) -> Level:
    """The level with the bits of keys (one, two, shard) set, by Spark's bitmap aggregate; its own bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in level.places(*(c.to_numpy(zero_copy_only=False) for c in b.columns)):
                yield pa.record_batch([pa.array(at >> 15), pa.array(at & 32767)], names=["bucket", "bit"])

    at = keys.select("one", "two", "shard").mapInArrow(run, "bucket long, bit long")
    bitmap = np.zeros((level.bits * shards >> 15) + 1 << 12, np.uint8)
    for r in at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("m")).collect():
        bitmap[r["bucket"] << 12 : r["bucket"] + 1 << 12] = np.frombuffer(r["m"], np.uint8)
    return Level(level.number, level.bits, level.functions, bitmap)
