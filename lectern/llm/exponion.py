"""k-means over integer vectors by Exponion search, exact to the last tie.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of the
distance to any other. Where they don't settle it, only centroids inside a ball around its
current one are scanned: with u the distance to that and s the way from it to the nearest
other centroid, the two nearest lie within 2u + s of it. Lists of the centroids by their
distance from each other, sorted, give the ball's members as a prefix; the radius counts
them inclusively, with a margin above the rounding of floats, so that ties are found.
Distances that decide are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import pick, released, staged

#: Components beyond this size are an error: squared distances of up to 512 components must fit a long.
LARGEST = 1 << 26
#: Bounds are widened by this share and this much, far more than the rounding of floats.
MARGIN, SLACK = 1e-9, 1e-6
#: Vectors compared at once in a task.
ROWS = 8192

_STATE = "vec_id long, v array<long>, a int, upper double, lower double, scanned long"


@dataclass
class Centroids:
    """Integer centroids with, for each, the others in order of distance from it."""

    points: np.ndarray
    #: The way each has moved since the round before.
    moved: np.ndarray

    def __post_init__(self) -> None:
        gaps = np.sqrt(np.stack([squared(self.points, c) for c in self.points]).astype(np.float64))
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.order = np.stack([np.concatenate([[k], o[o != k]]) for k, o in enumerate(self.order)])  # itself first, whatever ties
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.near = self.gaps[:, 1] if len(self.points) > 1 else np.full(1, np.inf)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def _scan(v: np.ndarray, members: np.ndarray, sizes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance and that of the next, among the first sizes[i] of members."""
    none = np.iinfo(np.int64).max
    best, other, at = np.full(len(v), none), np.full(len(v), none), np.full(len(v), -1)
    for k in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > k)
        c = int(members[k])
        d = squared(v[rows], points[c])
        wins = (d < best[rows]) | (d == best[rows]) & (c < at[rows])
        other[rows] = np.where(wins, best[rows], np.minimum(other[rows], d))
        best[rows], at[rows] = np.where(wins, d, best[rows]), np.where(wins, c, at[rows])
    return at, best, other


def assigned(v: np.ndarray, a: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, now: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Centroid, upper and lower bound of every vector, and how many distances it took; a None: all are scanned."""
    k, took = len(now.points), 0
    root = lambda d: np.where(d == np.iinfo(np.int64).max, np.inf, np.sqrt(d.astype(np.float64)))
    if a is None:
        at, best, other = _scan(v, np.arange(k), np.full(len(v), k), now.points)
        return at, root(best), root(other), k * len(v)
    a = a.copy()
    farthest = int(np.argmax(now.moved))
    others = np.where(a == farthest, np.max(np.delete(now.moved, farthest), initial=0.0), now.moved[farthest])
    upper, lower = upper + now.moved[a] * (1 + MARGIN), lower - others * (1 + MARGIN)
    for c in np.unique(a).tolist():
        for tight in (False, True):  # with the old bound, then with the distance itself
            rows = np.flatnonzero((a == c) & (upper * (1 + MARGIN) + SLACK >= np.maximum(lower, now.near[c] / 2)))
            if not len(rows):
                break
            if not tight:
                upper[rows] = root(squared(v[rows], now.points[c]))
                took += len(rows)
        if not len(rows):
            continue
        radius = (2 * upper[rows] + now.near[c]) * (1 + MARGIN) + SLACK
        sizes = np.searchsorted(now.gaps[c], radius, side="right")
        at, best, other = _scan(v[rows], now.order[c], sizes, now.points)
        took += int(sizes.sum())
        a[rows] = at + k  # not looked at again in this round
        upper[rows], lower[rows] = root(best), np.where(sizes < 2, lower[rows], root(other))
    return np.where(a >= k, a - k, a), upper, lower, took


def _round(batches: Iterator[pa.RecordBatch], now: Centroids, first: bool, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            b = batch.slice(start, ROWS)
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            if np.abs(v).max(initial=0) > LARGEST:
                raise ValueError(f"vectors have components beyond {LARGEST}")
            held = [None, np.zeros(0), np.zeros(0)] if first else [b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "upper", "lower")]
            at, upper, lower, took = assigned(v, *held, now)
            count = np.zeros(len(at), np.int64)
            count[:1] = took
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array(at.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(count)], names=[c.split()[0] for c in _STATE.split(", ")])


def _measured(batches: Iterator[pa.RecordBatch], now: Centroids, size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        a = b.column("a").to_numpy(zero_copy_only=False)
        yield pa.record_batch([b.column("vec_id"), b.column("a"), pa.array(squared(v, now.points[a]))], names=["vec_id", "cluster", "distance"])


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, size: int, scale: float) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of the vectors with `size` components, none null or non-finite."""
    held = pick(rows, vec_id=id_col, e=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("e").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    return held.where((F.size("e") == size) & fine).select("vec_id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed, `:` and vec_id, in that order; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def _sums(state: DataFrame, size: int) -> list:
    """Count and componentwise sum of each cluster: a row a cluster."""
    part: list[Column] = [F.sum(F.col("v")[j]).alias(f"c{j}") for j in range(size)]
    return state.groupBy("a").agg(F.count("*").alias("n"), *part).collect()


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: float = 1024.0, seed: str = "3") -> DataFrame:
    """k-means of the vectors: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, scanned.

    Vectors with exactly `size` components, none null or non-finite, take part, with
    integer components floor(scale * x), of at most 2**26 (else an error). Centroids start
    as the k vectors of smallest seeded hash; each round gives every vector to its nearest
    centroid (ties: the smaller number) and moves every centroid that has vectors to the
    componentwise floor of their mean; in the end vectors are given once more. `scanned`
    is the number of distances that all rounds took, for the whole table.

    Equal vectors, repeated ids and repeated rows are vectors each; a null id comes last
    among first centroids, ties there go by components. Fewer than k vectors make as many
    centroids; none give no rows. Other columns are not read. k centroids reach the
    driver; vectors and their bounds stay in a table of the shared folder, of which the
    round before is deleted.
    """
    spark = rows.sparkSession
    vectors = staged(whole_vectors(rows, id_col, vector_col, size, scale), "vectors")
    points = first_centroids(vectors, k, seed)
    if not len(points):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned long")
    now, state, scanned = Centroids(points, np.zeros(len(points))), vectors, 0
    for n in range(rounds + 1):
        made = staged(state.mapInArrow(lambda b, now=now, first=not n: _round(b, now, first, size), _STATE), "bounds")
        if n:
            released(state)
        state = made
        scanned += state.agg(F.sum("scanned")).first()[0] or 0
        if n == rounds:
            break
        points = now.points.copy()
        for r in _sums(state, size):
            points[r["a"]] = [r[f"c{j}"] // r["n"] for j in range(size)]
        now = Centroids(points, np.sqrt(np.array([squared(p[None], q)[0] for p, q in zip(points, now.points)], np.float64)))
    found = state.mapInArrow(lambda b: _measured(b, now, size), "vec_id long, cluster int, distance long")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    named = [(c, inertia.get(c, 0), ",".join(map(str, p))) for c, p in enumerate(now.points.tolist())]
    held = F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, centroid string"))
    found = found.join(held, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.sha2("centroid", 256).alias("centroid_sha256"))
    return found.withColumn("scanned", F.lit(scanned).cast("long"))
