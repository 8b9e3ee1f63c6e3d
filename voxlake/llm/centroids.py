"""Centroid clustering of integer vectors, with partial-distance search.

Components become the integers floor(1024 x). The centroids start as the vectors whose ids have the least digests; each
round assigns every vector to its nearest centroid and replaces a centroid by the exact, floored mean of its vectors.
A round is one pass over the source: a task holds a batch of vectors and the centroids, of which there are few, and sends
sums by cluster and dimension, so a vector that a third of the rows share is no burden, and the driver gets one
sum for each cluster and dimension however many rows there are. Sums travel in limbs of ``LIMB`` bits, so that they are exact at any size.

Partial distances: squared differences are added up over the dimensions of high variance first, ``STEPS`` dimensions at a time. A
vector's first guess is the centroid nearest on the first of these; each other centroid is abandoned as soon as its sum is strictly
above the best full distance so far, so that a tie is always seen to the end and goes to the smaller number.

Defined results: a vector takes part if it has exactly the asked number of components, none of them null or non-finite; others get no row. Rows that
share an id are vectors of their own; a row with a null id takes part, but starts no centroid. Fewer vectors than clusters start fewer
centroids, an empty table gives no rows, and where no vector has an id there are no centroids and no rows. Components beyond ``NARROW`` are worked with as whole numbers of any size; a distance or inertia
that a long can't hold is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C

CLUSTERS, ROUNDS, DIM, SCALE = 8, 10, 64, 1024
STEPS = (8, 8, 16, 32)
LIMB = 40
#: Up to this size of components, squared distances of 4,096 of them and a batch's sums of squares fit 64 bits.
NARROW = 1 << 24
ROWS = 4096


def integers(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows' positions and their integer vectors: int64, or objects where a component is beyond NARROW."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(right)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    at, x = at[good], x[good]
    if not len(x) or np.abs(x).max() < NARROW // SCALE:
        return at, np.floor(x * SCALE).astype(np.int64)
    big = np.abs(x) >= 1 << 53  # whole numbers, whose products may be beyond a double
    out = np.where(big, 0, np.floor(np.where(big, 0, x) * SCALE)).astype(object)
    for k in np.ndindex(out.shape):
        out[k] = int(x[k]) * SCALE if big[k] else int(out[k])
    return at, out


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (ties: the smaller number) and its squared distance; order: the dimensions, those of high variance first."""
    if v.dtype != centroids.dtype:
        v, centroids = v.astype(object), centroids.astype(object)
    v, centroids = np.ascontiguousarray(v[:, order].T), centroids[:, order]
    edges = np.minimum(np.concatenate([[0], np.cumsum(STEPS)]), len(v))
    if edges[-1] < len(v):
        edges = np.append(edges, len(v))

    def add(rows: np.ndarray, c: int, a: int, b: int) -> np.ndarray:
        total = 0
        for j in range(a, b):
            gap = v[j][rows] - centroids[c, j]
            total = total + gap * gap
        return total

    rows = np.arange(v.shape[1])
    first = np.array([add(rows, c, edges[0], edges[1]) for c in range(len(centroids))])
    which = first.argmin(axis=0)
    best = first[which, rows]
    for c in range(len(centroids)):  # the guesses' full distances
        own = np.flatnonzero(which == c)
        if len(own):
            best[own] = best[own] + add(own, c, edges[1], len(v))
    guess = which.copy()
    for c in range(len(centroids)):
        own = np.flatnonzero(guess != c)
        sums = first[c][own]
        for a, b in zip(edges[1:], edges[2:], strict=False):
            stay = sums <= best[own]
            own, sums = own[stay], sums[stay]
            if not len(own):
                break
            sums = sums + add(own, c, a, b)
        if len(own):
            won = (sums < best[own]) | (sums == best[own]) & (c < which[own])
            which[own[won]], best[own[won]] = c, sums[won]
    return which, best


def limbs(total: int) -> list[int]:
    """total as the sum of x << (LIMB * place): all but the last are not negative, so that limbs can be added up on their own."""
    out = []
    while not -(1 << LIMB) < total < 1 << LIMB:
        out.append(total & (1 << LIMB) - 1)
        total >>= LIMB
    return [*out, total]


class Sums:
    """Exact sums by cluster and dimension, and of squares by dimension (cluster -1), of one task."""

    def __init__(self, clusters: int, dim: int):
        self.sums = np.zeros((clusters + 1, dim + 1), object)

    def add(self, v: np.ndarray, which: np.ndarray) -> None:
        for c in np.unique(which).tolist():
            own = v[which == c]
            self.sums[c, :-1] += own.sum(axis=0).astype(object)
            self.sums[c, -1] += len(own)
        if len(v):
            self.sums[-1, :-1] += (v * v).sum(axis=0).astype(object)
            self.sums[-1, -1] += len(v)

    def batch(self) -> pa.RecordBatch:
        squares = len(self.sums) - 1
        rows = [(-1 if c == squares else c, d, place, x) for (c, d), total in np.ndenumerate(self.sums) if total for place, x in enumerate(limbs(int(total)))]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["c", "d", "place", "x"])


def summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Whole sums by cluster and dimension: at most (clusters + 1) * (dim + 1) of them, whatever the input's size."""
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("c", "d", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[r.c, r.d] = out.get((r.c, r.d), 0) + (int(r.x) << LIMB * r.place)
    return out


def first_centroids(rows: DataFrame, clusters: int, dim: int, salt: str) -> np.ndarray:
    """The usable vectors whose ids have the least digests, in their order; equal ids by the text of their integers."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, list[str]]] = []
        for batch in batches:
            at, v = integers(batch.column(1), dim)
            ids = batch.column(0).take(pa.array(at)).to_pylist()
            named = [(hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), k) for k, i in enumerate(ids) if i is not None]
            most = heapq.nsmallest(clusters, [h for h, _ in named] + [h for h, _ in held])[-1:]
            held = heapq.nsmallest(clusters, held + [(h, list(map(str, v[k].tolist()))) for h, k in named if h <= most[0]])
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), pa.array([v for _, v in held], pa.list_(pa.string()))], names=["digest", "v"])

    found = rows.mapInArrow(least, "digest string, v array<string>").orderBy("digest", "v").limit(clusters).collect()
    return tidy([[int(x) for x in r.v] for r in found], dim)


def by_variance(n: int, sums: list[int], squares: list[int]) -> np.ndarray:
    """The dimensions, those of high variance first."""
    return np.array(sorted(range(len(sums)), key=lambda d: (sums[d] ** 2 - n * squares[d], d)))


def tidy(vectors: list[list[int]], dim: int) -> np.ndarray:
    wide = any(abs(x) > NARROW for v in vectors for x in v)
    return np.array(vectors, object if wide else np.int64).reshape(-1, dim)


def cluster(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, salt: str = "3") -> DataFrame:
    """One row per usable vector: the id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Runs the rounds' jobs."""
    spark = embeddings.sparkSession
    id_type = embeddings.schema[id_col].dataType.simpleString()
    rows = embeddings.select(embeddings[id_col].alias("id"), embeddings[vector_col].cast("array<double>").alias("v"))
    centroids = first_centroids(rows, clusters, dim, salt)
    schema = f"`{id_col}` {id_type}, cluster int, distance long"
    out = f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    k = len(centroids)
    exact = centroids.astype(object)
    order = by_variance(k, exact.sum(axis=0).tolist(), (exact * exact).sum(axis=0).tolist())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                at, v = integers(part.column(1), dim)
                yield part.column(0).take(pa.array(at)), v

    def means(centroids: np.ndarray, order: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(k, dim)
            for _, v in pieces(batches):
                sums.add(v, nearest(v, centroids, order)[0])
            yield sums.batch()

        return run

    for _ in range(rounds):
        got = summed(rows.mapInArrow(means(centroids, order), "c int, d int, place int, x long"))
        counts = [got.get((c, dim), 0) for c in range(k)]
        new = [[got.get((c, d), 0) // counts[c] if counts[c] else int(centroids[c, d]) for d in range(dim)] for c in range(k)]
        order = by_variance(got[-1, dim], [sum(got.get((c, d), 0) for c in range(k)) for d in range(dim)], [got.get((-1, d), 0) for d in range(dim)])
        centroids = tidy(new, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in pieces(batches):
            which, far = nearest(v, centroids, order)
            yield pa.RecordBatch.from_arrays([ids, pa.array(which, pa.int32()), pa.array([x if x < 1 << 63 else None for x in far.tolist()], pa.int64())], names=[id_col, "cluster", "distance"])

    assigned = C.written(rows.mapInArrow(assign, schema))
    long = lambda x: int(x) if x is not None and int(x) < 1 << 63 else None
    inertia = {r.cluster: None if r.gone else r.s for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.max(F.col("distance").isNull()).alias("gone")).collect()}
    whole = None if None in inertia.values() else sum(inertia.values())
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(c, long(s), long(whole), digests[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
