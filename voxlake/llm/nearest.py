"""Approximate nearest neighbours by cosine, over balanced posting lists.

Rows first become distinct vectors: of those that share one, the ids that any query can be given are the least, one more than asked for (a
query's own id is left out), so a vector that a third of the rows share is a few rows. Queries that share a vector are answered once.

Fit: a sample of the distinct vectors (the least by hash) is halved by balanced two-means until a part has at most
``LEAF``; the sample has ``SAMPLE`` vectors, or ``GROWTH`` times the root of their number if that is more, but at most
``SAMPLE_MOST`` (a documented bound), so that lists become more as well as longer; the parts' means are the centroids,
and a nearest-neighbour graph over them is the in-memory index. The driver fits at most ``SAMPLE`` vectors; of a larger sample it fits these to coarse
cells, and tasks halve the cells' vectors on. Every row is then
indexed: the graph search finds its nearest centroids, and it goes to the list of each
whose distance is at most ``BORDER`` times the least, unless a list already taken has a
centroid nearer than ``SPREAD`` times the vector's distance to that one (at most ``REPLICAS`` lists). A query searches
the same graph and reads the lists within ``PRUNE`` times its least centroid distance, at
least ``MIN_LISTS`` and at most ``MAX_LISTS``, going on while they hold fewer than
``MIN_ROWS`` rows. Scores are exact cosines of the original vectors in double precision; for that a vector is
first scaled by a power of two, which changes no digit and keeps its squares finite.

Skew: lists are cut into pieces of about ``PIECE`` rows by a hash of the id, and the queries that read a list into
pieces of about ``ASKED``; a piece of rows and one of queries are a group, which gives each query its best; so a list that many rows or queries are near
makes many groups, not one large task. List sizes and centroids (at most SAMPLE_MOST / LEAF
* 2) are all that is broadcast.

Defined results: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part, nor do rows with a null id; rows that share an id are one candidate
with the best of their scores and never each other's neighbours; ties go to the smaller id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks as C

SAMPLE, GROWTH, SAMPLE_MOST, LEAF, DEGREE = 50_000, 128, 2_000_000, 64, 24
BORDER, REPLICAS, SPREAD = 1.3, 8, 0.5
PRUNE, MIN_LISTS, MAX_LISTS, MIN_ROWS, BEAM = 1.2, 24, 256, 128, 256
PIECE, ASKED = 4096, 1024
#: Coarse cells of a sample that the driver doesn't fit by itself have about so many vectors of it.
CELL = 16_384


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows' positions and their vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], x[good]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows with their largest component in [0.5, 1), by powers of two: exact but for components too small to matter."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x: np.ndarray, leaf: int = LEAF, refine: int = 4) -> np.ndarray:
    """Centroids of balanced parts of unit vectors."""
    rng = np.random.default_rng(3)
    parts, done = [np.arange(len(x))], []
    while parts:
        own = parts.pop()
        if len(own) <= leaf:
            done.append(own)
            continue
        a, b = x[own[rng.integers(len(own))]], x[own[rng.integers(len(own))]]
        for _ in range(6):
            side = x[own] @ (a - b)
            near = side > np.median(side)
            if not 0 < near.sum() < len(own):
                break
            a, b = x[own[near]].mean(axis=0), x[own[~near]].mean(axis=0)
        order = np.argsort(x[own] @ (a - b), kind="stable")
        parts += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    c = np.array([x[own].mean(axis=0) for own in done])
    for _ in range(refine):  # rounds of spherical k-means even out what the halving cut through
        c = unit(c[(np.abs(c) > 1e-12).any(axis=1)]) if (np.abs(c) > 1e-12).any() else x[:1]
        own = np.concatenate([np.argmax(x[k : k + 4096] @ c.T, axis=1) for k in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        c = np.add.reduceat(x[order], first, axis=0)
    c = unit(c[(np.abs(c) > 1e-12).any(axis=1)]) if (np.abs(c) > 1e-12).any() else x[:1]
    return np.unique(c.astype(np.float32), axis=0)


class Index:
    """Centroids, and a graph over them."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        rng = np.random.default_rng(3)
        self.centroids = np.unique(centroids, axis=0)
        n = len(self.centroids)
        degree = min(degree, n - 1)
        self.links = np.empty((n, degree + 2), np.int32)
        for k in range(0, n, 512):
            d = self._far(self.centroids[k : k + 512], self.centroids)
            d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf
            self.links[k : k + 512, :degree] = np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree else np.empty((len(d), 0))
        # two long links for each centroid keep the graph in one piece
        self.links[:, degree] = (np.arange(n) + 1) % n
        self.links[:, degree + 1] = rng.permutation(n)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))

    @staticmethod
    def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0)

    def search(self, x: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of each row and their distances, nearest first: best-first walks over the graph, all rows in step."""
        n, rows = len(self.centroids), np.arange(len(x))
        x = x.astype(np.float32)
        beam = min(max(beam, k), n)
        k = min(k, n)
        seen = np.zeros((len(x), n), bool)
        ids = np.full((len(x), beam), -1, np.int64)
        dist = np.full((len(x), beam), np.inf, np.float32)
        spent = np.zeros((len(x), beam), bool)
        start = np.tile(self.entries, (len(x), 1))
        square = (self.centroids * self.centroids).sum(axis=1)
        fresh = start
        seen[:, self.entries] = True
        new = np.maximum(1 + square[fresh] - 2 * np.einsum("rd,rkd->rk", x, self.centroids[fresh]), 0)
        while True:
            all_ids, all_dist = np.concatenate([ids, fresh], axis=1), np.concatenate([dist, new], axis=1)
            all_spent = np.concatenate([spent, ~np.isfinite(new)], axis=1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            ids, dist, spent = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_dist, all_spent))
            open_ = ~spent & np.isfinite(dist)
            live = open_.any(axis=1)
            if not live.any():
                return ids[:, :k], np.sqrt(dist[:, :k])
            # each row expands its nearest open centroids
            best = np.argsort(np.where(open_, dist, np.inf), axis=1, kind="stable")[:, :4]
            take = np.take_along_axis(open_, best, axis=1)
            np.put_along_axis(spent, best, np.take_along_axis(spent, best, axis=1) | take, axis=1)
            fresh = self.links[np.where(take, np.take_along_axis(ids, best, axis=1), 0)].reshape(len(x), -1).astype(np.int64)
            usable = np.repeat(take, self.links.shape[1], axis=1) & ~seen[rows[:, None], fresh]
            # one of the same centroid met twice in a step
            s = np.sort(np.where(usable, fresh, -1 - np.arange(fresh.shape[1])), axis=1)
            fresh = s
            usable = fresh >= 0
            usable[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            fresh = np.where(usable, fresh, 0)
            r, c = np.nonzero(usable)
            seen[r, fresh[r, c]] = True
            new = np.full(fresh.shape, np.inf, np.float32)
            new[r, c] = np.maximum(1 + square[fresh[r, c]] - 2 * np.einsum("rd,rd->r", x[r], self.centroids[fresh[r, c]]), 0)

    def lists(self, x: np.ndarray, border: float = BORDER, replicas: int = REPLICAS) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for each list that a row of unit vectors goes to."""
        ids, dist = self.search(x, 2 * replicas, 4 * replicas)
        taken = np.zeros(ids.shape, bool)
        taken[:, 0] = True
        for j in range(1, ids.shape[1]):
            ok = np.isfinite(dist[:, j]) & (dist[:, j] <= border * dist[:, 0] + 1e-6) & (taken.sum(axis=1) < replicas)
            for i in range(j):
                gap = np.linalg.norm(self.centroids[ids[:, i]] - self.centroids[ids[:, j]], axis=1)
                ok &= ~(taken[:, i] & (gap < SPREAD * dist[:, j]))
            taken[:, j] = ok
        row, j = np.nonzero(taken)
        return row, ids[row, j]

    def probes(self, x: np.ndarray, sizes: np.ndarray, prune: float = PRUNE, least: int = MIN_LISTS, most: int = MAX_LISTS) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for each list that a query reads."""
        ids, dist = self.search(x, most, BEAM)
        held = np.cumsum(sizes[ids], axis=1)
        held = np.concatenate([np.zeros((len(x), 1), held.dtype), held[:, :-1]], axis=1)
        take = np.isfinite(dist) & ((dist <= prune * dist[:, :1]) | (np.arange(ids.shape[1]) < least) | (held < MIN_ROWS))
        row, j = np.nonzero(take)
        return row, ids[row, j]


def best(q: np.ndarray, vec_ids: np.ndarray, v: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, vec_id, score) of each query's k best ids, but for its own; equal vectors get equal scores, wherever they stand.

    A product of matrices says which rows can be among the best; what they score is then summed up row by row.
    """
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, v, q = vec_ids[order], scaled(v[order]), scaled(q)
    nq, nv = np.sqrt(np.einsum("rd,rd->r", q, q)), np.sqrt(np.einsum("rd,rd->r", v, v))
    u = v / nv[:, None]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q), 128):
        near = u @ (q[lo : lo + 128] / nq[lo : lo + 128, None]).T
        for i in range(lo, min(lo + 128, len(q))):
            rough = near[:, i - lo]
            if own is not None:
                rough[vec_ids == own[i]] = -np.inf
            some = np.arange(len(rough))
            if len(rough) > 32 * k:  # the rows that can be among the best, ties included
                some = np.flatnonzero(rough >= np.partition(rough, len(rough) - 4 * k)[len(rough) - 4 * k] - 1e-9)
                if len(np.unique(vec_ids[some][rough[some] > -np.inf])) < k:
                    some = np.arange(len(rough))
            some = some[rough[some] > -np.inf]
            s = np.einsum("rd,d->r", v[some], q[i]) / (nv[some] * nq[i])
            keep, seen = [], set()
            for p in np.argsort(-s, kind="stable").tolist():
                if len(keep) == k:
                    break
                if (x := int(vec_ids[some[p]])) not in seen:
                    seen.add(x)
                    keep.append(p)
            out.append((np.full(len(keep), i), vec_ids[some[keep]], s[keep]))
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3))  # type: ignore[return-value]


def hashed(rows: DataFrame) -> DataFrame:
    """With g and h, which rows of one vector share; 0.0 and -0.0 are one."""
    same = F.transform("v", lambda x: x + F.lit(0.0))
    return rows.withColumn("g", F.xxhash64(same)).withColumn("h", F.xxhash64(F.reverse(same), F.lit(1)))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """id, v: of the rows that share a vector those with the k + 1 least ids: others are in no answer. Spark limits each task's rows before it sends them."""
    once = hashed(rows).groupBy("g", "h", "id").agg(F.first("v").alias("v"))
    rank = F.row_number().over(Window.partitionBy("g", "h").orderBy("id"))
    return once.withColumn("r", rank).where(F.col("r") <= k + 1).select("id", "v", F.col("r").alias("copy"))


def centroids(usable: DataFrame, dim: int, count: int, sample: int, leaf: int, most: int = SAMPLE) -> np.ndarray:
    """Of a sample of the vectors; a sample of more than ``most`` is halved on in tasks, a coarse cell each, and the driver sees the cells and the centroids only."""
    share = min(1.0, 1.5 * sample / max(1, count))  # gives the sample in expectation; then the bound itself
    drawn = usable.where("copy = 1")
    drawn = drawn.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1) if share < 1 else drawn
    drawn = drawn.orderBy(F.xxhash64("id"), "id").limit(sample).select("v")
    if sample <= most or count <= most:
        _, x = matrix(drawn.toArrow().column("v"), dim)
        return fit(unit(x), leaf) if len(x) else np.zeros((0, dim), np.float32)
    drawn = C.written(drawn)
    _, x = matrix(drawn.limit(most).toArrow().column("v"), dim)
    if not len(x):
        return np.zeros((0, dim), np.float32)
    shared = usable.sparkSession.sparkContext.broadcast(fit(unit(x), max(leaf, int(CELL * most / sample))))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, v = matrix(batch.column(0), dim)
            u = unit(v)
            own = np.argmax(u @ shared.value.T, axis=1) if len(u) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), dim).cast(pa.list_(pa.float64()))], names=["cell", "v"])

    def halve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = np.array(table.column("v").combine_chunks().values).reshape(-1, dim)
        found = fit(x, leaf).astype(np.float64)
        return pa.table({"v": pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), dim).cast(pa.list_(pa.float64()))})

    found = drawn.mapInArrow(cell, "cell int, v array<double>").groupBy("cell").applyInArrow(halve, "v array<double>").toArrow().column("v")
    return np.array(found.combine_chunks().values, np.float32).reshape(-1, dim)


def search(embeddings: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, sample: int = SAMPLE, leaf: int = LEAF, most: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows of embeddings with another id. most: vectors that the driver fits."""
    spark = embeddings.sparkSession
    shown = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = shown(embeddings)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return none
    dim = dims.d
    usable = C.written(candidates(rows.where(F.size("v") == dim), k))
    count = usable.where("copy = 1").count()
    sample = min(max(sample, int(GROWTH * count**0.5)), max(sample, SAMPLE_MOST))
    c = centroids(usable, dim, count, sample, leaf, most)
    if not len(c):
        return none
    index = spark.sparkContext.broadcast(Index(c))
    asked = hashed(shown(queries).where(F.size("v") == dim))
    alone = asked.groupBy("g", "h").agg(F.first("v").alias("v"))

    def lists(ids: list[pa.Array], names: list[str], own: np.ndarray, row: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(i.take(at) for i in ids), pa.FixedSizeListArray.from_arrays(pa.array(v[row].ravel()), dim).cast(pa.list_(pa.float64()))], names=["list", *names, "v"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k0 in range(0, len(batch), 1024):
                part = batch.slice(k0, 1024)
                at, v = matrix(part.column(1), dim)
                row, own = index.value.lists(unit(v)) if len(v) else (np.zeros(0, np.int64),) * 2
                yield lists([part.column(0).take(pa.array(at))], ["id"], own, row, v)

    postings = usable.select("id", "v").mapInArrow(place, "list int, id long, v array<double>")
    sizes = np.zeros(len(index.value.centroids), np.int64)
    for r in postings.groupBy("list").count().collect():
        sizes[r.list] = r["count"]
    shared_sizes = spark.sparkContext.broadcast(sizes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k0 in range(0, len(batch), 512):
                part = batch.slice(k0, 512)
                at, v = matrix(part.column(2), dim)
                row, own = index.value.probes(unit(v), shared_sizes.value) if len(v) else (np.zeros(0, np.int64),) * 2
                yield lists([part.column(c).take(pa.array(at)) for c in (0, 1)], ["g", "h"], own, row, v)

    probes = C.written(alone.select("g", "h", "v").mapInArrow(probe, "list int, g long, h long, v array<double>"))
    readers = np.zeros(len(sizes), np.int64)
    for r in probes.groupBy("list").count().collect():
        readers[r.list] = r["count"]
    pieces = spark.sparkContext.broadcast((np.maximum(1, -(-sizes // PIECE)), -(-readers // ASKED)))

    def crossed(batch: pa.RecordBatch, ids: np.ndarray, rows: bool) -> pa.RecordBatch:
        """A row of one side in its own piece, with every piece of the other side."""
        own = batch.column(0).to_numpy()
        mine, theirs = pieces.value if rows else pieces.value[::-1]
        piece = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % np.maximum(1, mine[own])
        n = theirs[own]  # 0 where no query reads the list
        at = np.repeat(np.arange(len(own)), n)
        other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        both = [pa.array(piece[at], pa.int32()), pa.array(other, pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(own[at], pa.int32()), *(both if rows else both[::-1]), *(batch.column(i).take(pa.array(at)) for i in range(1, batch.num_columns))], names=["list", "piece", "part", *batch.schema.names[1:]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in place(batches):
            yield crossed(batch, batch.column(1).to_numpy(), True)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield crossed(batch, batch.column(1).to_numpy(), False)

    def compare(key: tuple[pa.Scalar, ...], ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(ours) or not len(theirs):
            q, v, s = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        else:
            _, a = matrix(theirs.column("v"), dim)
            _, b = matrix(ours.column("v"), dim)
            q, v, s = best(a, ours.column("id").to_numpy(), b, k + 1)
        at = pa.array(q.astype(np.int64))
        return pa.table({"g": theirs.column("g").take(at), "h": theirs.column("h").take(at), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    key = "list int, piece int, part int"
    left, right = usable.select("id", "v").mapInArrow(cut, f"{key}, id long, v array<double>"), probes.mapInArrow(spread, f"{key}, g long, h long, v array<double>")
    by = ["list", "piece", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "g long, h long, vec_id long, score double")
    once = found.groupBy("g", "h", "vec_id").agg(F.max("score").alias("score"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    top = once.withColumn("r", rank("g", "h")).where(F.col("r") <= k + 1).drop("r")
    answered = asked.select(F.col("id").alias("query_id"), "g", "h").join(top, ["g", "h"]).where("vec_id <> query_id")
    # rows that share a query's id are one query, with the best of their answers
    answered = answered.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return answered.withColumn("rank", rank("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = 5) -> list[tuple[int, int, int, float]]:
    """All candidates for each query; for tests and for measuring recall."""
    q, v, s = best(x[queries].astype(np.float64), ids, x.astype(np.float64), k, own=ids[queries])
    out, last, rank = [], None, 0
    for a, b, c in zip(ids[queries][q.astype(np.int64)].tolist(), v.tolist(), s.tolist(), strict=True):
        rank = rank + 1 if a == last else 1
        last = a
        out.append((int(a), rank, int(b), c))
    return out
