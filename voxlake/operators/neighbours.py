"""The nearest other vector by cosine, exactly, comparing only cells that the triangle inequality can't rule out.

Vectors of length 1 are counted once each, however many rows share one. Each goes to the nearest of some pivots (one for each ``BLOCK`` vectors, at most ``PIVOTS``, the first by hash) and, by its
distance from it, to a band: a cell. A cell first finds its vectors' nearest within one of its own blocks; the worst of these is as far as its search has to
reach. Another cell is compared only if it can hold a vector so near: pivots are a distance apart, and a cell's vectors no further from its pivot than its
band's end, nor nearer than its begin. Cells are at most PIVOTS times the bands, so which meet is decided from a small table; what meets are blocks of at most ``BLOCK`` vectors,
as a product of the partitions they are read in: a vector stands on disk as often as it is written, not once for each pair.

How much this saves depends on the data: vectors in clusters meet few cells, vectors without any structure in many dimensions meet them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.storage import written

PIVOTS, BAND, BLOCK = 128, 0.1, 1024
#: Rows that a task keeps of what its blocks have found.
HELD = 1 << 20
#: What rounding may cost a distance of vectors of length 1.
SLACK = 1e-6


class Found(NamedTuple):
    """found: key, other cosine and mark, one row for each vector that has another; compared: blocks that met, and whole: that all would have made."""

    found: DataFrame
    compared: int
    whole: int


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.values).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best(a: np.ndarray, keys: np.ndarray, b: np.ndarray, others: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector of a the greatest cosine (to 8 decimals) to one of b with another key, the least mark of those that have it, and whether there is any."""
    cos = np.round(a @ b.T, 8)
    cos[keys[:, None] == others[None, :]] = -2
    top = cos.max(axis=1)
    mark = np.where(cos == top[:, None], marks[None, :], np.iinfo(np.int64).max).min(axis=1)
    return top, mark, top > -2


def foremost(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of each key the greatest cosine and, of equals, the least mark."""
    keys, cosine, mark = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((mark, -cosine, keys))
    own = order[np.diff(keys[order], prepend=keys[order[:1]] - 1) != 0]
    return keys[own], cosine[own], mark[own]


def nearest(vectors: DataFrame, *, pivots: int = PIVOTS, band: float = BAND, block: int = BLOCK) -> Found:
    """vectors: key (long, one for each vector), mark (long), v (array<double> of length 1). Of equal cosines, to 8 decimals, the least mark counts."""
    spark = vectors.sparkSession
    pivots = min(pivots, max(1, vectors.count() // block))  # a cell without many vectors makes more work than it saves
    chosen = vectors.orderBy(F.xxhash64("key"), "key").limit(pivots).select("v").collect()
    p = np.array([r.v for r in chosen], float)
    if not len(p):
        return Found(spark.createDataFrame([], "key long, cosine double, mark long"), 0, 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cos = matrix(batch.column(2)) @ p.T
                own = cos.argmax(axis=1)
                far = np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(own)), own], 0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(np.floor(far / band), pa.int32())], names=["key", "mark", "v", "pivot", "band"])

    placed = written(vectors.select("key", "mark", "v").mapInArrow(place, "key long, mark long, v array<double>, pivot int, band int"))
    counts = placed.groupBy("pivot", "band").agg(F.count("*").alias("n"))
    number = placed.join(F.broadcast(counts), ["pivot", "band"]).withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / block)).cast("int"))
    blocks = written(number.groupBy("pivot", "band", "block").agg(F.collect_list(F.struct("key", "mark", "v")).alias("m")).select("pivot", "band", "block", F.col("m.key").alias("key"), F.col("m.mark").alias("mark"), F.flatten("m.v").alias("v")))
    schema = "key long, cosine double, mark long"

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                keys, marks, v = (np.array(batch.column(c)[row].values) for c in ("key", "mark", "v"))
                v = v.reshape(len(keys), -1)
                top, mark, any_ = best(v, keys, v, keys, marks)
                place = [pa.array(np.full(len(keys), batch.column(c)[row].as_py()), pa.int32()) for c in ("pivot", "band")]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.where(any_, top, -2.0)), pa.array(mark), *place], names=["key", "cosine", "mark", "pivot", "band"])

    inside = written(blocks.mapInArrow(within, f"{schema}, pivot int, band int"))
    cells = inside.groupBy("pivot", "band").agg(F.min("cosine").alias("worst")).join(blocks.groupBy("pivot", "band").agg(F.count("*").alias("blocks")), ["pivot", "band"]).collect()
    at = np.array([(r.pivot, r.band) for r in cells])
    reach = np.sqrt(np.maximum(2 - 2 * np.maximum(np.array([r.worst for r in cells]), -1), 0)) + SLACK
    lo, hi = at[:, 1] * band, (at[:, 1] + 1) * band
    apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[at[:, 0][:, None], at[:, 0][None, :]]
    # from a vector of the first cell, at lo to hi from its pivot, to one of the second
    least = np.maximum(apart - hi[:, None] - hi[None, :], np.maximum(lo[None, :] - hi[:, None] - apart, lo[:, None] - hi[None, :] - apart))
    a, b = np.nonzero(least <= reach[:, None])
    sizes = np.array([r.blocks for r in cells], np.int64)
    compared, whole = int((sizes[a] * sizes[b]).sum()), int(sizes.sum() ** 2)
    # a cell's number, and those of the cells that it meets: blocks are compared where they are read, so no vector is shuffled
    partners = pa.ListArray.from_arrays(pa.array(np.searchsorted(a, np.arange(len(cells) + 1)), pa.int32()), pa.array(b, pa.int32()))
    table = spark.createDataFrame(pa.table({"pivot": pa.array(at[:, 0], pa.int32()), "band": pa.array(at[:, 1], pa.int32()), "cell": pa.array(np.arange(len(cells)), pa.int32()), "meets": partners}))
    numbered = blocks.join(F.broadcast(table), ["pivot", "band"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for row in range(len(batch)):
                keys, v, others, marks, w = (np.array(batch.column(c)[row].values) for c in ("key", "v", "key2", "mark2", "v2"))
                top, mark, any_ = best(v.reshape(len(keys), -1), keys, w.reshape(len(others), -1), others, marks)
                held.append((keys[any_], top[any_], mark[any_]))
                rows += len(held[-1][0])
                if rows > HELD:
                    held = [foremost(held)]
                    rows = len(held[0][0])
                    if 2 * rows > HELD:  # as many vectors: what is held would not shrink
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["key", "cosine", "mark"])
                        held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in foremost(held)], names=["key", "cosine", "mark"])

    first = numbered.select("meets", F.col("cell").alias("cell1"), F.col("block").alias("block1"), "key", "v")
    second = numbered.select("cell", "block", F.col("key").alias("key2"), F.col("mark").alias("mark2"), F.col("v").alias("v2"))
    pairs = first.join(second, F.array_contains("meets", F.col("cell")) & ((F.col("cell1") != F.col("cell")) | (F.col("block1") != F.col("block"))))
    met = pairs.select("key", "v", "key2", "mark2", "v2").mapInArrow(meet, schema)
    every = inside.select("key", "cosine", "mark").where("cosine > -2").unionByName(met)
    return Found(every.groupBy("key").agg(F.max(F.struct("cosine", (-F.col("mark")).alias("m"))).alias("x")).select("key", "x.cosine", (-F.col("x.m")).alias("mark")), compared, whole)
