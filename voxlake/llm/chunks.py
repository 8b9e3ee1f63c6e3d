"""Chunks of documents that ask the whole corpus about keys, and get answers in the order they asked.

A corpus-wide question such as "who else has this string" need not move texts. The
documents are written once, as chunks of bounded size, to a table bucketed by chunk, in the
shared checkpoint folder; every later pass reads a whole chunk in one task without a shuffle.
A pass may send packed arrays of 64-bit keys, cut by key into parts, as many as the size of all texts
needs; a part's task sees a key at most once from each chunk, whatever its frequency, so a hot key costs a chunk one
entry. It sends back arrays in the same order, which need no keys.

Beyond ``GROUPS`` parts the arrays of so many chunks and parts would be too many and too small, so they go by two
steps, each of the same size for a task: a chunk cuts its keys into GROUPS ranges; tasks merge a range's keys of some of the chunks and
cut them into parts; and the answers go back the same way. A chunk thus sends GROUPS arrays however large the corpus is.

The catalog forgets the table as soon as it is read; its files stay in the folder, whose cleaning is the cluster's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.storage import shared_folder

from . import arrays as A

CHUNK_BYTES = 8 << 20
#: Bytes of input files that a bucket is to have.
BUCKET_BYTES = 32 << 20
#: What a row counts for besides its text, so that a chunk's rows are bounded too.
ROW_BYTES = 16
GROUPS = 512
#: A row is known by its chunk (input partition and number) and its place in it.
PLACE_BITS, CHUNK_BITS, PARTITION_BITS = 23, 20, 20


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet files in the shared folder: computed once, safe from lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Parts(NamedTuple):
    """How keys are cut: into ``groups`` ranges, and each of these into ``per`` parts."""

    groups: int
    per: int

    @classmethod
    def of(cls, count: int) -> Parts:
        return cls(count, 1) if count <= GROUPS else cls(GROUPS, -(-count // GROUPS))

    @property
    def total(self) -> int:
        return self.groups * self.per


def read_bytes(df: DataFrame) -> int:
    """What the files that a plan reads have in all, without reading them; what is not known counts for nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def bucketed(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet files in the shared folder that are bucketed by chunk. A bucket is a task of every later pass, so buckets are as many as the input's size needs."""
    spark, name = df.sparkSession, f"voxlake_{uuid.uuid4().hex}"
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    buckets = min(most, max(8, 2 * partitions(spark), read_bytes(df) // BUCKET_BYTES))
    df.write.format("parquet").option("compression", "zstd").option("path", shared_folder(spark)).bucketBy(buckets, "chunk").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files are read by their place, not through the catalog
    return table


def chunked(docs: DataFrame, *, text_col: str, keep: tuple[str, ...] = (), id_col: str, chunk_bytes: int = CHUNK_BYTES, part_bytes: int) -> tuple[DataFrame, Parts]:
    """A table of chunk, seq (place in it), id (as long), text and the columns of keep as k0, k1, ..., bucketed by chunk; and how many parts of part_bytes of text there are, at least the shuffle partitions."""
    names = ["id", "text", *(f"k{i}" for i in range(len(keep)))]
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), *(docs[c].alias(f"k{i}") for i, c in enumerate(keep)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        if number >> PARTITION_BITS:
            raise ValueError(f"more than {1 << PARTITION_BITS} input partitions; read larger splits")
        chunk, held, seq = number << CHUNK_BITS, 0, 0
        for batch in batches:
            _, offsets = A.utf8(batch.column(1))
            offsets = offsets + ROW_BYTES * np.arange(len(offsets))
            lo = 0
            while lo < len(batch):
                hi = int(np.searchsorted(offsets, offsets[lo] + max(0, chunk_bytes - held), "right")) - 1
                if hi <= lo and held:
                    chunk, held, seq = chunk + 1, 0, 0
                    continue
                hi = min(max(hi, lo + 1), len(batch))
                if chunk >> CHUNK_BITS != number or seq + hi - lo > 1 << PLACE_BITS:
                    raise ValueError(f"an input partition has over {1 << CHUNK_BITS} chunks, or a chunk over {1 << PLACE_BITS} rows")
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, chunk)), pa.array(np.arange(seq, seq + hi - lo)), pa.array(np.diff(offsets[lo : hi + 1])), *part.columns], names=["chunk", "seq", "size", *names])
                held, seq, lo = held + int(offsets[hi] - offsets[lo]), seq + hi - lo, hi

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    table = bucketed(rows.mapInArrow(cut, f"chunk long, seq long, size long, {kinds}"))
    total = table.agg(F.sum("size")).first()[0] or 0
    return table.drop("size"), Parts.of(max(partitions(docs.sparkSession), -(-total // part_bytes)))


class Chunk:
    """One chunk's documents in the order of their ids (null first), then of their places."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").combine_chunks()
        none = np.asarray(ids.is_null())
        plain = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((table.column("seq").to_numpy(), plain, ~none))
        self.table = table.take(pa.array(order))
        self.number = table.column("chunk")[0].as_py() if len(table) else -1
        self.rids = (self.number << PLACE_BITS) + self.table.column("seq").to_numpy()
        #: For comparing: a null is less than any id.
        self.ids = np.where(none, np.iinfo(np.int64).min, plain)[order]
        self.data, self.offsets = A.utf8(self.table.column("text"))


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane, so that their leading zeros cost nothing."""
    return pack(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpack(blob, "u1").reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def key_parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted keys (parts + 1)."""
    edges = np.array([(k << 64) // parts for k in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def each_chunk(table: DataFrame, fn: Callable[[Chunk], Iterator[dict]], schema: str, kinds: pa.Schema) -> DataFrame:
    """fn's rows for every chunk."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            yield from _rows(fn(Chunk(pa.Table.from_batches(rows))), kinds)
        rows.clear()
        A.trim()

    return table.groupBy("chunk").applyInArrow(run, schema)


def _rows(rows: Iterator[dict], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    found = list(rows)
    yield pa.RecordBatch.from_pydict({f.name: pa.array([r.get(f.name) for r in found], f.type) for f in kinds}, schema=kinds)


ASKED = "part int, chunk long, keys binary, more binary"
ASKED_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])
ANSWERED = "kind int, part int, chunk long, answer binary"
ANSWERED_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("answer", pa.binary())])
#: Of a row that holds several chunks' entries: which chunk each is of.
_SOURCES = pa.field("sources", pa.binary())


def joined(blobs: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in blobs)


def parted(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _pack_sources(chunks: np.ndarray) -> bytes:
    names, which = np.unique(chunks, return_inverse=True)
    return joined([pack(names), pack(which.astype("<u4"))])


def _sources(row: dict, count: int) -> np.ndarray:
    """The chunk of each of a row's entries."""
    if row.get("sources") is None:
        return np.full(count, row["chunk"])
    names, which = parted(row["sources"])
    return unpack(names, "<i8")[unpack(which, "<u4")]


def _items(blob: bytes, count: int) -> np.ndarray:
    """A packed array whose kind is not known here, as items of its size."""
    raw = unpack(blob, "u1")
    return raw.reshape(count, -1).view(f"V{max(1, len(raw) // max(1, count))}").ravel() if count else raw[:0].view("V1")


def merged(asked: DataFrame, parts: Parts, ragged: bool = False) -> DataFrame:
    """What was asked, with a task for each part; rows with a negative chunk go to a group's first part. With ragged the last column is bytes, as many for each key as the column before it says (uint32)."""
    if parts.per == 1:
        return asked.withColumn("sources", F.lit(None).cast("binary")).repartitionById(parts.total, "part")

    def regroup(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["chunk"])
        out = [{**r, "part": r["part"] * parts.per} for r in rows if r["chunk"] < 0]
        rows = [r for r in rows if r["chunk"] >= 0]
        if rows:
            group, keys = rows[0]["part"], [unpack_keys(r["keys"]) for r in rows]
            chunks = np.repeat([r["chunk"] for r in rows], [len(k) for k in keys])
            blobs = [parted(r["more"]) for r in rows]
            columns = [np.concatenate(c) for c in zip(*([_items(x, len(k)) for x in (b[:-1] if ragged else b)] for b, k in zip(blobs, keys, strict=True)), strict=True)]
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")  # a chunk's equal keys stay in their order
            if ragged:
                size = columns[-1].view("<u4").astype(np.int64)
                body = np.concatenate([unpack(b[-1], "u1") for b in blobs])[A.ragged((np.cumsum(size) - size)[order], size[order])]
                place = np.concatenate([[0], np.cumsum(size[order])])
            keys, chunks, columns = keys[order], chunks[order], [c[order] for c in columns]
            edges = np.array([((group * parts.per + f) << 64) // parts.total for f in range(parts.per)], np.uint64)
            first = np.append(np.searchsorted(keys, edges), len(keys))
            for f in range(parts.per):
                own = slice(first[f], first[f + 1])
                if first[f + 1] > first[f]:
                    out.append({"part": group * parts.per + f, "chunk": key[0].as_py() % parts.per, "keys": pack_keys(keys[own]), "more": joined([pack(c[own]) for c in columns] + ([pack(body[place[own.start] : place[own.stop]])] if ragged else [])), "sources": _pack_sources(chunks[own])})
        yield from _rows(out, ASKED_ARROW.append(_SOURCES))
        rows.clear()
        A.trim()

    batch = F.when(F.col("chunk") < 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("chunk"), F.lit(parts.per)))
    slots = asked.withColumn("slot", (F.col("part") * parts.per + batch).cast("int")).repartitionById(parts.total, "slot")
    return slots.groupBy("slot").applyInArrow(regroup, f"{ASKED}, sources binary").repartitionById(parts.total, "part")


def by_part(asked: DataFrame, parts: Parts, fn: Callable[[list[dict]], Iterator[dict]], ragged: bool = False) -> DataFrame:
    """fn's answers for every part, given all that was asked of it. There are as many tasks as parts, so that tasks don't grow with the input."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: r["chunk"])
        yield from _rows(fn(rows), ANSWERED_ARROW.append(_SOURCES))
        rows.clear()
        A.trim()

    judged = merged(asked, parts, ragged).groupBy("part").applyInArrow(run, f"{ANSWERED}, sources binary")
    if parts.per == 1:
        return judged.drop("sources")

    def back(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["kind"], r["part"]))
        out = [{**r, "part": r["part"] // parts.per} for r in rows if r["sources"] is None]
        for kind in sorted({r["kind"] for r in rows if r["sources"] is not None}):
            own = [r for r in rows if r["kind"] == kind and r["sources"] is not None]
            chunks = [_sources(r, 0) for r in own]
            values = np.concatenate([_items(r["answer"], len(c)) for r, c in zip(own, chunks, strict=True)])
            chunks = np.concatenate(chunks)
            order = np.argsort(chunks, kind="stable")
            values, chunks = values[order], chunks[order]
            names, first = np.unique(chunks, return_index=True)
            for name, a, b in zip(names.tolist(), first, [*first[1:], len(chunks)], strict=True):
                out.append({"kind": kind, "part": own[0]["part"] // parts.per, "chunk": name, "answer": pack(values[a:b])})
        yield from _rows(out, ANSWERED_ARROW)
        rows.clear()
        A.trim()

    slot = F.floor(F.col("part") / parts.per) * parts.per + F.greatest(F.col("chunk"), F.lit(0))
    return judged.withColumn("slot", slot.cast("int")).repartitionById(parts.total, "slot").groupBy("slot").applyInArrow(back, ANSWERED)


def with_answers(table: DataFrame, answers: DataFrame, fn: Callable[[Chunk, dict[int, list[bytes]]], Iterator[pa.RecordBatch] | pa.Table], schema: str) -> DataFrame:
    """fn's table for every chunk and the answers to it, by kind, in the order of the parts."""

    def run(key: tuple[pa.Scalar, ...], mine: pa.Table, theirs: pa.Table) -> pa.Table:
        got: dict[int, list[bytes]] = {}
        for r in sorted(theirs.select(["kind", "part", "answer"]).to_pylist(), key=lambda r: (r["kind"], r["part"])):
            got.setdefault(r["kind"], []).append(r["answer"])
        out = fn(Chunk(mine), got)
        A.trim()
        return out

    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def ask(keys: np.ndarray, columns: list[np.ndarray], parts: Parts, number: int) -> Iterator[dict]:
    """Rows for each group of parts; keys are sorted."""
    edge = key_parts(keys, parts.groups)
    for p in range(parts.groups):
        a, b = edge[p], edge[p + 1]
        if b > a:
            yield {"part": p, "chunk": number, "keys": pack_keys(keys[a:b]), "more": joined([pack(c[a:b]) for c in columns])}


def asked_of(rows: list[dict], kinds: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """keys, columns, chunk of each entry, ends of the rows."""
    keys = [unpack_keys(r["keys"]) for r in rows]
    columns = [[unpack(x, kind) for x, kind in zip(parted(r["more"]), kinds, strict=True)] for r in rows]
    count = np.array([len(k) for k in keys])
    return np.concatenate(keys), [np.concatenate(c) for c in zip(*columns, strict=True)], np.concatenate([_sources(r, n) for r, n in zip(rows, count.tolist(), strict=True)]), np.cumsum(count)


def answer(kind: int, rows: list[dict], ends: np.ndarray, values: np.ndarray) -> Iterator[dict]:
    for r, part in zip(rows, np.split(values, ends[:-1]), strict=True):
        yield {"kind": kind, "part": r["part"], "chunk": r["chunk"], "answer": pack(part), "sources": r.get("sources")}
