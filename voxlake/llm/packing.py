"""Packing of documents into sequences of a fixed number of tokens, by hierarchical best fit.

1. Each document's ids, with an end after them, are cut into pieces of at most ``CAPACITY``. What is written, and all that
   moves from here on, is a row of numbers for each piece.
2. Pieces are dealt by hash over nodes of some ``NODE_PIECES``, so that each node has a fair share of all lengths, wherever
   in the input the long ones stand. A node packs its pieces by best fit, longest first, and emits the bins
   with less than ``NEARLY`` tokens left.
3. Underfull bins are items of the next round: ``FAN`` nodes become one, which packs their underfull bins by best fit
   again, until there is one node. After a round no two bins of a node fit together, so all but one of them are over
   half full, and a round can join no more than ``FAN`` pairs: a node passes on its ``CARRIED`` emptiest bins, which is
   more than any later round can use, and emits the others. So no task grows with the input.

Pieces stay where they are; the few bins that were joined are told by a join of their numbers.

Defined results: a null or empty text is one end; repeated rows, and rows with a null id, are documents each; an empty table gives no
rows; documents are cut only where they are longer than a sequence; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import chunks as C
from . import words

CAPACITY, END = 4096, 1
NODE_PIECES, LEAST_PIECES = 1 << 16, 1 << 12
NEARLY, FAN, CARRIED = 64, 32, 4096
SLICE_BYTES = 2 << 20


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For items that come longest first: the bin and the place in it of each, and what each bin has left.

    Bins wait in a list for each number of tokens left; the bits of one integer say which of these lists have any.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins, places, left = 0, [], [], []
    for size in sizes:
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins.append(b)
        places.append(capacity - room)
        left[b] = room = room - size
        if room:
            waiting[room].append(b)
            some |= 1 << room
    return bins, places, left


def token_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """row (a number of its own for each document), the id, piece, start, length, ids_crc32, and with_ids the piece's ids."""
    shared = docs.sparkSession.sparkContext.broadcast(words.read_file(path))
    names = ["row", id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, row = words.Words(shared.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            for lo, hi in A.slices(offsets, SLICE_BYTES):
                found, at = coder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                size = np.diff(at)
                to = np.cumsum(size + 1)
                ids = np.full(int(to[-1]), end, "<u4")
                ids[A.ragged(to - size - 1, size)] = found
                count = -(-(size + 1) // capacity)
                own = np.repeat(np.arange(hi - lo), count)
                piece = A.ragged(np.zeros(hi - lo, np.int64), count)
                start = piece * capacity
                length = np.minimum(capacity, (size + 1)[own] - start)
                a = (to - size - 1)[own] + start
                sums = [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                columns = [pa.array(row + own), batch.column(0).take(pa.array(own + lo)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                if with_ids:  # a document's pieces follow each other, and so do the documents
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, to[-1]), pa.int32()), pa.array(ids.view("<i4"), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                row += hi - lo
        A.trim()

    rows = docs.select(docs[id_col], docs[text_col].cast("string").alias("__text"))
    return rows.mapInArrow(run, f"row long, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, node_pieces: int = NODE_PIECES, fan: int = FAN, nearly: int = NEARLY, carried: int = CARRIED) -> DataFrame:
    """The rows of pieces (row, piece, length from 1 to capacity, and any other columns), which must be the same each time they are read, with sequence_id and offset."""
    spark, total = pieces.sparkSession, pieces.count()
    nodes = max(1, -(-total // node_pieces), min(C.partitions(spark), -(-total // LEAST_PIECES)))
    dealt = pieces.withColumn("node", F.pmod(F.xxhash64("row", "piece"), F.lit(nodes)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long, fill int"

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        bins, places, left = best_fit(table.column("length").to_pylist(), capacity)
        base = key[0].as_py() << 32
        out = [table.append_column("sequence_id", pa.array(np.array(bins, np.int64) + base)).append_column("offset", pa.array(places, pa.int64())).append_column("fill", pa.nulls(len(table), pa.int32()))]
        left = np.array(left)
        up = np.flatnonzero(left >= nearly)
        up = up[np.argsort(-left[up], kind="stable")][:carried]  # the others can't be needed
        told = {"node": pa.array(np.full(len(up), key[0].as_py(), np.int32)), "sequence_id": pa.array(up + base), "fill": pa.array(capacity - left[up], pa.int32())}
        out.append(pa.table({f.name: told.get(f.name, pa.nulls(len(up), f.type)) for f in out[0].schema}, schema=out[0].schema))
        return pa.concat_tables(out)

    # each node's rows, and rows with a fill for its underfull bins
    packed = C.written(dealt.groupBy("node").applyInArrow(first, schema))
    own = "array<struct<sequence: bigint, shift: bigint>>"
    open_ = packed.where("fill is not null").select("node", "sequence_id", "fill", F.array(F.struct(F.col("sequence_id").alias("sequence"), F.lit(0).cast("long").alias("shift"))).cast(own).alias("held"))

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The bins of some nodes after best fit, and whether they go on to the next round."""
        rows = sorted(table.to_pylist(), key=lambda r: (-r["fill"], r["sequence_id"]))
        bins, places, left = best_fit([r["fill"] for r in rows], capacity)
        out = [{"node": key[0].as_py(), "sequence_id": None, "fill": capacity - x, "held": []} for x in left]
        for r, b, place in zip(rows, bins, places, strict=True):
            if not place:
                out[b]["sequence_id"] = r["sequence_id"]
            out[b]["held"] += [{"sequence": h["sequence"], "shift": h["shift"] + place} for h in r["held"]]
        out.sort(key=lambda r: (r["fill"], r["sequence_id"]))
        kept = 0
        for r in out:
            r["up"] = capacity - r["fill"] >= nearly and kept < carried
            kept += r["up"]
        kinds = [("node", pa.int32()), ("sequence_id", pa.int64()), ("fill", pa.int32()), ("held", pa.list_(pa.struct([("sequence", pa.int64()), ("shift", pa.int64())]))), ("up", pa.bool_())]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    done = open_.limit(0)
    while nodes > 1:
        nodes = -(-nodes // fan)
        level = open_.withColumn("node", F.floor(F.col("node") / fan).cast("int"))
        level = C.written(level.groupBy("node").applyInArrow(merge, f"node int, sequence_id long, fill int, held {own}, up boolean"))
        done = done.unionByName(level.where("not up" if nodes > 1 else "true").drop("up"))
        open_ = level.where("up").drop("up")
    moved = done.where("size(held) > 1").select(F.col("sequence_id").alias("__to"), F.explode("held").alias("h")).select("__to", F.col("h.sequence").alias("sequence_id"), F.col("h.shift").alias("__shift"))
    names = [f"`{c}`" for c in pieces.columns]
    joined = packed.where("fill is null").join(moved, "sequence_id", "left")
    return joined.select(*names, F.coalesce("__to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("__shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **more: int) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = C.written(token_pieces(docs, path, id_col=id_col, text_col=text_col, capacity=capacity))
    return pack(pieces, capacity=capacity, **more).drop("row")


def sequences(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **more: int) -> DataFrame:
    """sequence_id, ids (array<int>) and doc_ids, in their places: what a trainer reads."""
    pieces = C.written(token_pieces(docs, path, id_col=id_col, text_col=text_col, capacity=capacity, with_ids=True))
    placed = pack(pieces.select("row", "piece", "length"), capacity=capacity, **more)
    rows = pieces.join(placed.drop("length"), ["row", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", F.col(id_col).alias("id")))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.id").alias("doc_ids"))
