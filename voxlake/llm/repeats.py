"""Exact removal of repeated substrings by prefix-free parsing.

Parse: the rolling hash of ``ANCHOR`` bytes is taken everywhere; in every stretch of
``LENGTH`` bytes the position of the least hash is a trigger. (A trigger where the hash is 0
modulo p would leave stretches without any; the least hash leaves none.) All stretches with one
trigger form a phrase: the text from the first one's start to the last one's end. Phrases thus
overlap so that every stretch of LENGTH bytes lies within exactly one, and equal stretches have
equal triggers at the same place. A text is a sequence of phrases (the parse); the distinct
phrases are the dictionary.

Combination: a stretch's first start in the corpus follows from the order of its phrase's
occurrences (the parse, in the order of doc_id and place) and from the order of the dictionary's
suffixes. Suffixes need to be told apart only up to LENGTH bytes:

1. Each chunk sends, for each of its distinct phrases, the trigger's hash, the phrase's hash,
   its first document, and four bytes each for the text left and right of the trigger. All phrases
   with one trigger meet in a part. A phrase that occurred earlier is removed whole; one whose trigger
   nobody else shares, or shares without an equal side, stays whole; the rest are open.
2. For open phrases alone a chunk builds the suffix array of its dictionary, by prefix doubling
   on ranks of 8, 16, 32, 64 and LENGTH bytes (bytes are compared here, not hashes), keeps the first of
   equal suffixes in corpus order, and asks about each once. A part orders the chunks' suffixes by
   the document they first start in; all but the first are removed.

What is sent is a few bytes per 35 bytes of text and never the text. A trigger, phrase or
suffix comes from a chunk at most once however often it occurs there, so a group of
copies or a common passage loads a part with one entry for each chunk, or for each different surrounding.
Hashes have 64 bits: phrases are told apart by two (trigger and phrase), suffixes in
different chunks by their own and half of their trigger's.

Defined results: null text is empty; texts of under LENGTH bytes lose nothing; a null id comes before any other;
of rows that share an id one is earlier (by chunk and place), so one of equal rows stays; other
columns are carried only if named in keep. Removed bytes may cut a character in two: kept is binary, and
kept_text drops the halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import chunks as C

LENGTH, ANCHOR = 100, 32
PART_BYTES = 64 << 20


def triggers(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of all phrases in corpus order: first start, last start, trigger hash, phrase hash, hashes (four bytes each) left and right of the trigger."""
    reach, side = length - anchor + 1, (length - anchor) // 2
    found: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, np.ndarray]] = []
    for lo, hi in A.slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= A.SLICE_BYTES:
            pieces.append((a, b, offsets[lo : hi + 1] - a))
        else:  # a long text, by parts that overlap by what a stretch reaches
            for p in range(a, b, A.SLICE_BYTES):
                e = min(b, p + A.SLICE_BYTES + length - 1)
                pieces.append((p, e, np.array([0, e - p])))
    for a, b, own in pieces:
        n = b - a
        if n < length:
            continue
        sums = A.prefix(A.BYTE_VALUES[data[a:b]])
        h = A.rolling(sums, anchor)
        key = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
        pad = -len(key) % reach
        grid = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, reach)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - length + 1
        least = np.minimum(behind[:count], ahead[reach - 1 : reach - 1 + count])
        # stretches that lie within one text
        inside = np.zeros(n + 1, np.int32)
        size = np.diff(own)
        long = size >= length
        np.add.at(inside, own[:-1][long], 1)
        np.add.at(inside, own[1:][long] - length + 1, -1)
        start = np.flatnonzero(np.cumsum(inside[:count]) > 0)
        if not len(start):
            continue
        trigger = (least[start] & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(trigger, prepend=-1))
        s0, t = start[first], trigger[first]
        s1 = start[np.append(first[1:], len(start)) - 1]
        row = np.searchsorted(own, s0, "right") - 1
        left = A.span(sums, np.maximum(t - side, own[row]), t)
        right = A.span(sums, t + anchor, np.minimum(t + anchor + side, own[row + 1]))
        # the trigger's hash is small, being the least; mixed, it spreads over the parts
        found.append((s0 + a, s1 + a, A.mix(h[t]), A.span(sums, s0, s1 + length), (left >> np.uint64(32)).astype(np.uint32), (right >> np.uint64(32)).astype(np.uint32)))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint32), z.astype(np.uint32)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Parse:
    """A chunk's phrases and its dictionary: the distinct ones, ordered by trigger and phrase hash, each at its first place."""

    def __init__(self, chunk: C.Chunk, length: int, anchor: int):
        self.chunk, self.length = chunk, length
        self.s0, self.s1, self.trigger, self.phrase, self.left, self.right = triggers(chunk.data, chunk.offsets, length, anchor)
        n = len(self.s0)
        order = np.lexsort((self.phrase, self.trigger))  # stable: equal phrases stay in corpus order
        new = np.ones(n, bool)
        new[1:] = (self.trigger[order][1:] != self.trigger[order][:-1]) | (self.phrase[order][1:] != self.phrase[order][:-1])
        self.entry = order[new]
        self.is_first = np.zeros(n, bool)
        self.is_first[self.entry] = True
        self.ids = chunk.ids[np.searchsorted(chunk.offsets, self.s0[self.entry], "right") - 1] if n else np.zeros(0, np.int64)


def suffixes(parse: Parse, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the stretches in these dictionary entries: start in the chunk, and whether an equal one starts earlier; in the order
    of their keys, the places of those that don't, their keys, and their triggers' hashes (four bytes)."""
    data, length = parse.chunk.data, parse.length
    own = np.sort(parse.entry[entries])  # corpus order
    if not len(own):
        z = np.zeros(0, np.int64)
        return z, z.astype(bool), z, z.astype(np.uint64), z.astype(np.uint32)
    size = parse.s1[own] - parse.s0[own] + length
    place = A.ragged(parse.s0[own], size)
    text = np.concatenate([data[place], np.zeros(length + 8, np.uint8)])
    n = len(place)
    rank = np.zeros(n, np.uint64)
    step = 1
    while step * 2 <= 8 and step * 2 <= length:
        step *= 2
    for k in range(step):
        rank = rank * np.uint64(256) + text[k : k + n]

    # a class of equal suffixes is known by the place of its first in the order; only classes of two or more are sorted further
    order = np.argsort(rank)
    x = rank[order]
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    count = np.diff(np.append(begin, n))
    rank = np.empty(n, np.uint64)
    rank[order] = np.repeat(begin, count)
    live = order[np.repeat(count > 1, count)]
    while step < length:
        jump = min(step, length - step)
        to = live + jump
        ahead = np.where(to < n, rank[np.minimum(to, n - 1)], 0)
        x = (rank[live] << np.uint64(32)) | ahead
        order = np.argsort(x)
        x, live = x[order], live[order]
        old = x >> np.uint64(32)
        fresh = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
        parent = np.concatenate([[True], old[1:] != old[:-1]]) if len(x) else np.zeros(0, bool)
        begin, top = np.flatnonzero(fresh), np.flatnonzero(parent)
        count = np.diff(np.append(begin, len(x)))
        rank[live] = old + np.repeat(begin, count).astype(np.uint64) - np.repeat(top, np.diff(np.append(top, len(x)))).astype(np.uint64)
        live = live[np.repeat(count > 1, count)]
        step += jump
    whole = np.repeat(np.cumsum(size), size) - np.arange(n) >= length  # suffixes with LENGTH bytes left in their phrase
    at = np.flatnonzero(whole)
    order = np.sort((rank[at] << np.uint64(32)) | at.astype(np.uint64))
    new = np.ones(len(order), bool)
    new[1:] = (order[1:] >> np.uint64(32)) != (order[:-1] >> np.uint64(32))
    first = np.sort((order[new] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    repeated = np.ones(n, bool)
    repeated[first] = False
    key = np.empty(n, np.uint64)
    for k in range(0, n, A.SLICE_BYTES):
        stop = min(n, k + A.SLICE_BYTES)
        key[k:stop] = A.rolling(A.prefix(A.BYTE_VALUES[text[k : stop + length - 1]]), length)
    second = np.repeat((parse.trigger[own] >> np.uint64(32)).astype(np.uint32), size)[first]
    key = key[first]
    order = np.lexsort((second, key))
    return place[at], repeated[at], np.searchsorted(at, first[order]), key[order], second[order]


STAYS, GONE, OPEN = 0, 1, 2


def judge_phrases(rows: list[dict]) -> Iterator[dict]:
    """For each phrase asked about: GONE, if it occurred earlier; OPEN, if another phrase with its trigger may share a stretch; else STAYS."""
    keys, (phrase, ids, left, right), source, ends = C.asked_of(rows, ["<u8", "<i8", "<u4", "<u4"])
    order = np.lexsort((source, ids, phrase, keys))
    k, p = keys[order], phrase[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    lead = order[first]
    is_open = np.zeros(len(keys), bool)
    for side in (left, right):
        o = lead[np.lexsort((side[lead], keys[lead]))]
        same = np.zeros(len(o), bool)
        equal = (keys[o][1:] == keys[o][:-1]) & (side[o][1:] == side[o][:-1])
        same[1:] |= equal
        same[:-1] |= equal
        is_open[o[same]] = True
    verdict = np.full(len(keys), GONE, np.uint8)
    verdict[lead] = np.where(is_open[lead], OPEN, STAYS)
    yield from C.answer(1, rows, ends, verdict)


def judge_suffixes(rows: list[dict]) -> Iterator[dict]:
    """For each suffix asked about: 1 if it starts earlier in another chunk."""
    keys, (ids, second), source, ends = C.asked_of(rows, ["<i8", "<u4"])
    order = np.lexsort((source, ids, second, keys))
    k, s = keys[order], second[order]
    again = np.zeros(len(k), np.uint8)
    again[1:] = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
    verdict = np.empty(len(keys), np.uint8)
    verdict[order] = again
    yield from C.answer(2, rows, ends, verdict)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), length: int = LENGTH, anchor: int = ANCHOR, chunk_bytes: int = C.CHUNK_BYTES, part_bytes: int = PART_BYTES, as_text: bool = False) -> DataFrame:
    """One row per document: the id, the columns named in keep, n_bytes, kept (binary), spans array<struct<start,end>> of removed bytes.

    With as_text, kept_text (string) stands in the place of kept: characters that a removed span cuts in two are left out whole.
    """
    keep = tuple(c for c in keep if c not in (id_col, text_col))
    table, parts = C.chunked(docs, text_col=text_col, id_col=id_col, keep=keep, chunk_bytes=chunk_bytes, part_bytes=part_bytes)

    def ask_phrases(chunk: C.Chunk) -> Iterator[dict]:
        p = Parse(chunk, length, anchor)
        e = p.entry
        yield from C.ask(p.trigger[e], [p.phrase[e], p.ids, p.left[e], p.right[e]], parts, chunk.number)

    verdicts = C.written(C.by_part(C.each_chunk(table, ask_phrases, C.ASKED, C.ASKED_ARROW), parts, judge_phrases))

    def opened(chunk: C.Chunk, got: dict[int, list[bytes]]):
        p = Parse(chunk, length, anchor)
        verdict = np.concatenate([C.unpack(b, "u1") for b in got.get(1, [])] or [np.zeros(0, np.uint8)])
        return p, verdict, *suffixes(p, np.flatnonzero(verdict == OPEN))

    def ask_suffixes(chunk: C.Chunk, got: dict[int, list[bytes]]) -> pa.Table:
        p, _, starts, _, firsts, key, second = opened(chunk, got)
        ids = chunk.ids[np.searchsorted(chunk.offsets, starts[firsts], "right") - 1] if len(firsts) else np.zeros(0, np.int64)
        rows = list(C.ask(key, [ids, second], parts, chunk.number))
        return pa.table({f.name: pa.array([r[f.name] for r in rows], f.type) for f in C.ASKED_ARROW})

    replies = C.written(C.by_part(C.with_answers(table, verdicts, ask_suffixes, C.ASKED), parts, judge_suffixes))
    kinds = [f"`k{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]

    def finish(chunk: C.Chunk, got: dict[int, list[bytes]]) -> pa.Table:
        p, verdict, starts, repeated, firsts, _, _ = opened(chunk, got)
        later = np.concatenate([C.unpack(b, "u1") for b in got.get(2, [])] or [np.zeros(0, np.uint8)])
        gone = repeated.copy()
        gone[firsts] |= later.astype(bool)
        whole = ~p.is_first
        whole[p.entry] |= verdict == GONE
        n = len(chunk.data)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, p.s0[whole], 1)
        np.add.at(edge, p.s1[whole] + length, -1)
        np.add.at(edge, starts[gone], 1)
        np.add.at(edge, starts[gone] + length, -1)
        removed = np.cumsum(edge[:n]) > 0
        a, b, first = A.runs(removed, chunk.offsets)
        base = np.repeat(chunk.offsets[:-1], np.diff(first))
        spans = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], names=["start", "end"]))
        left = chunk.data[~removed]
        cut = np.concatenate([[0], np.cumsum(~removed)])[chunk.offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(left.tobytes())]).cast(pa.binary())
        t = chunk.table
        return pa.table({"id": t.column("id"), **{f"k{i}": t.column(f"k{i}") for i in range(len(keep))}, "n_bytes": pa.array(np.diff(chunk.offsets)), **({"kept_text": readable(kept)} if as_text else {"kept": kept}), "spans": spans})

    schema = ", ".join(["id long", *kinds, "n_bytes long", "kept_text string" if as_text else "kept binary", "spans array<struct<start:bigint,end:bigint>>"])
    out = C.with_answers(table, verdicts.unionByName(replies), finish, schema)
    return out.select(F.col("id").alias(id_col), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "kept_text" if as_text else "kept", "spans")


def readable(kept: pa.Array) -> pa.Array:
    return pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from remove_repeats()'s."""
    return found.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The contract's rows, string by string; for tests. Rows with one id count in the order given."""
    import hashlib

    seen: set[bytes] = set()
    out = []
    for i in sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i)):
        t = (docs[i][1] or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((docs[i][0], len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
