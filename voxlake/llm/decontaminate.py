"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

Each window of ``window`` consecutive item words is a pattern (a shorter item is one
pattern). Patterns of one length form a group. For a group of length m, a shift table
over hashed blocks of two words (one word when m is 1) says how far a search may jump:
m - 1 where a block is in no pattern, less otherwise. The search reads the block
that ends at its position and jumps by the shift. Where the shift is zero, the block is the suffix
of some patterns, its bucket; within the bucket, ordered by the hash of the words before the block, a binary search
selects the patterns that may stand here, and a direct comparison of the words' bytes confirms it. The
search advances many stretches of text at a time, a numpy step for all of them.

A group is a few arrays: the items' lower-cased bytes, their words' bounds, and for each distinct pattern its place, its
two hashes and its items; about ``BYTES_PER_BYTE`` bytes for a byte of benchmark text in all.

Skew and bounds: no shuffle. The patterns are broadcast in blocks of about
``block_bytes`` of benchmark text; the documents pass through one map for each block and are
written in between, so a benchmark of any size works and neither a broadcast, nor the driver's memory, nor the
number of a task's Python workers grows with it.

Defined results: null or empty text has no words and is clean; repeated rows and ties in
doc_id are independent rows; an empty benchmark leaves every document clean; null
item_ids take no part in the list of items but their windows do count as hits; other
columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import chunks as C

WINDOW = 10
BLOCK_BYTES, BYTES_PER_BYTE = 16 << 20, 20
LANE_WORDS = 96
_WORD = np.ones(256, bool)
_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends of words; each row's first word."""
    low = A.lower_ascii(data)
    return low, *A.runs(_WORD[low], offsets)


def mixed(hashes: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """A hash of each run of count words that begins at at."""
    out = np.zeros(len(at), np.uint64)
    for j in range(count):
        out = A.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[at + j])
    return out


class Words:
    """Lower-cased bytes, the words' bounds and hashes, and each row's first word (n + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low, starts, ends, first = [], [], [], [np.zeros(1, np.int64)]
        hashes, count = [], 0
        for lo, hi in A.slices(offsets):
            a, b = offsets[lo], offsets[hi]
            part, s, e, f = words_of(data[a:b], offsets[lo : hi + 1] - a)
            hashes.append(A.words_hash(part, A.prefix(A.BYTE_VALUES[part]), s, e))
            low.append(part)
            starts.append(s + a)
            ends.append(e + a)
            first.append(f[1:] + count)
            count += len(s)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.low, self.starts, self.ends, self.hashes, self.first = join(low, np.uint8), join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64), join(first, np.int64)


def same_words(one: Words, at: np.ndarray, two: Words, place: np.ndarray, count: int) -> np.ndarray:
    """Whether the count words that begin at at in one are those that begin at place in two, byte by byte."""
    ok = np.ones(len(at), bool)
    for j in range(count):
        live = np.flatnonzero(ok)
        a, b = at[live] + j, place[live] + j
        size = one.ends[a] - one.starts[a]
        equal = size == two.ends[b] - two.starts[b]
        live, a, b, size = live[equal], a[equal], b[equal], size[equal]
        ok[:] = False
        if not len(live):
            break
        differ = one.low[A.ragged(one.starts[a], size)] != two.low[A.ragged(two.starts[b], size)]
        wrong = np.add.reduceat(differ.astype(np.int64), np.cumsum(size) - size)
        ok[live[wrong == 0]] = True
    return ok


class Group:
    """Patterns of one length: their shift table and suffix buckets."""

    def __init__(self, length: int, words: Words, at: np.ndarray, item: np.ndarray):
        self.length, self.block = m, b = length, min(2, length)
        suffix, prefix = mixed(words.hashes, at + m - b, b), mixed(words.hashes, at, m - b)
        order = np.lexsort((at, prefix, suffix))
        at, item, prefix, suffix = at[order], item[order], prefix[order], suffix[order]
        # equal windows are one pattern; of windows with equal hashes, those unlike the first stand alone
        new = np.ones(len(at), bool)
        new[1:] = (suffix[1:] != suffix[:-1]) | (prefix[1:] != prefix[:-1])
        odd = np.flatnonzero(~same_words(words, at, words, at[np.flatnonzero(new)[np.cumsum(new) - 1]], m))
        new[odd] = True
        new[odd[odd + 1 < len(new)] + 1] = True
        owned = np.unique((np.cumsum(new) - 1) * np.int64(1 << 31) + item)
        self.owner = (owned & ((1 << 31) - 1)).astype(np.int32)
        self.owned = np.append(np.searchsorted(owned >> 31, np.arange(int(new.sum()))), len(owned))
        self.at, self.prefix = at[new], prefix[new]
        self.suffix, self.first = np.unique(suffix[new], return_index=True)
        self.first = np.append(self.first, len(self.at))
        self.bits = np.uint64(64 - max(10, min(22, int(np.ceil(np.log2(4 * len(at) * m + 1))))))
        self.shift = np.full(1 << (64 - int(self.bits)), m - b + 1, np.int32)
        for j in range(m - b + 1):
            np.minimum.at(self.shift, self.slot(words.hashes, at + j), m - b - j)

    def slot(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The shift table's entry of the block that begins at at."""
        x = hashes[at]
        if self.block == 2:
            x = A.mix(x) + hashes[at + 1]
        return (A.mix(x) >> self.bits).astype(np.int64)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of first words, and the range of patterns [lo, hi) whose hashes stand there. first: rows' first words."""
        m, b = self.length, self.block
        count = np.diff(first)
        # Lanes of start positions: a row of n words has n - m + 1 of them.
        starts = np.maximum(count - m + 1, 0)
        lanes = -(-starts // LANE_WORDS)
        row = np.repeat(np.arange(len(count)), lanes)
        nth = A.ragged(np.zeros(len(count), np.int64), lanes)
        at = first[row] + nth * LANE_WORDS
        stop = np.minimum(at + LANE_WORDS, first[row] + starts[row])
        found: list[np.ndarray] = []
        while len(at):
            jump = self.shift[self.slot(hashes, at + m - b)]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        if not len(at):
            return at, at, at
        suffix = mixed(hashes, at + m - b, b)
        bucket = np.minimum(np.searchsorted(self.suffix, suffix), len(self.suffix) - 1)
        at, bucket = at[self.suffix[bucket] == suffix], bucket[self.suffix[bucket] == suffix]
        prefix = mixed(hashes, at, m - b)
        ends = []
        for after in (False, True):  # the bounds of equal prefixes within each bucket, halving all ranges at once
            lo, hi = self.first[bucket].copy(), self.first[bucket + 1].copy()
            while (lo < hi).any():
                mid = (lo + hi) // 2
                x = self.prefix[np.minimum(mid, len(self.prefix) - 1)]
                up = (lo < hi) & ((x <= prefix) if after else (x < prefix))
                lo, hi = np.where(up, mid + 1, lo), np.where(up, hi, mid)
            ends.append(lo)
        hit = ends[0] < ends[1]
        return at[hit], ends[0][hit], ends[1][hit]


class Tables:
    """What is broadcast of a block of items: their words, the groups and the item ids."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        data, offsets = A.utf8(pa.array([t or "" for _, t in items], pa.string()))
        self.words = Words(data, offsets)
        count = np.diff(self.words.first)
        length = np.minimum(count, window)
        patterns = np.where(count > 0, count - length + 1, 0)
        item = np.repeat(np.arange(len(items)), patterns)
        at = A.ragged(self.words.first[:-1], patterns)
        self.groups = [Group(m, self.words, at[own], item[own]) for m in np.unique(length[count > 0]).tolist() for own in [length[item] == m]]


def match(tables: Tables, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Of each row: the number of words, the occurrences as (first word, length), the items that occur."""
    n = len(offsets) - 1
    counts = np.zeros(n, np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    for lo, hi in A.slices(offsets):
        a, b = offsets[lo], offsets[hi]
        words = Words(data[a:b], offsets[lo : hi + 1] - a)
        counts[lo:hi] = np.diff(words.first)
        if not len(words.starts):
            continue
        for g in tables.groups:
            at, begin, end = g.search(words.hashes, words.first)
            if not len(at):
                continue
            k = A.ragged(begin, end - begin)
            here = np.repeat(at, end - begin)
            ok = same_words(words, here, tables.words, g.at[k], g.length)
            here, k = here[ok], k[ok]
            rows = np.searchsorted(words.first, here, "right") - 1
            for row, p in {*zip(rows.tolist(), k.tolist(), strict=True)}:
                items[lo + row].update(tables.ids[i] for i in g.owner[g.owned[p] : g.owned[p + 1]].tolist() if tables.ids[i] is not None)
            here, once = np.unique(here, return_index=True)
            for row, i in zip(rows[once].tolist(), here.tolist(), strict=True):
                spans[lo + row].append((i - int(words.first[row]), g.length))
    return counts, spans, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, any columns named in keep, n_words, hits array<struct<first,n_words>> (occurrences), items array<string>."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kept = [docs[id_col], *(docs[c] for c in keep if c not in (id_col, text_col))]
    names = [id_col, *(c for c in keep if c not in (id_col, text_col))]
    out = docs.select(*kept, docs[text_col].cast("string").alias("__text"), F.lit(0).cast("long").alias("__words"), F.expr("cast(array() as array<struct<first:bigint,n_words:bigint>>)").alias("__hits"), F.expr("cast(array() as array<string>)").alias("__items"))
    schema = out.schema
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        tables = spark.sparkContext.broadcast(Tables([(r.i, r.t) for r in part.toLocalIterator()], window))

        def scan(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = A.utf8(batch.column("__text"))
                counts, spans, found = match(tables.value, data, offsets)
                columns = {c: batch.column(c) for c in batch.schema.names}
                columns["__words"] = pa.array(counts, pa.int64())
                kind = batch.schema.field("__hits").type
                if any(spans):
                    columns["__hits"] = pa.array([(o or []) + [{"first": a, "n_words": b} for a, b in s] if s else o for o, s in zip(columns["__hits"].to_pylist(), spans, strict=True)], kind)
                    columns["__items"] = pa.array([sorted({*(o or []), *f}) for o, f in zip(columns["__items"].to_pylist(), found, strict=True)], batch.schema.field("__items").type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in batch.schema.names], schema=batch.schema)

        out = out.mapInArrow(scan, schema)
        if block < blocks - 1:  # passes in one task would each hold a Python worker
            out = C.written(out)
    return out.select(*names, *([F.col("__text").alias(text_col)] if text_col in keep else []), F.col("__words").alias("n_words"), F.col("__hits").alias("hits"), F.col("__items").alias("items"))


def hit_words() -> F.Column:
    """How many words lie in one of ``hits``, counted over the union of the spans."""
    return F.expr(
        "aggregate(array_sort(hits), named_struct('n', 0L, 'to', 0L), (s, h) -> named_struct('n', s.n + greatest(0L, h.first + h.n_words - greatest(h.first, s.to)), 'to', greatest(s.to, h.first + h.n_words)), s -> s.n)"
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from decontaminate()'s."""
    return found.select(
        id_col, "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract's rows for (doc_id, text) and (item_id, text), word by word; for tests."""
    import re

    cut = lambda t: [] if t is None else re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower())
    wins = [(str(i), {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))}) for i, t in items if (w := cut(t))]
    out = []
    for doc_id, text in docs:
        w, hit, own = cut(text), set(), set()
        for i, patterns in wins:
            for p in patterns:
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        own.add(i)
                        hit.update(range(k, k + len(p)))
        out.append((doc_id, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out
