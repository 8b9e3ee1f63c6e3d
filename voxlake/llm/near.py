"""N-gram Jaccard join with Bayesian candidate pruning.

A text's shingles are its runs of ``WORDS`` lower-cased words (a shorter text is one shingle). Two
texts are linked if the Jaccard similarity of their sets of shingles is at least
``THRESHOLD``. The result has for each document its class (connected component of the links)
and its number of links; pairs are never listed.

1. Texts with equal sets become one, with a count: chunks ask about fingerprints of their sets.
2. MinHash bands of ``PER_BAND`` values find who may be linked. Whoever shares a band's key is tied to
   the key's least member, so a key of n members gives n ties, and the ties' components
   hold every pair that shares a band. A pair at the threshold shares none of ``BANDS``
   with probability (1 - THRESHOLD**PER_BAND)**BANDS, below one in a million.
3. Within a component, pairs that share a band (or all pairs, where those would be no more, or are few) are compared by ever more MinHash values. Under a uniform prior the
   similarity of a pair that agrees on m of n values is Beta(m + 1, n - m + 1); once the
   probability of reaching the threshold is below ``TOLERANCE`` the pair is dropped. The pairs
   that remain are verified exactly on their sets of shingles (64-bit hashes).

Skew: a component of more than ``TILE`` distinct texts is dealt into tiles by hash, and each pair of
tiles is a group of its own; what leaves a task is one row per text and tile pair (its links,
a spanning tree's root). A text is sent once from its chunk and repeated for its tile pairs by Spark, row by
row. Groups are dealt to as many slots as their texts' bytes need (``SLOT_BYTES`` each). The work on a group of n
near copies, all different, is still n**2 / 2 comparisons, as counting their links needs, and their texts
are sent n / TILE times; both are spread over tasks and bounded in memory.

Defined results: null texts and texts without words have no links and a class of their own; a null id comes
before any other; rows that share an id are rows of their own; class_id is the least id of the class; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import chunks as C
from .decontaminate import words_of

WORDS, THRESHOLD = 5, 0.8
BANDS, PER_BAND = 36, 5
STEP, TOLERANCE = 36, 1e-9
CHUNK_BYTES, PART_BYTES = 4 << 20, 256 << 20
TILE, SLOT_BYTES = 1024, 16 << 20
FEW = 128
_NONE = np.iinfo(np.int64).min
_rng = np.random.default_rng(9)
_MULTIPLY = _rng.integers(0, 1 << 32, BANDS * PER_BAND, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, BANDS * PER_BAND, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, and where they begin (n + 1)."""
    values, counts = [], []
    for lo, hi in A.slices(offsets):
        a, b = offsets[lo], offsets[hi]
        low, starts, ends, first = words_of(data[a:b], offsets[lo : hi + 1] - a)
        h = A.words_hash(low, A.prefix(A.BYTE_VALUES[low]), starts, ends)
        n = np.diff(first)
        size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        at = A.ragged(first[:-1], size)
        doc = np.repeat(np.arange(hi - lo), size)
        x = np.zeros(len(at), np.uint64)
        for k in range(words):
            x = np.where(k < n[doc], A.mix(x * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + k, max(0, len(h) - 1))]), x)
        order = np.lexsort((x, doc))
        x, doc = x[order], doc[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
        values.append(x[new])
        counts.append(np.bincount(doc[new], minlength=hi - lo))
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return (np.concatenate(values) if values else np.zeros(0, np.uint64)), first.astype(np.int64)


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (rows x BANDS * PER_BAND) of non-empty sets."""
    out = np.empty((len(first) - 1, BANDS * PER_BAND), np.uint32)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + 50_000, "right")) - 1)
        hi = min(hi, len(out))
        x = (values[first[lo] : first[hi]] >> np.uint64(32)).astype(np.uint32)
        at = first[lo:hi] - first[lo]
        for k in range(BANDS * PER_BAND):
            h = (x ^ _XOR[k]) * _MULTIPLY[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[lo:hi, k] = np.minimum.reduceat(h, at)
        lo = hi
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each row and band."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, np.uint64)
        for k in range(b * PER_BAND, (b + 1) * PER_BAND):
            x = A.mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
        out[:, b] = x
    return out


def least_matches(threshold: float, steps: tuple[int, ...], tolerance: float) -> list[int]:
    """For each number n of values compared, the fewest agreements that keep a pair: P(similarity >= threshold) >= tolerance."""
    out = []
    for n in steps:
        total, m = 0.0, -1
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


class Sets:
    """A chunk's distinct sets of shingles, ordered by fingerprint; each stands for its rows."""

    def __init__(self, chunk: C.Chunk, words: int):
        self.values, self.first = shingles(chunk.data, chunk.offsets, words)
        n = np.diff(self.first)
        self.rows = np.flatnonzero(n)
        at = self.first[:-1][self.rows]
        one, two = ((np.add.reduceat(A.mix(self.values ^ np.uint64(s)), at) if len(at) else np.zeros(0, np.uint64)) for s in (0, 0x1234567))
        order = np.lexsort((np.arange(len(at)), n[self.rows], two, one))
        o, t, c = one[order], two[order], n[self.rows][order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        self.lead = self.rows[order[new]]
        self.keys, self.second, self.count = o[new], t[new], c[new]
        self.times = np.diff(np.append(np.flatnonzero(new), len(o)))
        #: For each row with shingles, which distinct set is its.
        self.which = np.empty(len(o), np.int64)
        self.which[order] = np.cumsum(new) - 1


def judge_sets(rows: list[dict]) -> Iterator[dict]:
    """For each set asked about: the first row that has it (2), that row's id (3), how many rows have it (4)."""
    keys, (second, count, ids, rids, times), _, ends = C.asked_of(rows, ["<u8", "<i8", "<i8", "<i8", "<i8"])
    order = np.lexsort((rids, ids, count, second, keys))
    k, s, c = keys[order], second[order], count[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (c[1:] != c[:-1])
    group, lead = np.cumsum(new) - 1, order[new]
    total = np.add.reduceat(times[order], np.flatnonzero(new))
    for kind, values in ((2, rids[lead]), (3, ids[lead]), (4, total)):
        out = np.empty(len(keys), np.int64)
        out[order] = values[group]
        yield from C.answer(kind, rows, ends, out)


def components(edges: DataFrame) -> DataFrame:
    """v, root (the component's least vertex) for every vertex of edges (a, b), by alternating large and small stars."""

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = C.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        e = C.written(small.where("a <> b").distinct())
        if (now := state(e)) == was:
            break
        was = now
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def _band_edges(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties (a, b) of all that was asked of a part; rows with a negative chunk hold a chunk's own ties."""
    rows = [r for b in batches for r in b.to_pylist()]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in rows:
        if r["chunk"] < 0:
            a.append(C.unpack(r["keys"], "<i8"))
            b.append(C.unpack(r["more"], "<i8"))
    rows = [r for r in rows if r["chunk"] >= 0]
    if rows:
        keys, (rids,), _, _ = C.asked_of(rows, ["<i8"])
        order = np.lexsort((rids, keys))
        k, v = keys[order], rids[order]
        first = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0)
        root = np.repeat(v[first], np.diff(np.append(first, len(k))))
        tied = root != v
        a.append(v[tied])
        b.append(root[tied])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def sharing(keys: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The pairs (i, j) of set numbers that share a band, within left or between left and right; None if going through them band by band is no less than all pairs, or the sets are few."""
    both = left if right is None else np.concatenate([left, right])
    if len(both) <= FEW:
        return None
    n, m = len(left), len(both)
    most = n * (n - 1) // 2 if right is None else n * len(right)
    order = np.argsort(keys[both], axis=0, kind="stable")
    found, total = [], 0
    for band in range(keys.shape[1]):
        at = order[:, band]
        x = keys[both[at], band]
        begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        size = np.diff(np.append(begin, m))
        begin, size = begin[size > 1], size[size > 1]
        total += int((size * (size - 1) // 2).sum())
        if total > most:
            return None
        # each member with all that stand behind it in its group
        member = A.ragged(begin, size)
        behind = np.repeat(begin + size, size) - member - 1
        p, q = at[np.repeat(member, behind)], at[A.ragged(member + 1, behind)]
        p, q = np.minimum(p, q), np.maximum(p, q)
        if right is not None:
            ok = (p < n) & (q >= n)
            p, q = p[ok], q[ok]
        found.append(p * m + q)
    pairs = np.unique(np.concatenate(found))
    return both[pairs // m], both[pairs % m]


def linked(values: np.ndarray, first: np.ndarray, sig: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float, needs: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of verified pairs (i, j) of set numbers: within left, or between left and right."""
    if (pairs := sharing(keys, left, right)) is not None:
        step = 4 << 20
        blocks = ((pairs[0][k : k + step], pairs[1][k : k + step]) for k in range(0, len(pairs[0]), step))
    else:
        blocks = all_pairs(left, right)
    size = np.diff(first)
    for i, j in blocks:
        # sizes alone bound the similarity
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = small >= threshold * large
        i, j = i[ok], j[ok]
        agree, done = np.zeros(len(i), np.int64), 0
        for n, least in needs:
            if not len(i):
                break
            for c in range(0, len(i), 100_000):
                s = slice(c, c + 100_000)
                agree[s] += (sig[i[s], done:n] == sig[j[s], done:n]).sum(axis=1)
            done = n
            ok = agree >= least
            i, j, agree = i[ok], j[ok], agree[ok]
        if not len(i):
            continue
        common = _common(values, first, i, j)
        ok = common >= threshold * (size[i] + size[j] - common) - 1e-12
        yield i[ok], j[ok]


def all_pairs(left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    other = left if right is None else right
    block = max(1, min(len(left), (4 << 20) // max(1, len(other) * STEP)))
    for k in range(0, len(left), block):
        mine = left[k : k + block]
        if right is None:
            i, j = np.nonzero(np.arange(k, k + len(mine))[:, None] < np.arange(len(other))[None, :])
        else:
            i, j = (x.ravel() for x in np.meshgrid(np.arange(len(mine)), np.arange(len(other)), indexing="ij"))
        yield mine[i], other[j]


def _common(values: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact sizes of the pairs' intersections."""
    if len(i) < 200:
        cut = lambda x: values[first[x] : first[x + 1]]
        return np.array([len(np.intersect1d(cut(a), cut(b), assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    size = np.diff(first)[rows]
    at = A.ragged(first[:-1][rows], size)
    _, column, times = np.unique(values[at], return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), size)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = back[: len(i)], back[len(i) :]
    ua, ia = np.unique(a, return_inverse=True)
    ub, ib = np.unique(b, return_inverse=True)
    total = np.zeros((len(ua), len(ub)), np.float32)
    width = max(256, (8 << 20) // max(1, len(rows)))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s = slice(*np.searchsorted(column, [c, c + width]))
        m = np.zeros((len(rows), width), np.float32)
        m[row[s], column[s] - c] = 1
        total += m[ua] @ m[ub].T
    return total[ia, ib].astype(np.int64)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES, tile: int = TILE, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """One row per document: the id, the columns named in keep, class_id, n_links (long), is_first (true for one row of each class)."""
    wanted = [c for c in keep if c != id_col]
    keep = tuple(c for c in wanted if c != text_col)
    table, parts = C.chunked(docs, text_col=text_col, id_col=id_col, keep=keep, chunk_bytes=chunk_bytes, part_bytes=part_bytes)
    bare = table.select("chunk", "seq", "id", "text")
    steps = tuple(range(STEP, BANDS * PER_BAND + 1, STEP))
    needs = list(zip(steps, least_matches(threshold, steps, tolerance), strict=True))

    def ask_sets(chunk: C.Chunk) -> Iterator[dict]:
        s = Sets(chunk, words)
        yield from C.ask(s.keys, [s.second, s.count.astype("<i8"), chunk.ids[s.lead], chunk.rids[s.lead], s.times.astype("<i8")], parts, chunk.number)

    answers = C.written(C.by_part(C.each_chunk(bare, ask_sets, C.ASKED, C.ASKED_ARROW), parts, judge_sets))
    whole = lambda got, kind: np.concatenate([C.unpack(b, "<i8") for b in got.get(kind, [])] or [np.zeros(0, np.int64)])

    def ask_bands(chunk: C.Chunk, got: dict[int, list[bytes]]) -> pa.Table:
        s = Sets(chunk, words)
        mine = s.lead[whole(got, 2) == chunk.rids[s.lead]]
        size = np.diff(s.first)[mine]
        at = np.concatenate([[0], np.cumsum(size)])
        keys = band_keys(signatures(s.values[A.ragged(s.first[:-1][mine], size)], at)).ravel()
        rids = np.repeat(chunk.rids[mine], BANDS)
        order = np.lexsort((rids, keys))
        keys, rids = keys[order], rids[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.zeros(0, np.int64)
        root = np.repeat(rids[first], np.diff(np.append(first, len(keys))))
        own = np.unique(np.stack([rids[root != rids], root[root != rids]], axis=1), axis=0)
        rows = list(C.ask(keys[first], [rids[first]], parts, chunk.number))
        if len(own):
            rows.append({"part": chunk.number % parts.groups, "chunk": -1 - chunk.number, "keys": C.pack(own[:, 0]), "more": C.pack(own[:, 1])})
        return pa.table({f.name: pa.array([r[f.name] for r in rows], f.type) for f in C.ASKED_ARROW})

    ties = C.merged(C.with_answers(bare, answers.where("kind = 2"), ask_bands, C.ASKED), parts).groupBy("part").applyInArrow(_band_edges, "a long, b long")
    groups = components(ties)
    tiles = F.ceil(F.col("n") / tile).cast("int").alias("tiles")
    placed = groups.join(groups.groupBy("root").agg(F.count("*").alias("n")), "root").select("v", "root", tiles)

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        order = np.argsort(t.column("v").to_numpy())
        x = np.stack([t.column(c).to_numpy().astype(np.int64)[order] for c in ("v", "root", "tiles")])
        yield pa.RecordBatch.from_arrays([pa.array([5], pa.int32()), pa.array([0], pa.int32()), pa.array([key[0].as_py()], pa.int64()), pa.array([C.pack(x)], pa.binary())], schema=C.ANSWERED_ARROW)

    told = placed.withColumn("chunk", F.shiftright("v", C.PLACE_BITS)).groupBy("chunk").applyInArrow(gather, C.ANSWERED)
    sent = pa.schema([("root", pa.int64()), ("tile", pa.int32()), ("tiles", pa.int32()), ("v", pa.int64()), ("id", pa.int64()), ("times", pa.int64()), ("text", pa.string())])

    def send(chunk: C.Chunk, got: dict[int, list[bytes]]) -> pa.Table:
        x = np.concatenate([C.unpack(b, "<i8").reshape(3, -1) for b in got.get(5, [])] or [np.zeros((3, 0), np.int64)], axis=1)
        if not x.shape[1]:
            return sent.empty_table()
        s = Sets(chunk, words)
        lead = whole(got, 2)
        own = np.flatnonzero(lead == chunk.rids[s.lead])
        by = own[np.argsort(chunk.rids[s.lead[own]])]
        at = by[np.searchsorted(chunk.rids[s.lead[by]], x[0])]
        mine = A.mix(x[0].astype(np.uint64)) % x[2].astype(np.uint64)
        return pa.table([x[1], mine.astype(np.int32), x[2].astype(np.int32), x[0], chunk.ids[s.lead[at]], whole(got, 4)[at], chunk.table.column("text").take(pa.array(s.lead[at]))], schema=sent)

    paired = ["root", "i", "j", "tile", "v", "id", "times", "text"]

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).select(paired).sort_by([("root", "ascending"), ("i", "ascending"), ("j", "ascending"), ("v", "ascending")])
        n = len(t)
        values, first = shingles(*A.utf8(t.column("text")), words)
        sig = signatures(values, first)
        keys = band_keys(sig)
        root, i, j, mine, v, times = (t.column(c).to_numpy() for c in ("root", "i", "j", "tile", "v", "times"))
        links, up = np.zeros(n, np.int64), np.arange(n)

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        begin = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), n], strict=True):
            own = np.arange(a, b)
            left, right = (own, None) if i[a] == j[a] else (own[mine[a:b] == i[a]], own[mine[a:b] == j[a]])
            for p, q in linked(values, first, sig, keys, left, right, threshold, needs):
                np.add.at(links, p, times[q])
                np.add.at(links, q, times[p])
                # one tie for each new p is enough within a block unless it joins others
                for x, y in _forest(p, q):
                    x, y = top(x), top(y)
                    if x != y:
                        up[max(x, y)] = min(x, y)
        tops = np.array([top(x) for x in range(n)], np.int64) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(v), t.column("id").combine_chunks(), pa.array(links), pa.array(v[tops])], names=["v", "id", "links", "b"])

    members = C.written(C.with_answers(bare, answers.where("kind in (2, 4)").unionByName(told), send, "root long, tile int, tiles int, v long, id long, times long, text string"))
    total = members.agg(F.sum(F.col("tiles").cast("long") * (F.octet_length("text") + 64))).first()[0] or 0
    slots = max(parts.total, -(-total // slot_bytes))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = members.select("*", other).select("root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "v", "id", "times", "text")
    compared = C.written(pairs.withColumn("slot", F.pmod(F.xxhash64("root", "i", "j"), F.lit(slots)).cast("int")).repartitionById(slots, "slot").groupBy("slot").applyInArrow(compare, "v long, id long, links long, b long"))
    classes = components(compared.select(F.col("v").alias("a"), "b"))
    links = compared.groupBy("v").agg(F.first("id").alias("id"), F.sum("links").alias("links"))
    named = links.join(classes, "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = named.groupBy("root").agg(F.min(F.struct("id", "v")).alias("least"))
    result = named.join(least, "root").select(F.col("v").alias("lead"), "links", F.col("least.id").alias("class"), F.col("least.v").alias("class_row"))
    kinds = "".join(f", `k{k}` {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))

    def rows(chunk: C.Chunk, got: dict[int, list[bytes]]) -> pa.Table:
        s = Sets(chunk, words)
        lead, ids, times = chunk.rids.copy(), chunk.ids.copy(), np.ones(len(chunk.ids), np.int64)
        for out, kind in ((lead, 2), (ids, 3), (times, 4)):
            out[s.rows] = whole(got, kind)[s.which]
        t = chunk.table
        return pa.table({"id": t.column("id"), "rid": pa.array(chunk.rids), "lead": pa.array(lead), "own": pa.array(ids), "times": pa.array(times), **({"text": t.column("text")} if text_col in wanted else {}), **{f"k{k}": t.column(f"k{k}") for k in range(len(keep))}})

    all_rows = C.with_answers(table, answers, rows, f"id long, rid long, lead long, own long, times long{', text string' if text_col in wanted else ''}{kinds}")
    class_id = F.coalesce("class", "own")
    return all_rows.join(result, "lead", "left").select(
        F.col("id").alias(id_col),
        *(F.col("text" if c == text_col else f"k{keep.index(c)}").alias(c) for c in wanted),
        F.when(class_id != _NONE, class_id).alias("class_id"),
        (F.col("times") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        (F.coalesce("class_row", "lead") == F.col("rid")).alias("is_first"),
    )


def _forest(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ties that join what the pairs (p, q) join."""
    if len(p) < 1000:
        yield from zip(p.tolist(), q.tolist(), strict=True)
        return
    # each vertex takes the least one that it or a neighbour has, until nothing changes
    n = int(max(p.max(), q.max())) + 1
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, p, label[q])
        np.minimum.at(low, q, label[p])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(n))
    yield from zip(at.tolist(), label[at].tolist(), strict=True)


def brute_force(docs: list[tuple[int, str | None]], words: int = WORDS, threshold: float = THRESHOLD) -> list[tuple]:
    """(doc_id, class_id, n_links) by comparing all pairs; for tests."""
    import re

    sets = []
    for _, t in docs:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    n = len(docs)
    up, links = list(range(n)), [0] * n

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
                links[a] += 1
                links[b] += 1
                up[top(b)] = top(a)
    least: dict[int, int | None] = {}
    for x in range(n):
        i = docs[x][0]
        r = top(x)
        least[r] = i if r not in least or i is None or (least[r] is not None and i < least[r]) else least[r]
    return [(docs[x][0], least[top(x)], links[x]) for x in range(n)]
