"""Byte-level BPE encoding and decoding by a two-tier lookup.

Texts are cut into pre-tokens by whole-array steps (``pretokens``); a batch's distinct ones are looked up.
Tier one: a minimal perfect hash over the vocabulary (hash and displace: one displacement
for each small bucket of keys) resolves those that are vocabulary entries; the entry's bytes are compared, so no
other string passes. Tier two: a miss merges its linked bytes, the lowest rank first and then the
leftmost, from a heap of possible merges; stale heap entries are skipped.

Merged pre-tokens are kept in the worker process in a bounded table (tokens.Known). Nothing is
shuffled. The hash is built once, on the driver, and broadcast as arrays; the size of the vocabulary is
checked against ``VOCAB_BYTES``. The library only says, on the driver, which class each code point is in.

Defined results: null and empty texts have no ids and decode to nothing; repeated rows are
encoded each; other columns are ignored. Every byte is a vocabulary entry, so every
text can be encoded and the round trip is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from . import pretokens
from .tokens import Known

VOCAB_BYTES = 64 << 20


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def hash_keys(keys: list[bytes]) -> np.ndarray:
    offsets = np.zeros(len(keys) + 1, np.int64)
    np.cumsum([len(k) for k in keys], out=offsets[1:])
    return A.hash_rows(np.frombuffer(b"".join(keys), np.uint8), offsets)


class PerfectHash:
    """A minimal perfect hash: n keys onto the slots 0..n-1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = len(keys)
        self.buckets = max(1, self.n // per_bucket)
        h = hash_keys(keys)
        if len(np.unique(h)) != self.n:
            raise ValueError("two keys have the same 64-bit hash")
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.uint64)
        free = np.ones(self.n, bool)
        tries = np.arange(1 << 16, dtype=np.uint64)
        for b in np.argsort(-np.diff(first), kind="stable").tolist():
            own = h[order[first[b] : first[b + 1]]]
            if not len(own):
                break
            start = 0
            while True:
                # 256 displacements at a time, then ever more
                d = tries[:256] + np.uint64(start) if start < 4096 else tries + np.uint64(start)
                slots = self._slot(own[None, :], d[:, None])
                good = free[slots].all(axis=1)
                if len(own) > 1:
                    s = np.sort(slots, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    self.shift[b] = d[k]
                    free[slots[k]] = False
                    break
                start += len(d)
        self.keys: list[bytes] = [b""] * self.n
        for key, s in zip(keys, self._slot(h, self.shift[bucket]).tolist(), strict=True):
            self.keys[s] = key

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (A.mix(h + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """Each key's slot, or -1."""
        if not keys or not self.n:
            return [-1] * len(keys)
        h = hash_keys(keys)
        mine = self.keys
        return [s if mine[s] == k else -1 for k, s in zip(keys, self._slot(h, self.shift[self._bucket(h)]).tolist(), strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A piece's ids: linked bytes, merged lowest rank first."""
    n = len(piece)
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    get = ranks.get
    heap = [(r << 48) | (i << 24) | (i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None] if n < 1 << 24 else [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    wide = n >= 1 << 24
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, end = (top[1], top[2]) if wide else ((top >> 24) & 0xFFFFFF, top & 0xFFFFFF)
        mid = after[i]
        if mid < 0 or mid >= n or after[mid] != end:
            continue
        after[i], after[mid], before[end] = end, -1, i
        if end < n and (r := get(piece[i : (e := after[end])])) is not None:
            heappush(heap, (r, i, e) if wide else (r << 48) | (i << 24) | e)
        if (p := before[i]) >= 0 and (r := get(piece[p:end])) is not None:
            heappush(heap, (r, p, end) if wide else (r << 48) | (p << 24) | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def matches(pattern: str, text: str) -> str:
    """The characters of text that match, by the library's regex engine."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    return bytes(tiktoken.Encoding(f"class {pattern}", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)).decode()


class Codec:
    """Encodes texts, as bytes and offsets, to ids and back. Built on the driver; workers get its arrays."""

    def __init__(self, content: bytes):
        ranks = read_ranks(content)
        self.words = PerfectHash(list(ranks))
        self.slot_ids = np.array([ranks[k] for k in self.words.keys], np.uint32)
        pieces = [b""] * (max(ranks.values()) + 1)
        for k, r in ranks.items():
            pieces[r] = k
        self.piece_size = np.array(list(map(len, pieces)), np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.classes = pretokens.classes(matches)
        self.prepare()

    def prepare(self) -> None:
        self.ranks = dict(zip(self.words.keys, self.slot_ids.tolist(), strict=True))
        self.table = pretokens.read_classes(self.classes)
        self.known = Known()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "table", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.prepare()

    def ids_of(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' ids, one after another, and how many each has."""
        slot = np.array(self.words.find(tokens), np.int64)
        size = np.ones(len(tokens), np.int64)
        missed = np.flatnonzero(slot < 0).tolist()
        known, ranks = self.known, self.ranks
        for t in known.missing([tokens[k] for k in missed]):
            known[t] = np.array(merge(t, ranks), "<u4").tobytes()
        found = [known[tokens[k]] for k in missed]
        size[missed] = [len(x) // 4 for x in found]
        start = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.uint32)
        hit = slot >= 0
        ids[start[hit]] = self.slot_ids[slot[hit]]
        ids[A.ragged(start[missed], size[missed])] = np.frombuffer(b"".join(found), "<u4")
        return ids, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids and where each row's begin (n + 1)."""
        d = pretokens.Distinct(data, offsets, self.table)
        ids, size = self.ids_of(d.tokens)
        start = np.cumsum(size) - size
        count = size[d.which]
        first = np.concatenate([[0], np.cumsum(count)])[d.first]
        return ids[A.ragged(start[d.which], count)].astype("<u4"), first

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return self.piece_bytes[A.ragged(self.piece_start[ids], self.piece_size[ids])]

    def decoded_offsets(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.piece_size[ids])])[first]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The file's codec; built once in the driver's process."""
    with open(path, "rb") as f:
        content = f.read()
    if len(content) > VOCAB_BYTES:
        raise ValueError(f"the vocabulary has {len(content)} bytes; at most {VOCAB_BYTES} are broadcast")
    key = hashlib.sha256(content).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content)
    return _codecs[key]


def _slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs [lo, hi) of a column's texts of at most limit bytes together, with their bytes and offsets."""
    data, offsets = A.utf8(column)
    for lo, hi in A.slices(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """The columns named in keep, and the text's ids as array<int>; with check, n_tokens and whether decoding the ids gives the text back (exact)."""
    shared = docs.sparkSession.sparkContext.broadcast(codec(path))
    names = [c for c in keep if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for lo, hi, data, offsets in _slices(batch.column(len(names))):
                ids, first = c.encode(data, offsets)
                rows = batch.slice(lo, hi - lo)
                more = []
                if check:
                    back, at = c.decode(ids), c.decoded_offsets(ids, first)
                    same = np.array_equal(back, data) and np.array_equal(at, offsets)
                    exact = np.full(hi - lo, True) if same else np.array([np.array_equal(back[a:b], data[x:y]) for a, b, x, y in zip(at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True)])
                    more = [pa.array(np.diff(first), pa.int64()), pa.array(exact)]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names))), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.view("<i4"), pa.int32())), *more], names=[*names, ids_col, *(["n_tokens", "exact"] if check else [])])
        A.trim()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*(docs[c] for c in names), docs[text_col].cast("string").alias("__text")).mapInArrow(run, f"{schema}, `{ids_col}` array<int>" + ", n_tokens long, exact boolean" * check)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and the bytes that an array of ids stands for (binary; null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec(path))
    names = [c for c in keep if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            out = [b"" if ids is None else c.decode(np.array(ids, "<u4")).tobytes() for ids in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(out, pa.binary())], names=[*names, out_col])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)
    return encoded.select(*(encoded[c] for c in names), encoded[ids_col].cast("array<int>").alias("__ids")).mapInArrow(run, f"{schema}, `{out_col}` binary")


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's digests, of the ids and of the bytes that they decode to, without sending either through Spark."""
    shared = docs.sparkSession.sparkContext.broadcast(codec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for lo, hi, data, offsets in _slices(batch.column(1)):
                ids, first = c.encode(data, offsets)
                back, at = c.decode(ids), c.decoded_offsets(ids, first)
                digest = lambda x, k: [hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(k[:-1].tolist(), k[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array(digest(ids, first), pa.string()), pa.array(digest(back, at), pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        A.trim()

    rows = docs.select(docs[id_col], docs[text_col].cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


__all__ = ["Codec", "PerfectHash", "decode", "encode", "merge", "round_trip"]
