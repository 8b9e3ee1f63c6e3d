"""Vectorised text primitives over Arrow buffers: slices of UTF-8 bytes, word bounds, rolling hashes.

Texts are handled as one byte array plus offsets, so a batch of documents costs a
fixed number of numpy passes. All hashes are polynomial, modulo 2**64, over a random
value for each byte; equal strings have equal hashes wherever they stand. Such hashes collide by structure
on strings of a thousand bytes and more, so words of over ``LONG`` bytes have a hash of another kind.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 17
LONG = 256
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20_240_101).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def trim() -> None:
    """Gives freed memory back to the system: workers live on after their tasks, and several share an executor's bound."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the base and of its inverse, kept for later calls up to a few slices."""
    if "up" in _powers and len(_powers["up"]) > n:
        return _powers["up"][: n + 1], _powers["down"][: n + 1]
    size = max(n + 1, 1 << 20)
    out = []
    for base in (_ODD, _INV):
        p = np.ones(size, np.uint64)
        p[1:] = np.uint64(base)
        out.append(np.multiply.accumulate(p))
    if size <= 4 << 20:
        _powers["up"], _powers["down"] = out
    return out[0][: n + 1], out[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    y = x >> np.uint64(33)
    y ^= x
    y *= np.uint64(0xFF51AFD7ED558CCD)
    y ^= y >> np.uint64(33)
    y *= np.uint64(0xC4CEB9FE1A85EC53)
    y ^= y >> np.uint64(33)
    return y


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(large)
    if column.null_count:
        column = pc.fill_null(column, b"" if large == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of rows of at most limit bytes together; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of inside that cross no row, and each row's first run (n + 1)."""
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(inside)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[(last >= 0) & (offsets[1:] > offsets[:-1])]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(values: np.ndarray) -> np.ndarray:
    """The prefix sums from which span() reads hashes; values: uint64."""
    _, down = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[:-1], out=out[1:])
    return out


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end), equal for equal contents."""
    up, _ = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * up[ends] ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words_hash(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span() of words, but a digest of those of over LONG bytes."""
    out = span(sums, starts, ends)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def rolling(sums: np.ndarray, width: int) -> np.ndarray:
    """span() of every stretch of one width."""
    up, _ = powers(len(sums))
    x = sums[width:] - sums[:-width]
    x *= up[width : len(sums)]
    x ^= np.uint64(width * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    return mix(x)


def hash_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash for each row."""
    out = np.empty(len(offsets) - 1, np.uint64)
    for lo, hi in slices(offsets):
        a, b = offsets[lo], offsets[hi]
        own = offsets[lo : hi + 1] - a
        out[lo:hi] = words_hash(data[a:b], prefix(BYTE_VALUES[data[a:b]]), own[:-1], own[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the stretches, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)
