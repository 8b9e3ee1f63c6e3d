"""Pre-tokens of byte-level BPE, cut from UTF-8 bytes by whole-array steps.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Characters
fall into four classes: white space, letters, numbers and others. A text is a sequence of runs of one class;
the pattern's matches follow from the runs:

- a run of white space at the end of a text is one pre-token. Before another run its last character is left
  over: a space joins the next run's pre-token, any other character is a pre-token of its own;
- any other run is one pre-token, with the space before it, but an apostrophe that is a run by itself and has no
  space before it takes one or two letters of the next run if they are one of the contractions.

The classes are those of the library whose results are wanted: ``classes`` asks its regex engine once for
each code point, on the driver, and the table of 1.1 MB goes to the workers compressed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import zstandard

from . import arrays as A

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: What an apostrophe takes with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def classes(matches: Callable[[str, str], str]) -> bytes:
    """The class of each code point, compressed; matches(pattern, text) gives the characters of text that match."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = "".join(matches(pattern, points[k : k + 10_000]) for k in range(0, len(points), 10_000))
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return zstandard.compress(table.tobytes())


def read_classes(content: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(content), np.uint8)


def _characters(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Where characters begin (None: at every byte), and their classes."""
    if not len(data) or data.max() < 0x80:
        return None, table[data]
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[at].astype(np.uint32)
    point = first.copy()
    for low, count, mask in ((0xC0, 1, 0x1F), (0xE0, 2, 0x0F), (0xF0, 3, 0x07)):
        own = np.flatnonzero((first >= low) & (first < (0xE0, 0xF0, 0x100)[count - 1]))
        if len(own):
            x = first[own] & mask
            for k in range(1, count + 1):
                x = (x << 6) | (data[at[own] + k] & 0x3F)
            point[own] = x
    return at, table[point]


def cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of all pre-tokens of the rows; a row's are those that start within it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, kind = _characters(data, table)
    n = len(kind)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    rows = rows if at is None else np.searchsorted(at, rows)
    new[rows] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    what = kind[begin]
    apart = np.zeros(n + 1, bool)
    apart[rows] = True
    apart[n] = True
    followed = ~apart[end]  # by a run of the same row
    byte = (lambda k: data[k]) if at is None else (lambda k: data[at[k]])

    blank = what == SPACE
    split = blank & followed
    ends_in_space = byte(end - 1) == 0x20
    joins = split & ends_in_space
    spaced = np.zeros(len(begin), bool)
    spaced[1:] = joins[:-1]
    # letters that an apostrophe takes from the run after it
    taken = np.zeros(len(begin), np.int64)
    quote = np.flatnonzero((what == OTHER) & (end - begin == 1) & followed & ~spaced & (byte(begin) == 0x27))
    if len(quote):
        quote = quote[what[quote + 1] == LETTER]
        b, size = begin[quote + 1], end[quote + 1] - begin[quote + 1]
        one, two = byte(b), byte(np.minimum(b + 1, n - 1))
        for c in CONTRACTIONS:
            raw = c.encode()
            taken[quote[(one == raw[0]) & (size >= len(raw)) & ((len(raw) == 1) | (two == raw[-1]))]] = len(raw)
    given = np.zeros(len(begin), np.int64)
    given[1:] = taken[:-1]

    # of each run two pre-tokens at most: all but the last blank, and that one by itself; or the run
    starts = np.stack([np.where(blank, begin, begin - spaced + given), end - 1], axis=1)
    ends = np.stack([np.where(split, end - 1, end + taken), end], axis=1)
    there = np.stack([starts[:, 0] < ends[:, 0], split & ~ends_in_space], axis=1).ravel()
    starts, ends = starts.ravel()[there], ends.ravel()[there]
    if at is None:
        return starts, ends
    at = np.append(at, len(data))
    return at[starts], at[ends]


class Distinct:
    """The distinct pre-tokens of some rows, in the order of their hashes: their bytes; which of them each pre-token is; each row's first (n + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, cut=cut):
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in A.slices(offsets):
            a, b = offsets[lo], offsets[hi]
            part = data[a:b]
            starts, ends = cut(part, offsets[lo : hi + 1] - a, table)
            found.append((starts + a, ends + a, A.words_hash(part, A.prefix(A.BYTE_VALUES[part]), starts, ends)))
        starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.first = np.searchsorted(starts, offsets)
        _, lead, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        if not _same(data, starts, ends, lead[self.which]):  # two pre-tokens with one hash: told apart by their bytes
            seen: dict[bytes, int] = {}
            self.which = np.array([seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
            self.tokens = list(seen)
        else:
            raw = data.tobytes()
            self.tokens = [raw[s:e] for s, e in zip(starts[lead].tolist(), ends[lead].tolist(), strict=True)]


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> bool:
    """Whether each stretch has the bytes of its lead."""
    size = ends - starts
    if (size != size[lead]).any():
        return False
    for lo, hi in A.slices(np.concatenate([[0], np.cumsum(size)]), 1 << 20):
        own = np.flatnonzero(lead[lo:hi] != np.arange(lo, hi)) + lo
        if (data[A.ragged(starts[own], size[own])] != data[A.ragged(starts[lead[own]], size[own])]).any():
            return False
    return True
