"""Ids of a lower-casing word tokenizer (BPE with word ends), whose pieces never cross white space.

A text is cut at ASCII white space into words, none of whose ids depend on another word. A word of ASCII and
Latin-1 letters only is cut on into the tokenizer's own pre-tokens by whole-array steps; any other
word (another script, a special string) is given to the library as it stands. Each distinct string is encoded once for each
batch, and what a process has met before it knows: letters-only strings many at a time, as a piece that ends a word tells where each ends.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from . import arrays as A
from . import pretokens
from .tokens import Known

KNOWN, JOINED = 400_000, 256
LETTER, DIGIT, OTHER, SPACE, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[:128] = OTHER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_KIND[0x30:0x3A] = DIGIT
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def read_file(path: str) -> bytes:
    """The file's contents; a file of another kind is refused."""
    with open(path, "rb") as f:
        content = f.read()
    spec = json.loads(content)
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    pattern = cuts[0].get("pattern", {}).get("Regex")
    if steps != ["NFC", "Replace", "Lowercase"] or pattern != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" or spec["model"].get("end_of_word_suffix") != "</w>" or any(not t["content"].startswith("<|") or any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"]):
        raise ValueError(f"{path} is not a lower-casing word tokenizer")
    return content


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte."""
    kind = _KIND[data]
    if len(data) > 1:
        # the letters of Latin-1: C3 and one byte, but for the signs of multiplication and division
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[lead] = LETTER
        kind[lead + 1] = LETTER
        kind[np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))] = ODD  # special strings begin so
    return kind


def lowered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """data with the capitals of ASCII and Latin-1 in small letters, but for words with a byte of kind ODD: there the library must see what stands."""
    out = A.lower_ascii(data)
    for lo, hi in A.slices(offsets):
        a, b = offsets[lo], offsets[hi]
        own = data[a:b]
        if not (own >= 0x80).any() and not (own == 0x7C).any():
            continue
        kind = kinds(own)
        capital = np.flatnonzero((own[:-1] == 0xC3) & (own[1:] >= 0x80) & (own[1:] <= 0x9E) & (own[1:] != 0x97)) + 1
        out[a + capital] += 0x20
        odd = kind == ODD
        if odd.any():
            starts, ends, _ = A.runs(kind != SPACE, offsets[lo : hi + 1] - a)
            held = np.add.reduceat(odd, starts, dtype=np.int64) > 0
            place = A.ragged(starts[held], (ends - starts)[held])
            out[a + place] = own[place]
    return out


def cut(data: np.ndarray, offsets: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the strings to encode: a word with a byte of kind ODD as it stands, the pre-tokens of any other; data: as lowered() gives it."""
    kind = kinds(data)
    starts, ends, _ = A.runs(kind != SPACE, offsets)
    if not len(starts):
        return starts, ends
    odd = np.add.reduceat(kind == ODD, starts, dtype=np.int64)  # what lies between words is of kind SPACE
    size = ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    place = A.ragged(starts, size)
    own, byte = kind[place], data[place]
    first = np.cumsum(size) - size
    new = np.empty(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (own[1:] == DIGIT)
    new[first] = True
    # an apostrophe by itself takes the letters of a contraction
    quote = np.flatnonzero(new & np.append(new[1:], True) & (byte == 0x27))
    taken = np.zeros(len(quote), np.int64)
    for c in CONTRACTIONS:
        fits = taken == 0
        for j, x in enumerate(c):
            at = np.minimum(quote + 1 + j, len(own) - 1)
            fits &= (byte[at] == x) & (quote + 1 + j < len(own)) & (word[at] == word[quote])
        taken[fits] = len(c)
    quote, taken = quote[taken > 0], taken[taken > 0]
    new[quote + 1] = False
    after = quote + 1 + taken
    new[after[after < len(new)]] = True
    new &= odd[word] == 0
    new[first] = True
    begin = np.flatnonzero(new)
    return place[begin], place[np.append(begin[1:], len(new)) - 1] + 1


@functools.lru_cache(1)
class Words:
    """The tokenizer of a file's contents and what it has encoded; kept by the process."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(content)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = Known(KNOWN)

    def learn(self, strings: list[bytes]) -> None:
        plain, known = [], self.known
        for s in strings:
            if _PLAIN.fullmatch(s):
                plain.append(s)
            else:
                known[s] = np.array(self.library.encode(s.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        for k in range(0, len(plain), JOINED):
            part = plain[k : k + JOINED]
            ids = np.array(self.library.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            to = np.flatnonzero(self.ends[ids]) + 1
            if len(to) != len(part):
                raise ValueError("the tokenizer's pieces do not tell where words end")
            for s, a, b in zip(part, [0, *to.tolist()], to.tolist(), strict=False):
                known[s] = ids[a:b].tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids (uint32) and where each row's begin (n + 1)."""
        d = pretokens.Distinct(lowered(data, offsets), offsets, np.zeros(0), cut)
        self.learn(self.known.missing(d.tokens))
        found = [self.known[t] for t in d.tokens]
        size = np.array([len(x) // 4 for x in found], np.int64)
        ids = np.frombuffer(b"".join(found), "<u4")
        start, count = np.cumsum(size) - size, size[d.which]
        first = np.concatenate([[0], np.cumsum(count)])[d.first]
        return ids[A.ragged(start[d.which], count)].astype("<u4"), first
