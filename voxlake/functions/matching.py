"""Ratcliff/Obershelp similarity by suffix automata: the longest common block, then what is left and right of it, until nothing is common.

A block is found in time proportional to the pieces' lengths, by walking one piece through the automaton of the other, whose states know where they first end. Of equal blocks
the first in a counts, then the first in b. As in the method's common form, in a text b of 200 letters and more, letters that make up over a hundredth of it begin no block, but lengthen one.
"""

from __future__ import annotations

from collections import Counter

LONG, POPULAR = 200, 100


class Automaton:
    """All substrings of a sequence; a state's first is where its strings end first."""

    def __init__(self, items: list):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(items):
            new = self._state({}, self.size[last] + 1, at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            elif self.size[q := self.next[p][c]] == self.size[p] + 1:
                self.link[new] = q
            else:
                copy = self._state(dict(self.next[q]), self.size[p] + 1, self.first[q])
                self.link[copy] = self.link[q]
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = copy
                    p = self.link[p]
                self.link[q] = self.link[new] = copy
            last = new

    def _state(self, following: dict, size: int, first: int) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.size.append(size)
        self.first.append(first)
        return len(self.next) - 1

    def longest(self, items: list) -> tuple[int, int, int]:
        """(start in items, start in the automaton's sequence, length) of the longest common block."""
        state = length = 0
        best = (0, 0, 0)
        for at, c in enumerate(items):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            if length > best[2]:
                best = (at - length + 1, self.first[state] - length + 1, length)
        return best


def blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of all matching blocks, in order."""
    popular = {c for c, n in Counter(b).items() if n > len(b) // POPULAR + 1} if len(b) >= LONG else set()
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        al, ah, bl, bh = open_.pop()
        if al == ah or bl == bh:
            continue
        # a popular letter of b is like no letter of a
        theirs = b[bl:bh] if not popular else [(k, c) if c in popular else c for k, c in enumerate(b[bl:bh])]
        i, j, n = Automaton(theirs).longest(a[al:ah])
        i, j = al + i, bl + j
        while i > al and j > bl and a[i - 1] == b[j - 1] and (n or not popular):
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ah and j + n < bh and a[i + n] == b[j + n] and (n or popular):
            n += 1
        if n:
            out.append((i, j, n))
            open_ += [(al, i, bl, j), (i + n, ah, j + n, bh)]
    return sorted(out)


def ratio(a: str, b: str) -> float:
    """Twice the letters in matching blocks, over all letters; 1 for two empty texts."""
    return 2 * sum(n for _, _, n in blocks(a, b)) / (len(a) + len(b)) if a or b else 1.0
