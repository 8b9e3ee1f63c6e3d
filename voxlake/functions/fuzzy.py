"""String ratios by longest common subsequence: 2 * LCS / (sum of lengths), which is 1 less the normalised distance of insertions and deletions."""

from __future__ import annotations


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by a bit vector over a."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        x = row & masks.get(c, 0)
        row = (row + x | row - x) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text against a stretch of the longer one: all of its length, and the shorter ones at both ends."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    best = 0.0
    for start in range(1 - n, len(long)):
        part = long[max(0, start) : start + n]
        if 2 * min(n, len(part)) > best * (n + len(part)):
            best = max(best, ratio(short, part))
            if best == 1.0:
                break
    return best


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the words in common, and those with either text's other words; 1 if one text's words are all in the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, more_a, more_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not more_a or not more_b):
        return 1.0
    one, two = (" ".join(filter(None, (both, m))) for m in (more_a, more_b))
    return max(ratio(one, two), ratio(both, one) if both else 0.0, ratio(both, two) if both else 0.0)


def score(a: str, b: str) -> float:
    """max(token set, 0.85 partial) in 0..1; 0 if a text is empty."""
    return max(token_set_ratio(a, b), 0.85 * partial_ratio(a, b)) if a and b else 0.0
