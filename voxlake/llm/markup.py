"""A page's tags in one pass: no byte is read again however quotes and brackets are left open.

A tag ends at the first ``>`` outside quotes. Where no such end follows, as a quote is left open, it ends at its first ``>``, and where there is
none, the page ends with it. The first tag without an end makes a table of where a tag would end from every quote
and bracket of the page, in quotes or out of them; all later tags look it up. Comments and elements whose content is no markup are one item each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

#: Elements whose content is not read as markup.
RAW = frozenset("script style noscript template iframe svg textarea title xmp noembed".split())

_TAG = re.compile(r"<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
_NAME = re.compile(r"<(/?)([a-z][^\s/>]*+)", re.I)
_MARKS = re.compile(r"[>\"']")
_ENDS = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")


class Ends:
    """Where a tag that is open at some place ends."""

    def __init__(self, page: str):
        self.at = [m.start() for m in _MARKS.finditer(page)]
        plain = double = single = -1  # ends from after a mark, by what is open there
        self.plain = [-1] * len(self.at)
        for k in range(len(self.at) - 1, -1, -1):
            c = page[self.at[k]]
            if c == ">":
                plain = self.at[k]
            elif c == '"':
                plain, double = double, plain
            else:
                plain, single = single, plain
            self.plain[k] = plain

    def after(self, place: int) -> int:
        k = bisect_left(self.at, place)
        return self.plain[k] if k < len(self.at) else -1


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it is an end tag, attributes) of all markup; what is dropped has no name."""
    at, ends = 0, None
    while (lt := page.find("<", at)) >= 0:
        m = _TAG.match(page, lt) if ends is None else _NAME.match(page, lt)
        if m is None and ends is None and (m := _NAME.match(page, lt)):
            ends = Ends(page)
        if m is None:
            at = lt + 1
            if page.startswith("<!--", lt):
                at = page.find("-->", lt + 4)
                at = len(page) if at < 0 else at + 3
                yield lt, at, "", False, ""
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = page.find(">", lt) + 1 or len(page)
                yield lt, at, "", False, ""
            continue
        name, attrs, at = m[2].lower(), None, m.end()
        if m.re is _TAG:
            attrs = m[3]
        elif (to := ends.after(at)) >= 0:
            attrs, at = page[at:to], to + 1
        else:
            at = page.find(">", at) + 1 or len(page)
        if attrs is None:
            yield lt, at, "", False, ""
            continue
        if not m[1] and name in RAW and not (name == "svg" and attrs.endswith("/")):
            found = _ENDS[name].search(page, at)
            at, name = found.end() if found else len(page), ""
        yield lt, at, name, bool(m[1]), attrs


def attributes(attrs: str) -> Iterator[tuple[str, str]]:
    """Names in small letters, and values ("" where there is none)."""
    for m in _ATTR.finditer(attrs):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""
