"""Main-text extraction with site template removal.

Pass one parses each page, hashes the subtree of every container element, children first (its block
tags, its normalised text and its children's hashes), and counts, in Spark, on how many pages of a host each hash stands: a
task sums the counts of its batch before the shuffle, so a host with a third of all pages
sends one row for each batch and hash. Pass two parses again and leaves out subtrees that
recur on at least ``MIN_PAGES`` pages, however many the host has: a table that five pages of a large host quote is taken for
one too, where no article element holds it. By their
meaning, it leaves out menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, told by element and role, and containers also by whole names of class and id, within an
article only those of adverts and comments. Names that an article's parts may have as well (notice, search, related, discussion) say nothing: such blocks go if they recur.
Elements that are not shown go. If what remains
has article or main elements, the text is theirs; a form or the like around the whole page does not take its article away. An article itself, its parts, what contains one,
and what holds most of a page's text are never taken for a template, nor are the parts of such a
block if it recurs itself, nor those of a page that recurs as a whole unless they stand on other
pages too. So copies of an article on many pages stay.

Bounds: templates are broadcast up to ``BROADCAST_ROWS``; beyond, the pages' own hashes are joined to
them, with a salted key, so that a page gets only those that it has.

Defined results: null and empty html give "" and 0; a null url is the host ""; repeated
rows are extracted each; a tag cut off by the end of the page is dropped, unclosed elements end
with the page; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .markup import attributes, tags
from .tokens import batches_of_texts

MIN_PAGES = 5
BROADCAST_ROWS = 500_000
SALTS = 32

_PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
CONTAINERS = frozenset("aside blockquote center details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
IMPLIED = frozenset("p li dt dd tr option".split())
SPACES = frozenset("br td th img".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu object applet canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class names and ids that name boilerplate, where they are all of a name or stand beside words of BESIDE.
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs sidebar footer header masthead notification popup modal overlay newsletter subscribe subscription signup share sharing comment comments disqus pagination pager widget".split())
#: Those of them that also mark a part of an article.
INSIDE = frozenset("ad ads advert adverts advertisement adsense comment comments disqus".split())
#: Words that may stand beside them in one name: site-nav, comment-list; but not has-sidebar, share-price-story.
BESIDE = frozenset("site page main top bottom left right primary secondary global local inner outer section sections list area box block wrapper wrap container content panel bar item items group row column col links link buttons button form post article entry user reader text message body title head inline sticky fixed mobile desktop slot unit units posts articles stories tags author toggle icon icons label labels count counter strip zone placement frame media network networks follow print email thread threads add new all show hide open close accept policy privacy cookie cookies consent gdpr social related search login notice discussion meta nested child children depth even odd alt more also us by via on this your".split())
#: Two of these in one name make it that of a notice.
NOTICES = frozenset("cookie cookies consent gdpr privacy notice".split())
PAGE_ONLY = frozenset(["header", "masthead"])
#: What a header with such a word is the header of: no boilerplate.
OWN = frozenset("article post entry story content".split())
_NOT_SHOWN = re.compile(r"(?:^|;)\s*+(?:display\s*+:\s*+none|visibility\s*+:\s*+hidden)\s*+(?:!|;|$)", re.I)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower().rstrip(".") if m else ""


class Node:
    """A container element: its own texts, block marks and container children in ``items``; ``mark`` says that it is boilerplate by its meaning."""

    __slots__ = ("article", "chars", "hash", "hidden", "holds", "items", "lost", "mark", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, mark: bool, hidden: bool, article: bool):
        self.tag, self.parent, self.mark, self.hidden, self.article = tag, parent, mark, hidden, article
        self.items: list[str | tuple[str] | Node] = []
        self.chars, self.holds, self.hash, self.lost = 0, 0, 0, False


def _is_name(name: str, inside: bool) -> bool:
    """Whether a class name or id says boilerplate: all its words do, or stand beside one that does. inside: of an article."""
    parts = _PART.findall(name)
    own = inside or not OWN.isdisjoint(parts)
    if not inside and len(NOTICES.intersection(parts)) > 1:
        return all(p in NAMES or p in BESIDE for p in parts)
    return bool(parts) and any(p in (INSIDE if inside else NAMES) and not (own and p in PAGE_ONLY) for p in parts) and all(p in NAMES or p in BESIDE for p in parts)


def _boilerplate(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its meaning, and whether it is hidden."""
    mark, hidden = tag in DROPPED or tag == "header" and not inside, False
    for name, value in attributes(attrs) if attrs else ():
        value = value.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _NOT_SHOWN.search(value):
            hidden = True
        elif name == "role":
            mark = mark or value in ROLES
        elif name in ("class", "id") and tag in CONTAINERS:
            mark = mark or any(_is_name(x, inside) for x in value.split())
        elif name in ("class", "id") and tag == "article":  # many sites make each reader comment an article
            mark = mark or any(x.split("-")[0].split("_")[0] in ("comment", "reply") for x in value.split())
    return mark, hidden


def parse(page: str) -> tuple[list[tuple[str, Node]], list[Node]]:
    """Texts and block breaks in page order with the element that each is in ("\\n": a break); the container elements, parents first."""
    root = Node("", None, False, False, False)
    here, at, out, nodes, open_ = root, 0, [], [root], Counter()

    def text(t: str) -> None:
        out.append((t, here))
        here.items.append(t)
        here.chars += len(t)

    for start, end, tag, closes, attrs in tags(page):
        if start > at:
            text(page[at:start])
        at = end
        if not tag:
            continue
        if tag in BLOCKS:
            if here.tag in IMPLIED and (here.tag == tag or here.tag == "p"):
                open_[here.tag] -= 1
                here = here.parent
            out.append(("\n", here))
            here.items.append((tag,))
        elif tag in SPACES:
            text(" ")
        if closes:
            if open_[tag] > 0:
                while here.tag != tag:
                    open_[here.tag] -= 1
                    here = here.parent
                open_[tag] -= 1
                here = here.parent
        elif tag not in VOID and not attrs.endswith("/"):
            mark, hidden = _boilerplate(tag, attrs, here.article)
            if mark or hidden or tag in CONTAINERS or tag in ("article", "main", "body", "html"):
                node = Node(tag, here, mark, hidden, here.article or tag in ("article", "main"))
                here.items.append(node)
                nodes.append(node)
                open_[tag] += 1
                here = node
    if at < len(page):
        text(page[at:])
    for node in reversed(nodes[1:]):
        if node.tag in ("article", "main") and not node.mark and not node.hidden:
            node.holds = max(node.holds, node.chars)
        node.parent.chars += node.chars
        node.parent.holds += node.holds
    return out, nodes


def squeeze(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def mark(nodes: list[Node]) -> list[Node]:
    """Gives all container elements their hash, children first, and returns those that may be templates."""
    for node in reversed(nodes):
        parts, texts = [node.tag], []
        for x in node.items:
            if isinstance(x, str):
                texts.append(x)
                continue
            if texts:
                parts.append("\x01" + squeeze("".join(texts)))
                texts = []
            parts.append(f"\x02{x[0]}" if isinstance(x, tuple) else f"\x03{x.hash}")
        if texts:
            parts.append("\x01" + squeeze("".join(texts)))
        node.hash = _hash("\x00".join(p for p in parts if p != "\x01"))
    return [n for n in nodes if n.tag in CONTAINERS and not n.holds and not n.article and n.chars]


def lose(nodes: list[Node], gone: set[int] = frozenset(), spared: int = 0) -> None:
    """Marks what is left out: hidden elements, those of ``gone`` (hashes), and those that are boilerplate by their meaning, but for those that hold at least ``spared`` characters of articles, if that is not 0."""
    for node in nodes:
        node.lost = node.parent is not None and node.parent.lost or node.hidden or id(node) in gone or node.mark and not (spared and node.holds >= spared)


def decide(out: list[tuple[str, Node]], nodes: list[Node], gone: set[int] = frozenset()) -> bool:
    """Marks what is left out, and returns whether the text is that of article and main elements.

    An element that is boilerplate by its meaning keeps the page's only articles if they are half of its text: a form around the whole page, say.
    """
    lose(nodes, gone)
    if any(n.article and not n.lost and t != "\n" and not t.isspace() for t, n in out):
        return True
    lose(nodes, gone, spared=max(1, -(-nodes[0].chars // 2)))
    if any(n.article and not n.lost and t != "\n" and not t.isspace() for t, n in out):
        return True
    lose(nodes, gone)
    return False


def whole_hash(out: list[tuple[str, Node]], nodes: list[Node]) -> int:
    """A hash of what a page has besides menus and the like."""
    decide(out, nodes)
    return _hash("\x04" + squeeze("".join(f"\x01{n.tag}\x02" if t == "\n" else t for t, n in out if not n.lost)))


def subtree_hashes(page: str) -> set[int]:
    out, nodes = parse(page)
    return {n.hash for n in mark(nodes)} | {whole_hash(out, nodes)}


def extract(page: str, templates: dict[int, int] | None = None) -> str:
    """The main text of one page, given the hashes of its host's templates with their pages."""
    out, nodes = parse(page)
    gone: set[int] = set()
    if templates:
        able = mark(nodes)
        copies = templates.get(whole_hash(out, nodes), 0)
        total = max(1, sum(len(t) for t, n in out if not n.lost and t != "\n"))
        most = {id(n) for n in able if 2 * n.chars > total}
        main: set[int] = set()  # in a block that recurs and holds most of the page
        for n in nodes:
            if id(n.parent) in main or id(n) in most and n.hash in templates:
                main.add(id(n))
        gone = {id(n) for n in able if templates.get(n.hash, 0) > copies and id(n) not in most and id(n) not in main}
    whole = decide(out, nodes, gone)
    blocks, part = [], []
    for t, node in out:
        if t == "\n":
            blocks.append("".join(part))
            part = []
        elif not node.lost and (node.article or not whole):
            part.append(t)
    blocks.append("".join(part))
    return "\n".join(b for b in map(squeeze, blocks) if b)


def templates_by_host(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """host, hash, n_pages of the subtrees that recur on many pages of their host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, at = batch.column(0).to_pylist(), 0
            counts: Counter = Counter()
            for texts in batches_of_texts(batch.column(1)):
                for t in texts:
                    host = host_of(urls[at])
                    at += 1
                    counts.update((host, h) for h in subtree_hashes(t))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.int64()), pa.array([counts[k] for k in keys], pa.int64())], names=["host", "hash", "n"])

    rows = pages.select(pages[url_col].cast("string").alias("u"), pages[html_col].cast("string").alias("h")).mapInArrow(run, "host string, hash long, n long")
    counted = rows.groupBy("host", "hash").agg(F.sum("n").alias("n_pages"))
    return counted.where(F.col("hash").isNotNull() & (F.col("n_pages") >= min_pages))


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per page: the id, the url, text, n_chars (long)."""
    found = templates_by_host(pages, url_col=url_col, html_col=html_col, min_pages=min_pages)
    rows = pages.select(pages[id_col].alias("i"), pages[url_col].alias("u"), pages[html_col].cast("string").alias("h"))
    schema = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` {pages.schema[url_col].dataType.simpleString()}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch], lookup=None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, at, out = batch.column(1).to_pylist(), 0, []
            own = batch.column(3).to_pylist() if lookup is None else None
            for texts in batches_of_texts(batch.column(2)):
                for t in texts:
                    out.append(extract(t, dict(own[at] or ()) if lookup is None else lookup.value.get(host_of(urls[at]))))
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    small = found.limit(broadcast_rows + 1).collect()
    if len(small) <= broadcast_rows:
        by: dict[str, dict[int, int]] = {}
        for r in small:
            by.setdefault(r.host, {})[r.hash] = r.n_pages
        lookup = pages.sparkSession.sparkContext.broadcast(by)
        return rows.mapInArrow(lambda batches: run(batches, lookup), schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            own = [list(subtree_hashes(t)) for texts in batches_of_texts(batch.column(2)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in urls], pa.string()), pa.array(own, pa.list_(pa.int64()))], names=["i", "u", "h", "r", "k", "x"])

    # written, as the row numbers must not change between the two reads
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    seen = C.written(rows.withColumn("r", F.monotonically_increasing_id()).mapInArrow(hashes, f"i {kinds[0]}, u {kinds[1]}, h string, r long, k string, x array<long>"))
    own = seen.select("r", F.col("k").alias("host"), F.explode("x").alias("hash"), F.pmod("r", F.lit(SALTS)).alias("s"))
    salted = found.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sets = own.join(salted, ["host", "hash", "s"]).groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("hash", "n_pages"))).alias("t"))
    return seen.join(sets, "r", "left").select("i", "u", "h", "t").mapInArrow(run, schema)
