"""Template removal against a slow count over the trees that the pages were made from, and pages of unusual shape."""

import random
import time
from collections import Counter

import pytest

from voxlake.llm import html as H


def render(node) -> str:
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(render, node[1]))}</{node[0]}>"


def chars(node) -> int:
    return len(node) if isinstance(node, str) else sum(map(chars, node[1]))


def subtrees(node):
    if not isinstance(node, str):
        yield node
        for x in node[1]:
            yield from subtrees(x)


def blocks(node, drop, out):
    """The blocks of text in page order, without the subtrees of drop."""
    if isinstance(node, str):
        out[-1] += node
        return
    out.append("")
    if node not in drop:
        for x in node[1]:
            blocks(x, drop, out)
    out.append("")


def slow(pages):
    """(host, tree) to texts: subtrees on at least MIN_PAGES pages of the host go, but for what is most of a page, its parts, and what recurs with its page."""
    counts, wholes = Counter(), Counter()
    for host, tree in pages:
        counts.update({(host, render(x)) for x in subtrees(tree)})
        wholes[host, render(tree)] += 1
    out = []
    for host, tree in pages:
        total, copies = chars(tree), wholes[host, render(tree)]
        copies = copies if copies >= H.MIN_PAGES else 0
        kept = set()
        for x in subtrees(tree):
            if x is not tree and 2 * chars(x) > total and counts[host, render(x)] >= H.MIN_PAGES:
                kept.update(map(render, subtrees(x)))
        drop = [x for x in subtrees(tree) if x is not tree and (n := counts[host, render(x)]) >= H.MIN_PAGES and n > copies and 2 * chars(x) <= total and render(x) not in kept]
        found = [""]
        blocks(tree, drop, found)
        out.append("\n".join(b for b in found if b))
    return out


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_templates_equal_a_slow_count(spark, broadcast_rows):
    rng = random.Random(4)

    def tree(depth):
        kids = [rng.choice("abc") * rng.randint(1, 3) if depth == 0 or rng.random() < 0.4 else tree(depth - 1) for _ in range(rng.randint(1, 3))]
        return (rng.choice(["div", "ul", "table", "section"]), kids)

    common = [tree(2) for _ in range(6)]
    pages = []
    for k in range(120):
        kids = [rng.choice(common) if rng.random() < 0.5 else tree(2) for _ in range(rng.randint(1, 5))] + [f"story{k}" * rng.randint(0, 4)]
        pages.append((f"h{k % 3}.example", ("body", kids)))
    pages += [pages[5]] * 7
    df = spark.createDataFrame([(i, f"http://{h}/{i}", render(t)) for i, (h, t) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_pages(df, broadcast_rows=broadcast_rows).collect()}
    want = slow(pages)
    assert [got[i] for i in range(len(pages))] == want
    without = [H.extract(render(t)) for _, t in pages]
    assert sum(a != b for a, b in zip(without, want, strict=True)) > 60  # templates decide


def test_deep_pages():
    for n in (1100, 5000, 50_000):
        page = "<div>" * n + "<article><p>Story text</p></article>" + "</div>" * n
        assert H.extract(page, {1: 9}) == "Story text"
        assert len(H.subtree_hashes(page.replace("article", "b"))) == n + 1


def test_long_deep_pages_take_linear_time():
    def seconds(n):
        page = "<div>" * n + "word " * 100_000 + "<a>x</a>" * 20_000 + "</div>" * n
        t = time.process_time()
        H.subtree_hashes(page)
        return time.process_time() - t

    seconds(10)
    assert seconds(4000) < 10 * seconds(40) + 1


@pytest.mark.parametrize(
    "page,text",
    [
        ('<div class="layout has-sidebar"><article><p>Story</p></article></div>', "Story"),
        ('<article class="post share-price-story"><p>Story</p></article>', "Story"),
        ("<body><form action='/'><nav>Menu</nav><article><p>Story</p></article><select><option>x</select></form>", "Story"),
        ('<div class="page social"><main><p>The story is longer.</p></main></div>', "The story is longer."),
        ("<aside><article>Teaser</article></aside><div><p>The story is longer than the teaser.</p></div>", "The story is longer than the teaser."),
        ('<main><p>Story</p><div id="comments-area"><article class="comment-body">Me too</article></div></main>', "Story"),
        ('<div class="comment-list">Me too</div><div class="site-nav">Menu</div><div class="cookie-banner">We use</div><div class="post-comments">x</div><p>Story</p>', "Story"),
        ('<div class="ad-slot-3">Buy</div><div class="nav-stories">More</div><ul class="share_buttons"><li>Share</ul><div id="comments-12">x</div><div class="article-header"><h1>Title</h1></div><p>Story</p>', "Title\nStory"),
        ('<div class="sharepoint commentary navigator">Kept</div><div class="search-results">Kept</div><p>Story</p>', "Kept\nKept\nStory"),
        ('<div hidden><article>Not shown</article></div><p>Story</p>', "Story"),
        ("<body><form><p>Your name</p></form><p>Story</p>", "Story"),
    ],
)
def test_names_and_wrappers(page, text):
    assert H.extract(page) == text
