"""Pages with open quotes and brackets, of any length, and names that an article's own parts may have."""

import random
import re
import time

import pytest

from voxlake.llm import html as H
from voxlake.llm import language as L
from voxlake.llm import markup as M

LONG = [
    "<a<" * 350_000,
    "<p>ok</p><" + "a" * 1_000_000 + ' b="x',
    "<a \">\"" * 150_000,
    "<a '" * 250_000,
    "<!--" * 250_000,
    "<script>" * 125_000,
    "<script></script " * 60_000,
    "<" * 300_000,
    '<x a="\'' * 150_000,
    "<div " + "a " * 500_000 + ">",
    "<a   " * 200_000,
    "<a hidden " * 100_000,
]


@pytest.mark.parametrize("page", LONG, ids=range(len(LONG)))
def test_a_million_bytes_take_seconds(page):
    began = time.process_time()
    H.extract(page, {1: 9})
    L.declared(page)
    assert time.process_time() - began < 8


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><section id='discussion'><p>Findings</p></section><p>End</p></article>", "Findings\nEnd"),
        ("<article><h2 id='discussion'>Discussion</h2><p>End</p></article>", "Discussion\nEnd"),
        ("<article><p class='notice'>Take note</p><p class='menu'>Soup</p><div class='sidebar'>Aside</div></article>", "Take note\nSoup\nAside"),
        ("<body><div class='content-search'>story</div></body>", "story"),
        ("<body><div class='cookie-list'>oats and sugar</div></body>", "oats and sugar"),
        ("<body><div class='promo-text'>story</div></body>", "story"),
        ("<body><h1 class='header'>Title</h1><p class='footer'>x</p><ul><li class='nav'>y</ul></body>", "Title\nx\ny"),
        ("<article><p>x</p><div class='comments'>me too</div><div class='ad'>buy</div></article>", "x"),
        ("<div class='cookie-notice'>we use</div><div id='privacy-consent'>ok?</div><p>x</p>", "x"),
        ("<p>x</p><div style='color:red; display: none'>no</div><div style='visibility:hidden'>no</div><div style='display:none-such'>yes</div>", "x\nyes"),
        ("<div data-id='menu' title=\"class='nav'\">kept</div>", "kept"),
        ("<p>a</p><svg/><p>b</p><script/>var x</script><p>c", "a\nb\nc"),
        ("<p>a <a href='x>b</p><p>c</p>", "a b\nc"),
        ("<p>a</p><b x='1", "a"),
    ],
)
def test_names_quotes_and_hidden_elements(page, text):
    assert H.extract(page) == text


def slow_end(page, place):
    """Where a tag open at place ends, by walking on."""
    quote = ""
    for k in range(place, len(page)):
        if quote:
            quote = "" if page[k] == quote else quote
        elif page[k] in "\"'":
            quote = page[k]
        elif page[k] == ">":
            return k
    return -1


def test_ends_equal_a_walk():
    rng = random.Random(1)
    for _ in range(300):
        page = "".join(rng.choice("<a>\"' =/b") for _ in range(rng.randint(0, 60)))
        ends = M.Ends(page)
        assert [ends.after(k) for k in range(len(page))] == [slow_end(page, k) for k in range(len(page))]
        for start, end, name, closes, attrs in M.tags(page):
            if name and (to := slow_end(page, start + 1 + closes + len(name))) >= 0:
                assert (end, page[to]) == (to + 1, ">") and page[start:end] == f"<{'/' * closes}{page[start + 1 + closes : start + 1 + closes + len(name)]}{attrs}>"


def test_tags_cover_every_letter_after_a_bracket():
    rng = random.Random(2)
    for _ in range(300):
        page = "".join(rng.choice("<a>\"' !-/b") for _ in range(rng.randint(0, 80)))
        at = 0
        for start, end, *_ in M.tags(page):
            assert start >= at and end > start and not re.search(r"<[a-z!/]", page[at:start])
            at = end
        assert not re.search(r"<[a-z!/]", page[at:])


@pytest.mark.parametrize("page,code", [("<meta content='it' http-equiv='Content-Language'>", "it"), ("<html data-x='lang=de' lang=fr>", "fr"), ("<html lang=de lang=fr>", "de"), ("<html lang='' xml:lang=es>", "es"), ("<html lang=\"de>", "")])
def test_declared(page, code):
    assert L.declared(page) == code
