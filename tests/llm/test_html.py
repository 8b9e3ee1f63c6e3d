import pytest

from voxlake.llm import html as H

MENU = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
CASES = [
    ("", ""),
    ("<p>One <b>t</b>wo&nbsp;&amp; x<br>y</p>", "One two & x y"),
    ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body>" + MENU + "<!-- ad 0 --><div class=\"ad\">Buy</div><article><h1>Head</h1><p><b>First.<br><p>Second &lt;i&gt;.</p><ul><li>a<li>b</ul></article><footer>&copy; me</footer></body></html>", "Head\nFirst.\nSecond <i>.\na\nb"),
    ("<body><article><p>Cut &am", "Cut &am"),
    ("<body><article><p>Cut off <a href=\"/x", "Cut off"),
    ("<header>Site</header><main><header><h1>Title</h1></header><p>Body</p><section id='comments'><p>me too</p></section><form><p>Mail</p></form></main><aside>more</aside>", "Title\nBody"),
    ("<div role='banner'>x</div><div class='cookie-notice'>we use</div><div class='post'>Text</div><div hidden>no</div><div class='advert'>buy</div><p>More", "Text\nMore"),
    ("a < b and c > d", "a < b and c > d"),
    ("<article><p>x</p></article></div></section><p>out", "x"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_extract(page, text):
    assert H.extract(page) == text


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_templates_go_and_repeated_articles_stay(spark, broadcast_rows):
    page = lambda k: f"<body><div>Welcome to the site</div><div><p>Story number {k} with a long enough body of text to be most of it.</p></div><table><tr><td>Imprint</td></tr></table></body>"
    rows = [(k, f"https://U@Site.example:80/{k}", page(k), "x") for k in range(12)] + [(100 + k, "http://other.example", "<article><div>Same</div><p>Story copied</p></article>", "x") for k in range(8)]
    rows += [(200, None, None, None), (201, "http://lone.example/", page(1), None), (None, "http://lone.example/", "<p>z", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in H.extract_pages(df, broadcast_rows=broadcast_rows).collect()}
    for k in range(12):
        want = f"Story number {k} with a long enough body of text to be most of it."
        assert got[k] == (want, len(want))
    assert got[100] == ("Same\nStory copied", 17)
    assert got[200] == ("", 0) and got[None] == ("z", 1)
    assert got[201][0].startswith("Welcome to the site\nStory number 1")
    assert H.extract_pages(df.limit(0)).count() == 0
