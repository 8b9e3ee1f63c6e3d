import pytest

from voxlake.llm import html as H

ARTICLE = "<article><div>Same</div><p>Story copied</p></article>"
DIVS = "<body><div>Menu of the site</div><div>First part of a story.</div><div>Second part of it.</div><div>Third part, the end.</div></body>"
BLOCK = "<body><div>Menu of the site</div><div><ul><li>One point of the story</li></ul><p>And the rest of it.</p></div></body>"


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_op8_copies_keep_all_their_parts(spark, broadcast_rows):
    rows = [(k, "http://a.example", ARTICLE) for k in range(8)] + [(10 + k, "http://b.example", DIVS) for k in range(8)] + [(20 + k, "http://b.example", BLOCK) for k in range(8)]
    rows += [(30 + k, "http://b.example", f"<body><div>Menu of the site</div><p>Text number {k} by itself.</p></body>") for k in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_pages(df, broadcast_rows=broadcast_rows).collect()}
    assert got[0] == "Same\nStory copied"
    assert got[10] == "First part of a story.\nSecond part of it.\nThird part, the end."
    assert got[20] == "One point of the story\nAnd the rest of it."
    assert got[31] == "Text number 1 by itself."


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_op8_a_section_of_a_large_host(spark, broadcast_rows):
    page = lambda k: f"<body>{'<div>Section menu</div>' if k < 6 else ''}<p>Text number {k} that stands here by itself.</p></body>"
    df = spark.createDataFrame([(k, "http://a.example", page(k)) for k in range(400)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_pages(df, broadcast_rows=broadcast_rows).collect()}
    assert len(got) == 400 and all(got[k] == f"Text number {k} that stands here by itself." for k in range(400))
