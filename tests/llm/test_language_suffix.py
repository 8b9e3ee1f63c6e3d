import pytest

from voxlake.llm import language as L


@pytest.mark.parametrize("host,want", [("a.xn--p1ai", "xn--p1ai"), ("пример.рф", "рф"), ("a.international", "international"), ("a.travelersinsurance", "travelersinsurance"), ("10.0.0.1", ""), ("0x7f.0x1", ""), ("localhost", ""), ("", ""), ("a.fr", "fr")])
def test_op1_suffixes(host, want):
    assert L.suffix_of(host) == want


def test_op1_every_suffix_counts(spark):
    docs = spark.createDataFrame([("en", "the cat of the house " * 9), ("fr", "le chat de la maison " * 9)], "lang string, text string")
    html = lambda t: f"<html><body><p>{t}</p></body></html>"
    junk = [(k, f"http://h{k}.junk{k // 2}x", html("the cat of the house")) for k in range(12_000)]
    rare = [(20_000, "http://r1.xn--fiqs8s", html("le chat de la maison")), (20_001, "http://r2.xn--fiqs8s", "")]
    df = spark.createDataFrame(junk + rare, "page_id long, url string, html string").repartition(8)
    plain = spark.createDataFrame(junk + rare[:1] + [(20_001, "http://r2.none-such", "")], "page_id long, url string, html string").repartition(8)
    p = [{r.page_id: r for r in L.identify(x, docs).where("page_id >= 20000").collect()}[20_001] for x in (df, plain)]
    chance = [r.probability if r.lang == "fr" else 1 - r.probability for r in p]
    assert p[0].suffix == "xn--fiqs8s" and chance[0] > 2 * chance[1]
