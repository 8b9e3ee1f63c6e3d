import math

import pytest

from voxlake.llm import language as L


def page(text, lang=None):
    return f"<html{f' lang={chr(34)}{lang}{chr(34)}' if lang else ''}><body><article><p>{text}</p></article></body></html>"


def test_agrees_with_the_pages_own_paths(spark):
    pages, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents"))
    got = {r.page_id: r for r in L.identify(pages, docs).collect()}
    path = {r.page_id: r.p for r in pages.selectExpr("page_id", "regexp_extract(url, '//[^/]+/([a-z]+)/', 1) p").collect()}
    assert len(got) == len(path)
    assert sum(got[i].lang == p for i, p in path.items()) >= 0.97 * len(path)


def test_model_on_documents_that_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = L.text_model(docs.where("doc_id % 5 <> 0"))
    rows = docs.where("doc_id % 5 = 0").collect()
    best = L.likelihoods([r.text for r in rows], table).argmax(axis=1)
    assert sum(langs[k] == r.lang for k, r in zip(best, rows, strict=True)) >= 0.97 * len(rows)


def test_fusion_decides_pages_without_text(spark):
    docs = spark.createDataFrame([("en", "the cat of the house " * 9), ("fr", "le chat de la maison " * 9), (None, "x"), ("de", None)], "lang string, text string")
    rows = [(k, "http://a.example.fr/x", page("le chat de la maison", "fr"), 1) for k in range(8)] + [(20 + k, "http://b.example.com/x", page("the cat of the house", "en"), 1) for k in range(8)]
    rows += [(50, "http://a.example.fr/y", "", 1), (51, "http://b.example.com/y", None, 1), (52, None, page("", "fr"), 1), (53, "http://new.fr", page(""), 1), (54, None, None, 1)]
    df = spark.createDataFrame(rows + [rows[0]], "page_id long, url string, html string, lang int")
    got = {r.page_id: r for r in L.identify(df, docs).collect()}
    assert [got[k].lang for k in (0, 20, 50, 51, 52, 53)] == ["fr", "en", "fr", "en", "fr", "fr"]
    assert got[50].text_lang is None and got[0].text_lang == "fr" and 0.5 <= got[54].probability <= 1
    assert L.identify(df, docs).count() == len(rows) + 1
    assert L.identify(df.limit(0), docs).count() == 0
    assert {r.lang for r in L.identify(df, docs.limit(0)).collect()} == {None}


def test_host_prior_by_hand(spark):
    docs = spark.createDataFrame([("en", "aaaa"), ("fr", "bbbb")], "lang string, text string")
    one = spark.createDataFrame([(1, "http://h.example/", None)], "page_id long, url string, html string")
    # a lone page without text: its own half shares are taken out, what is left is even
    r = L.identify(one, docs).first()
    assert r.lang == "en" and r.probability == pytest.approx(0.5)


@pytest.mark.parametrize("html,want", [("<HTML LANG=pt-BR>", "pt"), ("<html xml:lang='de'>", "de"), ("<html data-lang='x'>", ""), ("<meta http-equiv=content-language content='es, en'>", "es"), ("", ""), ("<!-- <html lang=de> --><html lang=fr>", "fr"), ("<!-- <html lang=de> --><p>x", ""), ("<script>'<html lang=de>'</script><html><head><meta http-equiv=content-language content=it></head>", "it"), ("<html><body><html lang=de>", "")])
def test_declared(html, want):
    assert L.declared(html) == want


def test_trigrams_count_bytes():
    import numpy as np

    h, first = L.trigrams(np.frombuffer("abcé".encode(), np.uint8), np.array([0, 0, 2, 5]))
    assert first.tolist() == [0, 0, 2, 5] and len(h) == 5
    assert math.isfinite(L.likelihoods(["", "abc"], np.log(np.full((2, 1 << L.BITS), 0.5))).sum())


def test_own_text_is_no_evidence_for_itself(spark):
    """Pages that are alone with their suffix and code are as sure as pages without them."""
    docs = spark.createDataFrame([("en", "the cat of the house " * 9), ("fr", "le chat de la maison " * 9)], "lang string, text string")
    rows = [(1, "http://one.aa/x", page("le chat et the house", "xx")), (2, "http://two", page("le chat et the house"))]
    got = {r.page_id: r for r in L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert (got[1].declared, got[1].suffix) == ("xx", "aa") and (got[2].declared, got[2].suffix) == ("", "")
    assert got[1].lang == got[2].lang and got[1].probability == pytest.approx(got[2].probability, abs=1e-9)


def test_fusion_by_hand(spark):
    """The posterior of every page against the formulas, written out page by page."""
    import numpy as np

    docs = spark.createDataFrame([("en", "the cat of the house " * 9), ("fr", "le chat de la maison " * 9), ("de", "die katze im haus " * 9)], "lang string, text string")
    words = ["the cat of the house", "le chat de la maison", "die katze im haus", "the chat im haus", ""]
    rng = np.random.default_rng(3)
    rows = [(k, f"http://{'ab'[k % 2]}.s{k % 3}.{['de', 'fr', 'com'][k % 3]}/x", page(words[int(rng.integers(5))], ["de", "fr", None][int(rng.integers(3))])) for k in range(40)]
    got = {r.page_id: r for r in L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    langs, table = L.text_model(docs)
    like = {k: L.likelihoods([L.extract(h)], table)[0] for k, _, h in rows}
    own = {k: np.exp(x - x.max()) / np.exp(x - x.max()).sum() for k, x in like.items()}
    host, code = {k: L.host_of(u) for k, u, _ in rows}, {k: L.declared(h) for k, _, h in rows}
    for k, _, _ in rows:
        others = lambda same: sum((own[j] for j in own if j != k and same(j)), np.zeros(3))
        share = lambda x: x / x.sum()
        base = share(others(lambda j: True) + 1)
        level = share(others(lambda j: L.site_of(host[j]) == L.site_of(host[k])) + L.SITE_WEIGHT * base)
        total = like[k] + np.log(share(others(lambda j: host[j] == host[k]) + L.HOST_WEIGHT * level))
        for value in (code, {j: L.suffix_of(h) for j, h in host.items()}):
            if value[k]:
                total = total + np.log(share(others(lambda j, value=value: value[j] == value[k]) + L.EVIDENCE_WEIGHT * base)) - np.log(base)
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got[k].lang == langs[int(p.argmax())] and got[k].probability == pytest.approx(p.max(), abs=1e-6)
