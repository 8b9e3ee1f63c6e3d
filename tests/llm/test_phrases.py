import random
import re
from collections import Counter

import pytest

from tests.compare import compare, duck
from voxlake.llm import phrases, queries

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def slow_counts(rows, least):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    return n, {k: v for k, v in f.items() if v >= least}


def slow(rows, least=100, share=100, best=2000):
    n, f = slow_counts(rows, least)
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or any(x == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, own in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(own)[:best], 1))


def check(spark, rows, **more):
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, **more).collect())
    own = {k: v for k, v in more.items() if k in ("least", "share", "best")}
    assert got == slow(rows, **own)
    return got


def texts(rng, count):
    words = ["the", "The", "of", "new", "york", "city", "é", "日本", "a", "b"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "; "]) for _ in range(rng.randint(0, 60)))) for _ in range(count)]


def test_equals_a_slow_count(spark):
    rows = texts(random.Random(1), 300)
    assert len(check(spark, rows, least=10)) > 100


def test_hot_prefixes_at_every_depth(spark):
    """Bounds so low that words, pairs, and longer prefixes are split, and small chunks and parts."""
    rng = random.Random(2)
    rows = texts(rng, 150) + [("en", "new york city of the new york city")] * 120 + [("en", "a a a a a a a a")] * 30
    for hot in (5, 40, 200):
        check(spark, rows, least=5, hot=hot, chunk_bytes=1500, part_bytes=2000)


def test_two_steps(spark, monkeypatch):
    monkeypatch.setattr(phrases.C, "GROUPS", 3)
    rows = texts(random.Random(3), 200)
    check(spark, rows, least=5, hot=50, chunk_bytes=1500, part_bytes=1000)


@pytest.mark.parametrize("share", [50, 80])
def test_other_shares_and_few_best(spark, share):
    check(spark, texts(random.Random(4), 200), least=5, share=share, best=7)


def test_odd_rows(spark):
    rows = [("en", None), ("en", ""), (None, "x y " * 150), ("und", "x y " * 10), ("", "p q. " * 120), ("en", "w" * 100_000 + " v"), ("en", " ".join(["l" * 300, "m" * 300] * 120)), ("en", "one"), ("fr", "...,,;\r\n")] + [("de", "ein Satz, der oft steht; EIN Satz")] * 130
    got = check(spark, rows)
    assert {r[0] for r in got} == {"und", "", "en", "de"}


def test_very_long_text(spark):
    rows = [("en", "the cat sat on the mat and went. " * 30_000)]
    assert check(spark, rows, hot=10_000)


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, rank string, phrase int")
    found = phrases.collocations(empty)
    assert found.collect() == [] and found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_products_beyond_64_bits(spark):
    """Scores are of decimals: made counts whose products pass 64 bits."""
    df = spark.sql("select cast(3000000000 as decimal(19,0)) * cast(40000000000000 as decimal(19,0)) * cast(1000 as decimal(4,0)) as x, cast(7000000019 as decimal(19,0)) * cast(3000000011 as decimal(19,0)) as y").selectExpr("x div y as s")
    assert df.first().s == 3000000000 * 40000000000000 * 1000 // (7000000019 * 3000000011)


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    compare(queries.QUERIES["op13_phrases"](spark, folder), duck(folder), queries.ORACLE_SQL["op13_phrases"])
