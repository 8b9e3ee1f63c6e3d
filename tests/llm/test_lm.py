import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from voxlake.llm import lm


def cut(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def expected(docs, weights):
    """(held_out, n_tokens, n_known, N, base, score) by id, counting token by token."""
    fold = {i: 0 if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in docs}
    one, two = Counter(), Counter()
    for i, t in docs:
        if fold[i] != 2:
            w = cut(t)
            one.update(w)
            two.update(zip([b"\n", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    out = {}
    for i, t in docs:
        w, score = cut(t), 0.0
        for a, b in zip([b"\n", *w], w, strict=False):
            c = one[None] if a == b"\n" else one[a]
            k = weights[0 if c == 0 else 1 + int(np.floor(np.log2(c)))]
            score += log10(k[0] * two[a, b] / max(c, 1) + k[1] * one[b] / max(n, 1) + k[2] / (v + 1))
        out[i] = (fold[i] == 2, len(w), sum(one[x] > 0 for x in w), n, sum(log10((one[x] + 1) / (n + v + 1)) for x in w), score)
    return out


@pytest.mark.parametrize("chunk_bytes", [500, 1 << 24])
def test_against_brute_force(spark, chunk_bytes, monkeypatch):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["The", "the", "of", "é", "x\x0bz", "stone\n", "B"], rng.integers(0, 80)))) for i in range(120)] + [(500, None), (501, ""), (None, "of of"), (502, "word " * 3000)]
    seen = []
    plain = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: seen.append(plain(*a)) or seen[-1])
    df = spark.createDataFrame([(i, t, "", "") for i, t in docs], "doc_id long, text string, id string, score string").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, chunk_bytes=chunk_bytes).collect()}
    want = expected(docs, seen[0])
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[i][:4], i
        assert r.base_score == pytest.approx(want[i][4]) and r.score == pytest.approx(want[i][5])


def test_better_than_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.b < r.s < 0


def slow_weights(docs, rounds):
    """Expectation-maximisation token by token on the fold that is kept out, with counts of the rest."""
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in docs}
    one, two = Counter(), Counter()
    for i, t in docs:
        if fold[i] not in (lm.TEST, lm.FOLD):
            w = cut(t)
            one.update(w)
            two.update(zip([b"\n", *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    held = []
    for i, t in docs:
        if fold[i] == lm.FOLD:
            w = cut(t)
            for a, b in zip([b"\n", *w], w, strict=False):
                c = one[None] if a == b"\n" else one[a]
                held.append((0 if c == 0 else 1 + int(np.floor(np.log2(c))), np.array([two[a, b] / max(c, 1), one[b] / n, 1 / (v + 1)])))
    out, every = np.full((lm.BUCKETS, 3), 1 / 3), np.full(3, 1 / 3)
    for _ in range(rounds):
        sums, total = np.full((lm.BUCKETS, 3), 1e-3), np.full(3, 1e-3)
        for k, p in held:
            sums[k] += out[k] * p / (out[k] @ p)
            total += every * p / (every @ p)
        out, every = sums / sums.sum(axis=1, keepdims=True), total / total.sum()
    for k in set(range(lm.BUCKETS)) - {k for k, _ in held}:
        out[k] = every
    out[0] = [0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def test_weights_equal_a_slow_computation(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    docs = [(i, " ".join(words[min(39, int(rng.exponential(6)))] for _ in range(rng.integers(0, 60)))) for i in range(150)]
    seen = []
    plain = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: seen.append(plain(*a, rounds=6, tolerance=0)) or seen[-1])
    lm.score(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=900).count()
    assert np.allclose(seen[0], slow_weights(docs, 6), atol=1e-9)


def test_weights_follow_the_held_out_counts(spark):
    # bigram estimates that fit in bucket 5, never in bucket 2
    held = spark.createDataFrame([(5, 20, 25, 3, 1000), (2, 0, 2, 30, 1000)], "bucket int, pair long, context long, word long, n long")
    w = lm.learn(held, 1000, 1000)
    assert w[5, 0] > 0.9 and w[2, 0] < 0.01 and np.allclose(w.sum(axis=1), 1)
    assert np.allclose(lm.learn(held.limit(0), 0, 0)[1:], 1 / 3)


def test_long_words_with_one_polynomial_hash_are_two(spark):
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 not in (lm.TEST, lm.FOLD)][:3]
    r = lm.score(spark.createDataFrame([(learned[0], t), (learned[1], u), (learned[2], t)], "doc_id long, text string")).first()
    assert (r.train_tokens, r.vocabulary) == (6, 3)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(5, "a b")], "doc_id long, text string")
    assert lm.score(df.limit(0)).count() == 0
    test_only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(spark.createDataFrame([(test_only, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.base_score, r.n_tokens) == (0, 0, 0.0, 3)
