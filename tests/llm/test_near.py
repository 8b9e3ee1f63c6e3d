import numpy as np
import pytest

from voxlake.llm import near as N


def corpus(rng, n=60):
    words = [f"w{k}" for k in range(300)] + ["Été"]
    text = lambda k: list(rng.choice(words, k))
    docs = []
    for i in range(n):
        base = text(int(rng.integers(20, 150)))
        docs.append(base)
        for _ in range(int(rng.integers(0, 4))):
            near = list(base)
            for _ in range(int(rng.integers(0, 4))):
                near[int(rng.integers(len(near)))] = "changed" + str(rng.integers(9))
            docs.append(near)
    base = text(200)
    for k in range(70):
        near = list(base)
        near[(3 * k) % 200] = f"edit{k}"
        docs.append(near)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    return rows + [(1000 + k, rows[3][1].upper()) for k in range(9)] + [(2000, None), (2001, ""), (2002, "one two"), (2003, "One, two!"), (2004, "one"), (None, rows[5][1]), (2005, "long " * 20_000), (2006, "long " * 30_000)]


@pytest.mark.parametrize("chunk_bytes,tile", [(2000, 16), (1 << 23, 1024)])
def test_against_brute_force(spark, chunk_bytes, tile):
    docs = corpus(np.random.default_rng(8))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, class_id string, v string").repartition(3)
    rows = N.near_duplicates(df, chunk_bytes=chunk_bytes, tile=tile).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in rows), key=str) == sorted(N.brute_force(docs), key=str)
    assert sum(r.is_first for r in rows) == len({r.class_id for r in rows})
    assert all(r.doc_id == r.class_id for r in rows if r.is_first)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x")], "doc_id long, text string")
    rows = N.near_duplicates(df, keep=("text",)).collect()
    assert sorted((r.doc_id, r.text, r.class_id, r.n_links, r.is_first) for r in rows) == [(1, "a b c d e f", 1, 1, False), (1, "a b c d e f", 1, 1, True), (2, "x", 2, 0, True)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_many_pairs_are_verified_like_few():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 300)).astype(np.uint64) for _ in range(40)]
    values, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    assert N._common(values, first, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def test_bounds_of_the_posterior():
    few, many = N.least_matches(0.8, (36, 180), 1e-9)
    assert 5 < few < 20 and 90 < many < 130


def test_pairs_that_share_a_band():
    """Going through bands gives the pairs that a comparison of all keys gives, within a tile and between two."""
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 4000, (700, N.BANDS)).astype(np.uint64)
    keys[::50] = keys[0]
    share = (keys[:, None, :] == keys[None, :, :]).any(axis=2)
    a, b = rng.permutation(700)[:300], None
    i, j = N.sharing(keys, a, b)
    assert {frozenset(x) for x in zip(i.tolist(), j.tolist(), strict=True)} == {frozenset((x, y)) for x in a.tolist() for y in a.tolist() if x != y and share[x, y]}
    a, b = np.arange(0, 250), np.arange(250, 700)
    i, j = N.sharing(keys, a, b)
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i) == share[:250, 250:].sum()
    assert N.sharing(np.zeros((300, N.BANDS), np.uint64), np.arange(300), None) is None


def test_a_tie_of_many_different_texts(spark, monkeypatch):
    """Texts that all share half of their shingles are tied by bands here and there; only near copies among them are linked."""
    rng = np.random.default_rng(7)
    common = [f"c{k}" for k in range(60)]
    docs = []
    for i in range(180):
        own = [f"w{int(x)}" for x in rng.integers(0, 10_000, 60)]
        docs.append((2 * i, " ".join(common + own)))
        docs.append((2 * i + 1, " ".join(common + own[:-1] + ["z"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in N.near_duplicates(df, tile=200, slot_bytes=10_000).collect())
    assert got == [(i, i - i % 2, 1) for i in range(360)]
