import numpy as np
import pytest

from voxlake.llm import decontaminate as D


def rows_of(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string, extra int")
    return sorted(map(tuple, D.digest(D.decontaminate(d, b, **more)).collect()), key=str)


def expected(docs, items):
    return sorted(D.brute_force([x[:2] for x in docs], [x[:2] for x in items]), key=str)


@pytest.mark.parametrize("blocks", [1, 4])
def test_against_brute_force(spark, blocks):
    rng = np.random.default_rng(5)
    vocab = ["the", "of", "Été", "x1", "and", "b"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, text(int(rng.integers(0, 25))), 0) for i in range(30)] + [(99, None, 0), (100, "", 0), (3, "the of the of", 0), (7, "Zebra's", 1)]
    docs = [(i, text(int(rng.integers(0, 300))), "", "") for i in range(40)]
    docs += [(50, "pre " + (items[k][1] or "") + " post", "", "") for k in range(20)] + [(60, None, "", ""), (61, "", "", ""), (62, "ZEBRA s zebra", "", ""), (62, "ZEBRA s zebra", "", ""), (63, text(40_000), "", "")]
    size = sum(len((t or "").encode()) for _, t, _ in items)
    assert rows_of(spark, docs, items, block_bytes=size // blocks + 1) == expected(docs, items)


def test_empty_tables(spark):
    assert rows_of(spark, [], [(1, "a b", 0)]) == []
    assert rows_of(spark, [(1, "a b", "", "")], []) == expected([(1, "a b")], [])


def test_the_tables_take_bounded_memory():
    """Several blocks are sized by this: bytes broadcast for a byte of benchmark text."""
    import pickle

    rng = np.random.default_rng(1)
    items = [(str(i), " ".join(f"word{x}" for x in rng.integers(0, 5000, 4000))) for i in range(40)]
    size = sum(len(t) for _, t in items)
    tables = D.Tables(items)
    fixed = sum(g.shift.nbytes for g in tables.groups)  # at most 16 MB for each length
    assert len(pickle.dumps(tables)) - fixed <= D.BYTES_PER_BYTE * size and fixed <= len(tables.groups) << 24


def test_hashes_alone_decide_nothing(monkeypatch):
    """With hashes that tell words apart by their length only, the direct comparison still finds what brute force finds."""
    monkeypatch.setattr(D.A, "words_hash", lambda data, sums, starts, ends: (ends - starts).astype(np.uint64))
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(rng.choice(["ab", "cd", "e", "fgh"], n))
    items = [(str(i), text(int(rng.integers(1, 15)))) for i in range(12)] + [("0", "ab cd")]
    docs = [(i, text(int(rng.integers(0, 200))) + " " + items[i % 12][1]) for i in range(30)]
    import pyarrow as pa

    counts, spans, found = D.match(D.Tables(items), *D.A.utf8(pa.array([t for _, t in docs])))
    want = D.brute_force(docs, items)
    for k, (_, n, n_hit, n_items, _, dirty) in enumerate(want):
        assert (counts[k], len({x for a, m in spans[k] for x in range(a, a + m)}), len(found[k]), bool(spans[k])) == (n, n_hit, n_items, dirty)


def test_a_text_that_is_one_frequent_window():
    import pyarrow as pa

    items = [(str(i), "the " * 30) for i in range(50)]
    counts, spans, found = D.match(D.Tables(items), *D.A.utf8(pa.array(["the " * 2000, "a the"])))
    assert counts.tolist() == [2000, 2] and len(spans[0]) == 1991 and len(found[0]) == 50 and not spans[1]
