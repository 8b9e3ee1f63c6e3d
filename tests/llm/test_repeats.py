import numpy as np
import pytest

from voxlake.llm import chunks as C
from voxlake.llm import repeats as R


def compare(spark, docs, **more):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, id string, n_bytes string").repartition(3)
    got = sorted(map(tuple, R.digest(R.remove_repeats(df, **more)).collect()), key=str)
    assert got == sorted(R.brute_force(docs), key=str)


def corpus(rng):
    words = ["the", "of", "été", "and", "x", "stone", "réponse", "it"]
    text = lambda n: " ".join(rng.choice(words, n))
    passages = [text(k) for k in (10, 22, 25, 60, 200)]
    docs = []
    for i in range(60):
        t = text(int(rng.integers(0, 150)))
        for p in rng.choice(passages, int(rng.integers(0, 3))):
            t = t[: len(t) // 2] + " " + p + " " + t[len(t) // 2 :]
        docs.append((i * 3, t))
    docs += [(200 + k, docs[7][1]) for k in range(6)] + [(300 + k, docs[9][1][: 400 + k] + text(3) + docs[9][1][400 + k :]) for k in range(10)]
    return docs + [(400, "a" * 700), (401, "ab" * 300), (402, None), (403, ""), (404, "x" * 99), (405, "x" * 100), (406, "y" + "x" * 100 + "y"), (None, docs[3][1])]


@pytest.mark.parametrize("chunk_bytes", [700, 20_000, 1 << 23])
def test_against_brute_force(spark, chunk_bytes):
    compare(spark, corpus(np.random.default_rng(3)), chunk_bytes=chunk_bytes)


def test_long_texts_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(R.A, "SLICE_BYTES", 1000)
    rng = np.random.default_rng(4)
    body = " ".join(rng.choice(["the", "of", "b"], 1500))
    docs = [(1, body), (2, body[333:2222] + " new " + body[100:900]), (3, body + body)]
    table = C.Chunk(C.chunked(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), text_col="text", id_col="doc_id", part_bytes=1 << 20)[0].toArrow())
    p = R.Parse(table, 100, 32)
    assert len(p.s0) and (np.diff(p.s0) > 0).all()
    assert int((p.s1 - p.s0 + 1).sum()) == sum(len(t) - 99 for _, t in docs)


def test_repeated_rows_empty_table_and_kept_columns(spark):
    t = "one hundred bytes of text that are long enough to be counted as a repeat, since they are more than a hundred."
    df = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (2, "no", "b")], "doc_id long, text string, kept string")
    rows = R.remove_repeats(df, keep=("doc_id", "text")).collect()
    assert sorted(len(r.kept) for r in rows) == [0, 2, len(t)]
    assert R.remove_repeats(df.limit(0)).count() == 0
    plan = C.chunked(df, text_col="text", id_col="doc_id", part_bytes=1 << 20)[0].groupBy("chunk").applyInArrow(lambda t: t, "chunk long, seq long, id long, text string")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
