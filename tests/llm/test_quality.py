import zlib

from voxlake.llm import quality as Q


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.score(docs, labels).collect()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    assert {r.doc_id: r.score for r in Q.score(docs, labels).collect()} == {r.doc_id: r.score for r in Q.score(docs, other).collect()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (2, "", "b"), (3, "word " * 60_000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, text int")
    assert [r.score for r in Q.score(docs, labels).collect()] == [0.5] * 5
    one = spark.createDataFrame([(2, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.score(docs, one).collect())
    assert Q.score(docs.limit(0), labels).count() == 0


def test_layout_changes_no_score_and_repeated_ids_are_bounded(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(*c) for t, c in (("documents", ("doc_id", "text")), ("labels", ("doc_id", "quality"))))
    one = {r.doc_id: r.score for r in Q.score(docs, labels).collect()}
    two = {r.doc_id: r.score for r in Q.score(docs.repartition(7).sortWithinPartitions(Q.F.desc("text")), labels.repartition(5)).collect()}
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-4 for i in one)
    many = docs.crossJoin(spark.range(30)).select("doc_id", "text")
    network = Q.fit(many, labels, Q.word_vectors(docs), sample=40)
    assert network.seen == 40


def test_words_keep_their_vectors_when_they_are_capitals_or_repeat():
    import pyarrow as pa

    from voxlake.llm import arrays as A

    rows, first, capitals, again, near = Q.token_rows(*A.utf8(pa.array(["the THE cat", "cat", "no, no"])))
    assert first.tolist() == [0, 3, 4, 7] and rows[0] == rows[1] and rows[2] == rows[3] and rows[4] == rows[6]
    assert capitals.tolist() == [False, True] + [False] * 5 and again.tolist() == near.tolist() == [False, True, False, False, False, False, True]


def slow_scores(docs, labels):
    """Scores from vectors that are added up token by token; the network is the module's, given the rows in the module's order."""
    import re
    from math import log

    import numpy as np

    places, signs = Q.index_vectors()
    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")

    def row(word):
        data, offsets = np.frombuffer(word, np.uint8), np.array([0, len(word)])
        return int(Q.A.hash_rows(data, offsets)[0] >> np.uint64(50))

    cut = {i: token.findall((t or "").encode()) for i, t in docs}
    known = {w: row(w.lower()) for ws in cut.values() for w in ws}
    total = np.zeros((Q.ROWS, Q.DIM))
    for ws in cut.values():
        for k, w in enumerate(ws):
            for j in range(max(0, k - Q.REACH), min(len(ws), k + Q.REACH + 1)):
                if j != k:
                    total[known[w], places[known[ws[j]]]] += signs[known[ws[j]]]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    vectors = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
    for r in range(Q.ROWS):
        vectors[r, places[r]] += signs[r] / np.sqrt(Q.NONZERO)
    out = {}
    for i, ws in cut.items():
        x = np.zeros(Q.DIM + 4)
        low = [w.lower() for w in ws]
        is_word = [w[:1].isalnum() or w[0] >= 0x80 for w in ws]
        again = [k > 0 and low[k] == low[k - 1] or k > 1 and low[k] == low[k - 2] and not is_word[k - 1] for k in range(len(ws))]
        for k, w in enumerate(ws):
            if not again[k]:
                x[: Q.DIM] += vectors[known[w]] / again.count(False)
            x[Q.DIM] += (w[:1].isalpha() and w[:1].isupper() and w[1:2].isupper()) / len(ws)
            x[Q.DIM + 1] += again[k] / len(ws)
            x[Q.DIM + 2] += (low[k] in low[max(0, k - 6) : k]) / len(ws)
        x[Q.DIM + 3] = log(1 + len(ws)) / 8
        out[i] = x
    rows = [i for i in labels if i in out]
    network = Q.Network(np.array([out[i] for i in rows]), np.array([float(labels[i]) for i in rows]))
    return {i: float(network.scores(x[None, :])[0]) for i, x in out.items()}


def test_scores_equal_a_slow_computation(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    small = docs.where("length(text) < 3000").select("doc_id", "text")
    known = labels.where(~Q.held_out(Q.F.col("doc_id"))).join(small.select("doc_id"), "doc_id").orderBy(Q.F.xxhash64("doc_id"), "doc_id").collect()
    want = slow_scores([(r.doc_id, r.text) for r in small.collect()], {r.doc_id: r.quality for r in known})
    got = {r.doc_id: r.score for r in Q.score(small, labels.join(small.select("doc_id"), "doc_id")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 0.01 for i in want), max(abs(got[i] - want[i]) for i in want)
