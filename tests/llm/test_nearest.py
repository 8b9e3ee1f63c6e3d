import numpy as np

from voxlake.llm import nearest as N


def test_recall_and_exact_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {tuple(r) for r in N.search(e, e.where("vec_id % 50 = 0")).collect()}
    p = e.toPandas()
    ids, x = p.vec_id.to_numpy(), np.stack(p.embedding.to_numpy())
    want = N.brute_force(ids, x, np.flatnonzero(ids % 50 == 0))
    score = {(q, v): s for q, _, v, s in want}
    assert len(got) == len(want)
    assert len({(q, v) for q, _, v, _ in got} & set(score)) >= 0.9 * len(want)
    assert all(abs(s - score[q, v]) < 1e-12 for q, _, v, s in got if (q, v) in score)


def test_edges(spark):
    z = [0.0] * 4
    rows = [(0, [1.0, 0, 0, 0], "x"), (1, [2.0, 0, 0, 0], "x"), (2, [3.0, 0, 0, 0], None), (3, z, None), (4, None, None), (5, [1.0, None, 0, 0], None), (6, [1.0, float("nan"), 0, 0], None), (7, [1.0, 0], None), (8, [0, 1.0, 0, 0], None), (8, [0, 1.0, 0, 0], None), (None, [1.0, 0, 0, 0], None), (50, [1.0, 1.0, 0, 0], None)]
    rows = [(i, v and [None if c is None else float(c) for c in v], x) for i, v, x in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = [tuple(r) for r in N.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 8), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 8)]
    assert got[0][3] == 1.0
    assert N.search(df.limit(0), df).count() == 0
    assert N.search(df.where("vec_id = 3"), df).count() == 0


def test_hot_vector_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 50)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((q, r, v) for q, r, v, _ in N.search(df, df.where("vec_id % 50 = 0")).collect())
    want = sorted((q, r, v) for q, r, v, _ in N.brute_force(np.arange(600), x, np.arange(0, 600, 50)))
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert [g for g in got if g[0] == 0] == [w for w in want if w[0] == 0]


def test_extreme_magnitudes_lose_nothing(spark):
    """Squares of such components overflow or vanish in double precision; cosines do not change with a vector's length."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6))
    factors = [1.0, 1e170, 1e-170, 1e300, 1e-300, 4.0]
    rows = [(i, [float(c * factors[i % 6]) for c in v]) for i, v in enumerate(x)]
    plain = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    frames = [spark.createDataFrame(r, "vec_id long, embedding array<double>") for r in (rows, plain)]
    got, want = (sorted(map(tuple, N.search(d, d.where("vec_id % 50 = 0")).collect())) for d in frames)
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) == 10
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want, strict=True))


def test_the_sample_grows_with_the_rows():
    size = lambda n: min(max(N.SAMPLE, int(N.GROWTH * n**0.5)), N.SAMPLE_MOST)
    assert size(10_000) == N.SAMPLE and size(10**7) > 400_000 and size(10**12) == N.SAMPLE_MOST


def test_best_with_many_ties_and_repeated_ids():
    ids = np.array([7] * 300 + list(range(10, 30)) + [3])
    v = np.concatenate([np.ones((300, 3)), np.ones((10, 3)), np.eye(3)[np.arange(10) % 3], -np.ones((1, 3))])
    q, w, s = N.best(np.ones((1, 3)), ids, v, 5, own=np.array([99]))
    assert w.tolist() == [7, 10, 11, 12, 13] and np.allclose(s, 1)
    q, w, s = N.best(np.ones((1, 3)), np.array([7] * 400 + [8, 9]), np.concatenate([np.ones((400, 3)), np.eye(3)[:2]]), 5)
    assert w.tolist() == [7, 8, 9]


def test_recall_where_most_lists_are_not_read(spark):
    """Twenty thousand vectors in loose groups, indexed on a sample of a tenth: a query reads a small part of the lists."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 24))
    x = (centres[rng.integers(0, 300, 20_000)] + 0.6 * rng.normal(size=(20_000, 24))).astype(np.float32)
    index = N.Index(N.fit(N.unit(x[::10].astype(np.float64)), leaf=16))
    sizes = np.bincount(index.lists(N.unit(x.astype(np.float64)))[1], minlength=len(index.centroids))
    queries = np.arange(0, 20_000, 400)
    row, own = index.probes(N.unit(x[queries].astype(np.float64)), sizes)
    assert len(own) < 0.4 * len(queries) * len(index.centroids)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {(q, v) for q, _, v, _ in N.search(df, df.where("vec_id % 400 = 0"), sample=2000, leaf=16).collect()}
    want = {(q, v) for q, _, v, _ in N.brute_force(np.arange(20_000), x, queries)}
    assert len(got & want) >= 0.9 * len(want)


def test_many_queries_and_rows_on_one_vector(spark, monkeypatch):
    """A third of the rows, and of the queries, share a vector: it is one query and a few candidates, and no group has more rows or queries than its pieces."""
    monkeypatch.setattr(N, "PIECE", 40)
    monkeypatch.setattr(N, "ASKED", 8)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6))
    x[::3] = x[0]
    x[1::30] = -x[0]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    assert N.candidates(df.select(df.vec_id.alias("id"), df.embedding.alias("v")), 5).count() == 1500 - 500 - 50 + 2 * 6
    got = sorted((q, r, v) for q, r, v, _ in N.search(df, df.where("vec_id % 2 = 0"), sample=200, leaf=8).collect())
    want = sorted((q, r, v) for q, r, v, _ in N.brute_force(np.arange(1500), x, np.arange(0, 1500, 2)))
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.9 * len(want)
    assert [g for g in got if g[0] % 3 == 0] == [w for w in want if w[0] % 3 == 0]


def test_a_sample_that_the_driver_does_not_fit(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 12))
    x = centres[rng.integers(0, 60, 6000)] + 0.5 * rng.normal(size=(6000, 12))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    usable = N.candidates(df.select(df.vec_id.alias("id"), df.embedding.alias("v")), 5)
    found = N.centroids(usable, 12, 6000, 4000, 16, most=500)
    assert 4000 / 16 / 2 <= len(found) <= 4 * 4000 / 16 and np.allclose(np.linalg.norm(found, axis=1), 1, atol=1e-5)
    got = {(q, v) for q, _, v, _ in N.search(df, df.where("vec_id % 50 = 0"), sample=4000, leaf=16, most=500).collect()}
    want = {(q, v) for q, _, v, _ in N.brute_force(np.arange(6000), x, np.arange(0, 6000, 50))}
    assert len(got & want) >= 0.9 * len(want)


def test_queries_that_share_an_id_or_a_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (50, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9]), (3, [-1.0, 0.2]), (4, [0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in N.search(df, df.where("vec_id % 50 = 0"), k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 50), (0, 1), (50, 0), (50, 1)]
