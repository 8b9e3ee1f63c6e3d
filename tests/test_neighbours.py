"""The exact neighbour search and the cluster of the nearest member, against all pairs."""

import numpy as np
import pytest

from voxlake.operators import neighbours
from voxlake.plans.joins import nearest_of


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def clustered(n, groups, noise, seed):
    rng = np.random.default_rng(seed)
    return unit(unit(rng.normal(size=(groups, 8)))[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, 8)))


@pytest.mark.parametrize("noise,fewer", [(0.02, True), (3.0, False)])
def test_nearest_equals_all_pairs(spark, noise, fewer):
    x = clustered(1500, 40, noise, 1)
    marks = np.random.default_rng(2).integers(0, 9, len(x))
    df = spark.createDataFrame([(k, int(m), [float(y) for y in v]) for k, (m, v) in enumerate(zip(marks, x, strict=True))], "key long, mark long, v array<double>").repartition(5)
    found = neighbours.nearest(df, pivots=32, block=16)
    top, mark, _ = neighbours.best(x, np.arange(len(x)), x, np.arange(len(x)), marks)
    got = {r.key: (r.cosine, r.mark) for r in found.found.collect()}
    assert got == {k: (top[k], mark[k]) for k in range(len(x))}
    assert found.compared <= found.whole and (not fewer or found.compared < 0.3 * found.whole)
    print(noise, found.compared, found.whole)


def test_work_grows_slower_than_the_square(spark):
    shares = []
    for n in (600, 2400):
        x = clustered(n, n // 40, 0.02, 3)
        df = spark.createDataFrame([(k, 0, [float(y) for y in v]) for k, v in enumerate(x)], "key long, mark long, v array<double>")
        found = neighbours.nearest(df, block=16)
        shares.append(found.compared / found.whole)
    assert shares[1] < 0.8 * shares[0]


def test_few_vectors(spark):
    kind = "key long, mark long, v array<double>"
    assert neighbours.nearest(spark.createDataFrame([], kind)).found.collect() == []
    assert neighbours.nearest(spark.createDataFrame([(1, 5, [1.0, 0.0])], kind)).found.collect() == []
    both = neighbours.nearest(spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, 6, [0.6, 0.8])], kind)).found.collect()
    assert {r.key: (r.cosine, r.mark) for r in both} == {1: (0.6, 6), 2: (0.6, 5)}


def slow_cluster(rows):
    """By all rows and all means."""
    labels = sorted({c for _, c, _ in rows if c is not None})
    means = {c: np.mean([v for _, x, v in rows if x == c], axis=0) for c in labels}
    cos = lambda a, b: 0.0 if not np.any(a) or not np.any(b) else round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 8)
    out = []
    for i, (key, _, v) in enumerate(rows):
        options = [(cos(v, m), -c) for c, m in means.items()] + [(cos(v, w), -c) for j, (_, c, w) in enumerate(rows) if j != i and c is not None]
        best = max(options)
        out.append((key, -best[1], round(best[0], 6)))
    return sorted(out)


def test_clusters_of_repeated_zero_and_unlabelled_vectors(spark):
    rng = np.random.default_rng(4)
    few = rng.normal(size=(12, 6)).round(3)
    rows = [(k, int(rng.integers(0, 4)), few[rng.integers(0, 12)] * rng.choice([1.0, 2.0])) for k in range(60)] + [(100 + k, 5 + k, rng.normal(size=6)) for k in range(5)] + [(200, None, few[0]), (201, None, rng.normal(size=6)), (202, 1, np.zeros(6)), (203, None, np.zeros(6))]
    df = spark.createDataFrame([(k, c, [float(x) for x in v]) for k, c, v in rows], "vec_id long, label int, v array<double>")
    assert sorted((r.vec_id, r.cluster, r.score) for r in nearest_of(df, pivots=4, block=8).collect()) == slow_cluster(rows)
    assert nearest_of(df.limit(0)).collect() == []


def test_vectors_are_not_shuffled_for_pairs(spark):
    """Blocks meet as a product of partitions; what a task finds is one row for each key."""
    x = clustered(400, 4, 3.0, 5)
    df = spark.createDataFrame([(k, k % 3, [float(y) for y in v]) for k, v in enumerate(x)], "key long, mark long, v array<double>").repartition(3)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = neighbours.nearest(df, pivots=4, block=16)
        plan = found.found._jdf.queryExecution().sparkPlan().toString() + found.found._jdf.queryExecution().executedPlan().toString()
        got = {r.key: (r.cosine, r.mark) for r in found.found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found.compared > 100 and "CartesianProduct" in plan
    assert {line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line} == {"key"}
    top, mark, _ = neighbours.best(x, np.arange(len(x)), x, np.arange(len(x)), np.arange(len(x)) % 3)
    assert got == {k: (top[k], mark[k]) for k in range(len(x))}
    part = [np.array(c) for c in ([5, 5, 2, 5], [0.5, 0.9, 0.1, 0.9], [1, 8, 3, 4])]
    assert [c.tolist() for c in neighbours.foremost([tuple(part)] * 2)] == [[2, 5], [0.1, 0.9], [3, 4]]
