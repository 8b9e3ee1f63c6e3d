import hashlib
import math

import numpy as np
import pytest

from tests.compare import compare, duck
from voxlake.llm import centroids, queries


def slow(rows, clusters=8, rounds=10, dim=64):
    """Lloyd's rounds with Python's integers: (id, cluster, distance) of each usable row, the final centroids."""
    kept = [(i, [math.floor(x * 1024) if abs(x) < 1 << 53 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), list(map(str, v))) for i, v in kept if i is not None)
    cs = [list(map(int, v)) for _, v in named[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    find = lambda v: min((far(v, c), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        own = [[] for _ in cs]
        for _, v in kept:
            own[find(v)[1]].append(v)
        cs = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(own, cs, strict=True)]
    return [(i, find(v)[1], find(v)[0]) for i, v in kept], cs


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroids.cluster(df.repartition(3), **more).collect()
    want, cs = slow(rows, **more)
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=key) == sorted([(i, c, fits(d)) for i, c, d in want], key=key)
    for r in got:
        ours = [d for _, c, d in want if c == r.cluster]
        if all(fits(d) is not None for d in ours):
            assert r.cluster_inertia == fits(sum(ours))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()
    return got


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    compare(queries.QUERIES["op11_centroids"](spark, folder), duck(folder), queries.ORACLE_SQL["op11_centroids"])


def test_equals_slow_rounds(spark):
    rng = np.random.default_rng(1)
    check(spark, [(k, (rng.normal(size=64) + 2 * (k % 5)).tolist()) for k in range(300)])


def test_ties_empty_clusters_and_repeated_rows(spark):
    same = [0.5] * 64
    rng = np.random.default_rng(2)
    few = [(rng.integers(-1, 2, 64) / 2).tolist() for _ in range(4)]
    check(spark, [(k % 20, few[k % 4]) for k in range(60)] + [(7, same)] * 40 + [(None, same), (None, few[0])])


def test_odd_vectors_take_no_part(spark):
    one = [0.25] * 64
    rows = [(1, None), (2, []), (3, one[:-1]), (4, [*one, 1.0]), (5, [None, *one[1:]]), (6, [math.nan, *one[1:]]), (7, [math.inf, *one[1:]]), (8, one), (9, [-0.0001] * 64)]
    got = check(spark, rows)
    assert {r.vec_id for r in got} == {8, 9}


@pytest.mark.parametrize("size", [1e6, 1e30, 1.7e308])
def test_huge_components_are_exact(spark, size):
    rng = np.random.default_rng(3)
    check(spark, [(k, (rng.normal(size=64) * (size / 8 if k % 3 == 0 else 1)).tolist()) for k in range(60)], rounds=3)


def test_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, cluster string")
    assert centroids.cluster(empty).collect() == []
    assert centroids.cluster(spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<float>")).collect() == []


def test_clashing_names(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=64).tolist(), "x", k) for k in range(30)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance long")).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(slow([r[:2] for r in rows])[0])


def test_partial_distances_equal_whole_ones():
    rng = np.random.default_rng(5)
    for _ in range(20):
        v, c = rng.integers(-3, 4, (200, 64)), rng.integers(-3, 4, (8, 64))
        c[5] = c[2]
        full = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        which, far = centroids.nearest(v, c, rng.permutation(64))
        assert (which == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()


def test_limbs():
    for x in (0, 1, -1, 1 << 40, -(1 << 40), 3**200, -(3**200)):
        assert sum(v << centroids.LIMB * k for k, v in enumerate(centroids.limbs(x))) == x and all(abs(v) <= 1 << centroids.LIMB for v in centroids.limbs(x))
