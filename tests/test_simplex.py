"""The simplex search on functions whose best point is known, and on the fusion's weights."""

import numpy as np
import pytest

from voxlake.ml import simplex
from voxlake.plans import catalog


def test_smooth_functions():
    calls = []

    def score(points):
        calls.append(len(points))
        return -((points - np.array([1.2, 3.1, 0.4])) ** 2 * np.array([1, 5, 0.5])).sum(axis=1)

    found = simplex.maximised(score, [(0, 0, 0), (4, 4, 4), (2, 0, 3)], steps=200, tolerance=1e-6)
    assert all(r.point == pytest.approx((1.2, 3.1, 0.4), abs=1e-3) and r.value == pytest.approx(0, abs=1e-5) for r in found)
    assert len(calls) == 1 + max(r.steps for r in found)  # one batch for the start, and one for each step of all


def test_bounds_plateaus_and_edges():
    edge = simplex.maximised(lambda p: p.sum(axis=1), [(0.0, 0.0)], steps=200)[0]
    assert edge.value == pytest.approx(8, abs=1e-2) and all(0 <= x <= 4 for x in edge.point)
    flat = simplex.maximised(lambda p: np.zeros(len(p)), [(1.0, 1.0), (4.0, 4.0)], steps=100)
    assert [r.value for r in flat] == [0, 0] and all(r.steps < 100 for r in flat)
    steps = simplex.maximised(lambda p: np.floor(p[:, 0]), [(0.2,), (3.0,)], steps=50)
    assert max(r.value for r in steps) >= 3


def test_M05b_is_no_worse_than_the_grid(spark):
    folder = "/root/testdata/sf0.001"
    rows = catalog.queries()["M05b_simplex_search"](spark, folder).collect()
    grid = max(r.macro_f1 for r in catalog.queries()["M05_weight_search"](spark, folder).collect())
    assert len(rows) == 5 and [r.best for r in rows].count(True) == 1
    assert next(r.macro_f1 for r in rows if r.best) == max(r.macro_f1 for r in rows) >= grid
