"""A simplex search from several starts whose steps are scored together: one job for each step, however many starts there are."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np

# Fixed values of the method: how far a worst point is reflected, stretched, drawn in, and the others shrunk.
REFLECT, STRETCH, DRAW, SHRINK = 1.0, 2.0, 0.5, 0.5

Score = Callable[[np.ndarray], np.ndarray]


class Reached(NamedTuple):
    start: int
    point: tuple[float, ...]
    value: float
    steps: int


def maximised(score: Score, starts: Sequence[Sequence[float]], *, low: float = 0.0, high: float = 4.0, side: float = 0.5, steps: int = 60, tolerance: float = 1e-3) -> list[Reached]:
    """The best point that each start's simplex reaches, within low to high. score: points (rows) to values, all of a step's at once.

    A step asks for everything that any simplex may need next: the reflected, the stretched and the two drawn-in points, and the shrunken simplex. Of equal values the point
    that was there first counts. A simplex rests when its points are within tolerance of each other and as good; all steps end when all rest.
    """
    inside = lambda p: np.clip(p, low, high)
    dim = len(starts[0])
    corners = np.stack([np.concatenate([[s], [np.asarray(s) + side * e * (1 if s[k] + side <= high else -1) for k, e in enumerate(np.eye(dim))]]) for s in map(lambda s: inside(np.asarray(s, float)), starts)])
    values = score(corners.reshape(-1, dim)).reshape(len(starts), dim + 1)
    rests, taken = np.zeros(len(starts), bool), np.zeros(len(starts), int)
    for _ in range(steps):
        order = np.argsort(-values, axis=1, kind="stable")
        corners, values = np.take_along_axis(corners, order[:, :, None], axis=1), np.take_along_axis(values, order, axis=1)
        rests |= (np.ptp(corners, axis=1).max(axis=1) < tolerance) & (np.ptp(values, axis=1) < 1e-9)
        live = np.flatnonzero(~rests)
        if not len(live):
            break
        best, worst = corners[live, 0], corners[live, -1]
        middle = corners[live, :-1].mean(axis=1)
        along = lambda t, middle=middle, worst=worst: inside(middle + t * (middle - worst))
        single = np.stack([along(REFLECT), along(STRETCH), along(DRAW), along(-DRAW)], axis=1)
        shrunk = best[:, None] + SHRINK * (corners[live, 1:] - best[:, None])
        asked = np.concatenate([single, shrunk], axis=1)
        found = score(asked.reshape(-1, dim)).reshape(len(live), -1)
        for k, (own, v) in enumerate(zip(live, found, strict=True)):
            taken[own] += 1
            reflected, stretched, outer, inner = v[:4]
            if reflected > values[own, 0]:
                at = 1 if stretched > reflected else 0
            elif reflected > values[own, -2]:
                at = 0
            elif reflected > values[own, -1] and outer >= reflected:
                at = 2
            elif reflected <= values[own, -1] and inner > values[own, -1]:
                at = 3
            else:
                corners[own, 1:], values[own, 1:] = shrunk[k], v[4:]
                continue
            corners[own, -1], values[own, -1] = asked[k, at], v[at]
    first = values.argmax(axis=1)
    return [Reached(k, tuple(float(x) for x in corners[k, first[k]]), float(values[k, first[k]]), int(taken[k])) for k in range(len(starts))]
