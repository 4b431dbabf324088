"""Minimisation of many small bounded problems at once."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

#: Rounds of a search; each halves the step.
ROUNDS = 8


def offsets(step: tuple[float, ...]) -> list[tuple[int, ...]]:
    """The places around a point, itself first; a dimension with step 0 stays as it is."""
    return list(itertools.product(*[(0, -1, 1) if s else (0,) for s in step]))


def pattern_search(error: Callable[[np.ndarray], np.ndarray], start: np.ndarray, step: tuple[float, ...], low: tuple[float, ...], high: tuple[float, ...], rounds: int = ROUNDS) -> np.ndarray:
    """The points that all rows of ``start`` (rows x dimensions) reach in steps together.

    In each round a row goes to the best of its point and the places one step away, within the bounds, and the step is halved. ``error`` maps
    (rows, places, dimensions) to (rows, places). Of equal errors the first place wins and the point itself comes first, so no row ever gets worse; nan counts as worst.
    """
    around, size, best = np.array(offsets(step), float), np.array(step, float), np.asarray(start, float)
    rows = np.arange(len(best))
    for _ in range(rounds):
        points = best[:, None, :] + around[None] * size
        points = np.where(size > 0, np.clip(points, low, high), points)
        value = error(points)
        best = points[rows, np.where(np.isnan(value), np.inf, value).argmin(1)]
        size = size / 2
    return best
