"""4 x 4 matrices on the driver, and boxes through them as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[float]]


def identity() -> Matrix:
    return np.eye(4).tolist()


def translation(x: float, y: float, z: float) -> Matrix:
    m = np.eye(4)
    m[:3, 3] = x, y, z
    return m.tolist()


def scaling(x: float, y: float | None = None, z: float | None = None) -> Matrix:
    return np.diag([x, x if y is None else y, x if z is None else z, 1.0]).tolist()


def rotation(axis: Sequence[float], degrees: float) -> Matrix:
    """About an axis, right-handed (Rodrigues' formula)."""
    x, y, z = np.array(axis, float) / np.linalg.norm(axis)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    m = np.eye(4)
    m[:3, :3] = np.eye(3) + s * k + (1 - c) * (k @ k)
    return m.tolist()


def composed(*matrices: Matrix) -> Matrix:
    """The first applies first."""
    m = np.eye(4)
    for t in matrices:
        m = np.array(t) @ m
    return m.tolist()


def inverse(m: Matrix) -> Matrix:
    return np.linalg.inv(np.array(m)).tolist()


def look_at(eye: Sequence[float], target: Sequence[float], up: Sequence[float] = (0, 1, 0)) -> Matrix:
    back = np.array(eye, float) - np.array(target, float)
    back /= np.linalg.norm(back)
    right = np.cross(up, back)
    right /= np.linalg.norm(right)
    m = np.eye(4)
    m[:3, :3] = right, np.cross(back, right), back
    m[:3, 3] = -m[:3, :3] @ np.array(eye, float)
    return m.tolist()


def permutation_parity(order: Sequence[int]) -> int:
    """1 for an odd number of transpositions."""
    return sum(order[i] > order[j] for i in range(len(order)) for j in range(i + 1, len(order))) % 2


def moved_box(low: Sequence[Column], high: Sequence[Column], m: Matrix) -> tuple[list[Column], list[Column]]:
    """Bounds of a box's eight corners after a matrix."""
    lows, highs = [], []
    for i in range(3):
        corners = [sum((F.lit(m[i][j]) * (high[j] if c else low[j]) for j, c in enumerate(pick)), F.lit(m[i][3])) for pick in product((0, 1), repeat=3)]
        lows.append(F.least(*corners))
        highs.append(F.greatest(*corners))
    return lows, highs


def merged_box(low: Sequence[Column], high: Sequence[Column], low2: Sequence[Column], high2: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """The union of boxes; a shorter one is padded with the other's axes (nulls are skipped)."""
    n = max(len(low), len(low2))
    pick = lambda xs, i: [xs[i]] if i < len(xs) else []

    def join(f, a: Sequence[Column], b: Sequence[Column], i: int) -> Column:
        both = [*pick(a, i), *pick(b, i)]
        return f(*both) if len(both) > 1 else both[0]

    return [join(F.least, low, low2, i) for i in range(n)], [join(F.greatest, high, high2, i) for i in range(n)]
