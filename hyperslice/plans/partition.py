"""Content-balanced binary space partitions, planned on the driver from an aggregated grid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import held

#: Cells of the content grid up to which it may come to the driver.
MAX_CELLS = 1 << 20


@dataclass(frozen=True)
class Box:
    low: tuple[float, ...]
    high: tuple[float, ...]
    weight: float

    def shape(self) -> tuple[float, ...]:
        return tuple(b - a for a, b in zip(self.low, self.high, strict=True))


def content_grid(df: DataFrame, axes: Sequence[str], cell: float, weight: Column | None = None, most: int = MAX_CELLS) -> tuple[np.ndarray, np.ndarray, float]:
    """(cells, weights, cell width) of the occupied cells. More than ``most`` are joined on the cluster to cells twice as wide until they can come to the driver."""
    grid = df.groupBy(*[F.floor(F.col(a) / cell).cast("bigint").alias(a) for a in axes]).agg((F.count("*") if weight is None else F.sum(weight)).cast("double").alias("__w"))
    grid = held(grid)
    while grid.count() > most:
        cell *= 2
        grid = held(grid.groupBy(*[F.floor(F.col(a) / 2).cast("bigint").alias(a) for a in axes]).agg(F.sum("__w").alias("__w")))
    rows = grid.orderBy(*axes).collect()
    return np.array([[r[a] for a in axes] for r in rows], np.int64).reshape(-1, len(axes)), np.array([r["__w"] for r in rows]), cell


def plan(cells: np.ndarray, weights: np.ndarray, cell: float, target: float, max_leaf: float = np.inf, min_leaf: float = 0.0) -> list[Box]:
    """Boxes of at most ``target`` weight and ``max_leaf`` size: the axis of the greatest spread times extent is cut at its weighted median cell."""
    if not len(cells):
        return []
    out: list[Box] = []

    def cut(which: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        w, total = weights[which], float(weights[which].sum())
        size = (high - low) * cell
        small = total <= target and (size <= max_leaf).all()
        best = None
        if not small:
            for axis in range(cells.shape[1]):
                if high[axis] - low[axis] < 2 or size[axis] < 2 * min_leaf:
                    continue
                x = cells[which, axis]
                mean = np.average(x, weights=w) if total > 0 else x.mean()
                spread = np.sqrt(np.average((x - mean) ** 2, weights=w)) if total > 0 else x.std()
                score = (spread + 1e-9) * size[axis]
                if best is None or score > best[0]:
                    best = (score, axis)
        if best is None:
            out.append(Box(tuple((low * cell).tolist()), tuple((high * cell).tolist()), total))
            return
        axis = best[1]
        x = cells[which, axis]
        order = np.argsort(x, kind="stable")
        median = x[order][np.searchsorted(np.cumsum(w[order]), total / 2)] + 1
        least = int(np.ceil(max(1.0, min_leaf / cell)))
        at = int(np.clip(median, low[axis] + least, high[axis] - least))
        at = int(np.clip(at, low[axis] + 1, high[axis] - 1))
        left = x < at
        high_left, low_right = high.copy(), low.copy()
        high_left[axis] = low_right[axis] = at
        cut(which[left], low, high_left)
        cut(which[~left], low_right, high)

    cut(np.arange(len(cells)), cells.min(0), cells.max(0) + 1)
    return out


def assign(df: DataFrame, boxes: Sequence[Box], axes: Sequence[str], out: str = "part") -> DataFrame:
    """Rows with the number of the box that holds them; boxes are few, so they are a column expression."""
    part = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(boxes))):
        inside = F.lit(True)
        for a, low, high in zip(axes, b.low, b.high, strict=True):
            inside = inside & (F.col(a) >= low) & (F.col(a) < high)
        part = F.when(inside, i).otherwise(part)
    return df.withColumn(out, part)


def overlap_fraction(boxes: Sequence[Box], overlap: float) -> tuple[float, float]:
    """(median, greatest) share of a box that its halo adds; of an even number the upper middle; (0, 0) without boxes."""
    shares = sorted(1 - float(np.prod([s / (s + 2 * overlap) for s in b.shape()])) for b in boxes)
    return (shares[len(shares) // 2], shares[-1]) if shares else (0.0, 0.0)


def needs_partition(rows: int, cap: int, wanted: bool | None = None) -> bool:
    return rows > cap if wanted is None else wanted
