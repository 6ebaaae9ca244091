"""Mixtures compared and merged: kernel sums over near pairs, greedy merging within tiles, seeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import covariance
from .neighbors import bucketed, dealt
from .ordering import held, met, ranked, sized


#: Largest sigmas within which pairs are summed: beyond, a pair adds under e^-36 of its peak, less than a double holds.
REACH = 12.0


def reach_of(parts: Sequence[DataFrame], sigmas: Sequence[str]) -> float:
    """A cell width that holds ``REACH`` of the largest sigma of all parts."""
    widest = [df.agg(F.greatest(*[F.max(s) for s in sigmas]) if len(sigmas) > 1 else F.max(sigmas[0])).first()[0] for df in parts]
    return REACH * max((w for w in widest if w), default=1.0)


#: Splats of a cell that one task pairs with those around it; more are dealt to several.
PAIRED = 512


def alike(df: DataFrame, axes: Sequence[str], sigmas: Sequence[str], amplitude: str) -> DataFrame:
    """A splat for each center and width: the kernel is linear in the amplitude, so those of equal splats are summed."""
    return df.groupBy(*axes, *sigmas).agg(F.sum(amplitude).alias(amplitude))


def inner_product(a: DataFrame, b: DataFrame, axes: Sequence[str], sigmas: Sequence[str], amplitude: str, cell: float | None = None) -> DataFrame:
    """One row: the sum of pair kernels over splats whose centers lie in the same or touching cells, which is the whole sum to double precision.

    The cell follows from the largest sigma; a narrower one is refused. Equal splats are
    one, and pairs meet by an equi-join on cells, dense ones in several tasks.
    """
    needed = reach_of([a, b], sigmas)
    if cell is not None and cell < needed:
        raise ValueError(f"a cell of {cell} would lose pairs: {needed} are needed")
    cell = cell or needed
    a, b = alike(a, axes, sigmas, amplitude), alike(b, axes, sigmas, amplitude)
    names = [f"a_{x}" for x in (*axes, *sigmas)]
    p = bucketed(held(a.select(F.col(amplitude).alias("a_amp"), *[F.col(x).alias(f"a_{x}") for x in (*axes, *sigmas)])), names[: len(axes)], cell)
    q = bucketed(b.select(F.col(amplitude).alias("b_amp"), *[F.col(x).alias(f"b_{x}") for x in (*axes, *sigmas)]), [f"b_{x}" for x in axes], cell, 1)
    p, q, cells = dealt(p, q, [f"__k{i}" for i in range(len(axes))], names, PAIRED)
    kernel = covariance.pair_kernel(F.col("a_amp"), [F.col(f"a_{x}") for x in axes], [F.col(f"a_{s}") for s in sigmas], F.col("b_amp"), [F.col(f"b_{x}") for x in axes], [F.col(f"b_{s}") for s in sigmas])
    return met(q, p, cells).agg(F.coalesce(F.sum(kernel), F.lit(0.0)).alias("inner"))


def similarity(a: DataFrame, b: DataFrame, axes: Sequence[str], sigmas: Sequence[str], amplitude: str, cell: float | None = None) -> DataFrame:
    """One row: 1 - |a - b|^2 / |b|^2, held in 0..1."""
    a, b = held(alike(a, axes, sigmas, amplitude)), held(alike(b, axes, sigmas, amplitude))
    products = [inner_product(x, y, axes, sigmas, amplitude, cell).withColumnRenamed("inner", n) for x, y, n in ((a, a, "aa"), (a, b, "ab"), (b, b, "bb"))]
    joined = products[0].crossJoin(products[1]).crossJoin(products[2])  # a row each
    q = 1 - (F.col("aa") - 2 * F.col("ab") + F.col("bb")) / F.nullif(F.col("bb"), F.lit(0.0))
    return joined.select(F.coalesce(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("quality"))


def agglomerated(mu: np.ndarray, var: np.ndarray, mass: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows merged, always the two of least cost, until ``target`` are left; of equal costs the first pair.

    Each row keeps its cheapest later partner, so a merge takes time in proportion to the
    rows (and more only where a partner was merged away), and memory does too.
    """
    mu, var, mass = mu.copy(), var.copy(), mass.copy()
    n = len(mu)
    alive = np.ones(n, bool)
    least, partner = np.full(n, np.inf), np.full(n, -1)

    def costs(i: int, others: np.ndarray) -> np.ndarray:
        gap = ((mu[others] - mu[i]) ** 2).sum(-1)
        return gap * (mass[others] * mass[i] / np.maximum(mass[others] + mass[i], 1e-300))

    def renew(i: int) -> None:
        later = np.flatnonzero(alive[i + 1 :]) + i + 1
        if len(later):
            c = costs(i, later)
            k = int(c.argmin())
            least[i], partner[i] = c[k], later[k]
        else:
            least[i], partner[i] = np.inf, -1

    for i in range(n):
        renew(i)
    for _ in range(n - target):
        i = int(np.where(alive, least, np.inf).argmin())
        j = int(partner[i])
        total = mass[i] + mass[j]
        w = np.array([mass[i], mass[j]]) / total if total > 0 else np.array([0.5, 0.5])
        mean = np.where(mu[i] == mu[j], mu[i], w[0] * mu[i] + w[1] * mu[j])  # rows of one center stay at it
        var[i] = w[0] * (var[i] + mu[i] ** 2) + w[1] * (var[j] + mu[j] ** 2) - mean**2
        mu[i], mass[i], alive[j] = mean, total, False
        renew(i)
        before = np.flatnonzero(alive[:i])
        c = costs(i, before)
        closer = (c < least[before]) | ((c == least[before]) & (i < partner[before]))
        stale = np.isin(partner[before], (i, j)) & ~closer
        least[before[closer]], partner[before[closer]] = c[closer], i
        for k in [*before[stale].tolist(), *(np.flatnonzero(alive[i + 1 : j] & (partner[i + 1 : j] == j)) + i + 1).tolist()]:
            renew(k)
    return mu[alive], var[alive], mass[alive]


def greedy_merge(df: DataFrame, axes: Sequence[str], sigmas: Sequence[str], amplitude: str, tile: float, share: float) -> DataFrame:
    """Within tiles, the two rows whose merging moves least mass become one until a share of the rows is left.

    Rows of one center merge at no cost, so they do first, center by center in order: of
    each tile so many as its share asks for, by sums over all tasks. Only tiles that need
    further merges, and those with rows without a positive mass (which merge at no cost as
    well), are agglomerated: that is sequential, so such a tile is one group, and a merge
    takes time in proportion to its rows: choose tiles that hold some ten thousands of
    centers at most. Masses, means and variances are kept by moment matching.
    """
    names = [*axes, *sigmas, amplitude]
    d = len(axes)
    tiles = [f"__t{i}" for i in range(d)]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame[names].sort_values(names).to_numpy(float)
        mu, var, mass = agglomerated(rows[:, :d], rows[:, d : 2 * d] ** 2, rows[:, -1] * rows[:, d : 2 * d].prod(1), int(frame["__target"].iloc[0]))
        sigma = np.sqrt(np.maximum(var, 1e-24))
        return pd.DataFrame(np.hstack([mu, sigma, (mass / sigma.prod(1))[:, None]]), columns=names)

    placed = df.select(*[F.col(n).cast("double").alias(n) for n in names], *[F.floor(F.col(a) / tile).alias(t) for a, t in zip(axes, tiles, strict=True)])
    mass = covariance.mass(F.col(amplitude), [F.col(s) for s in sigmas])
    sound = reduce(lambda x, y: x & y, [F.col(n).isNotNull() & ~F.isnan(n) for n in names]) & (mass > 0) & (mass < float("inf"))
    centers = placed.groupBy(*tiles, *axes).agg(F.count("*").alias("__n"), F.min(sound).alias("__sound"))
    whole, before = Window.partitionBy(*tiles), Window.partitionBy(*tiles).orderBy(*axes).rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("__n").over(whole)
    wanted = F.greatest(F.lit(1), F.rint(share * size).cast("bigint"))
    centers = centers.withColumns({"__target": wanted, "__spare": size - wanted, "__all": F.min("__sound").over(whole), "__free": F.sum(F.col("__n") - 1).over(whole), "__used": F.coalesce(F.sum(F.col("__n") - 1).over(before), F.lit(0))})
    merges = F.when(F.col("__all"), F.greatest(F.lit(0), F.least(F.col("__n") - 1, F.col("__spare") - F.col("__used")))).otherwise(0)
    further = ~F.col("__all") | (F.col("__free") < F.col("__spare"))
    centers = held(centers.select(*tiles, *axes, "__n", "__target", merges.alias("__merges"), further.alias("__further")))
    plan = centers.select(*[F.col(n).alias(f"__c_{n}") for n in (*tiles, *axes)], "__n", "__target", "__merges", "__further")
    same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__c_{n}")) for n in (*tiles, *axes)])
    rows = placed.join(sized(plan), same).drop(*[f"__c_{n}" for n in (*tiles, *axes)])

    def merged(rows: DataFrame) -> DataFrame:
        weighed = rows.withColumn("__m", mass)
        one_each = weighed.groupBy(*tiles, *axes, "__target", "__further").agg(F.sum("__m").alias("__m"), *[(F.sum(F.col("__m") * F.col(s) * F.col(s)) / F.sum("__m")).alias(f"__v_{s}") for s in sigmas])
        widths = {s: F.sqrt(F.greatest(F.col(f"__v_{s}"), F.lit(1e-24))) for s in sigmas}
        wide = one_each.select("*", *[w.alias(s) for s, w in widths.items()])
        return wide.select(*axes, *sigmas, (F.col("__m") / covariance.product([F.col(s) for s in sigmas])).alias(amplitude), *tiles, "__target", "__further")

    columns = [*names, *tiles, "__target", "__further"]
    none, some = F.col("__merges") == 0, F.col("__merges") < F.col("__n") - 1
    cut = ranked(held(rows.filter(~none & some)), [F.col(n) for n in (*tiles, *names)], "__rank")  # a tile has at most one center that is merged in part
    cut = cut.join(sized(cut.groupBy(*tiles).agg(F.min("__rank").alias("__first"))), tiles)
    left = rows.filter(none).select(*columns).unionByName(merged(rows.filter(~none & ~some)))
    head = F.col("__rank") - F.col("__first") <= F.col("__merges")
    left = held(left.unionByName(merged(cut.filter(head))).unionByName(cut.filter(~head).select(*columns)))
    done = left.filter(F.col("__further")).drop("__further").groupBy(*tiles).applyInPandas(one, ", ".join(f"{n} double" for n in names))
    widths = [F.sqrt(F.greatest(F.col(s) * F.col(s), F.lit(1e-24))).alias(s) for s in sigmas]
    ready = left.filter(~F.col("__further")).select(*axes, *widths, mass.alias("__m"))
    return ready.withColumn(amplitude, F.col("__m") / covariance.product([F.col(s) for s in sigmas])).drop("__m").unionByName(done)


def grid_seeds(df: DataFrame, axes: Sequence[str], spacing: Sequence[float], jitter: float = 0.0, seed: int = 42) -> DataFrame:
    """A regular grid over the data's box, each point moved by up to ``jitter`` spacings, by hash."""
    box = df.agg(*[f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = box
    for a, s in zip(axes, spacing, strict=True):
        steps = F.floor((F.col(f"hi_{a}") - F.col(f"lo_{a}")) / s).cast("int")
        out = out.withColumn(f"__i_{a}", F.explode(F.sequence(F.lit(0), steps)))
    for k, (a, s) in enumerate(zip(axes, spacing, strict=True)):
        u = F.pmod(F.xxhash64(F.lit(seed + k), *[f"__i_{x}" for x in axes]), F.lit(1_000_000)) / 1_000_000.0 - 0.5
        out = out.withColumn(a, F.col(f"lo_{a}") + (F.col(f"__i_{a}") + jitter * u) * s)
    return out.select(*axes)


def edge_strength(volume: DataFrame, axes: Sequence[str], value: str = "value") -> DataFrame:
    """Voxels with the length of the central-difference gradient; neighbours outside the volume count as the voxel itself."""
    out = volume
    for i, a in enumerate(axes):
        for sign, name in ((1, "up"), (-1, "down")):
            n = volume.select(*[(F.col(x) - sign if x == a else F.col(x)).alias(x) for x in axes], F.col(value).alias(f"__{name}{i}"))
            out = out.join(n, list(axes), "left")
    slopes = [(F.coalesce(f"__up{i}", value) - F.coalesce(f"__down{i}", value)) / 2 for i in range(len(axes))]
    return out.withColumn("edge", F.sqrt(sum((s * s for s in slopes), F.lit(0.0)))).select(*volume.columns, "edge")


def content_scan(peaks: DataFrame, axes: Sequence[str], cell: int = 16) -> DataFrame:
    """(cell_*, n): features in each cell of a grid."""
    from .raster import grid_histogram

    return grid_histogram(peaks, {a: float(cell) for a in axes})
