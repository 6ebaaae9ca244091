"""Slices of n-dimensional rows: membership, radii on the slice, projections, clipped segments."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import DISCRETE_REACH, UNSLICED, View

LEAST_AMPLITUDE = 1e-6


def every(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def near(x: Column, at: float, reach: float) -> Column:
    """at - reach <= x <= at + reach as plain bounds, which reach the scan; NaN fails."""
    return (x >= at - reach) & (x <= at + reach) & ~F.isnan(x)


def member(view: View) -> Column:
    """Rows on the slice: every sliced hidden axis within half a unit (discrete) or its tolerance."""
    return every([F.abs(F.col(d.name) - view.at(d)) <= (DISCRETE_REACH if d.discrete else view.within(d)) for d in view.sliced()])


def slice_points(df: DataFrame, view: View) -> DataFrame:
    """Rows on the slice. The bounds are stated as well as the distance, so that files are skipped by statistics."""
    bounds = [near(F.col(d.name).cast("double"), view.at(d), (DISCRETE_REACH if d.discrete else view.within(d)) + 1e-9) for d in view.sliced()]
    return df.filter(every(bounds)).filter(member(view))


def squared_distance(view: View) -> Column:
    gaps = [(F.col(d.name) - view.at(d)) * (F.col(d.name) - view.at(d)) for d in view.sliced() if not d.discrete]
    return reduce(lambda a, b: a + b, gaps, F.lit(0.0))


def slice_spheres(df: DataFrame, view: View, radius: Column, out: str = "radius", max_radius: float | None = None) -> DataFrame:
    """Spheres cut by the slice, with the radius of the cut; discrete axes gate at half a unit, a sphere that only touches has no cut.

    Gates are stated as plain bounds too, which reach the scan; so do those of the continuous
    axes where ``max_radius``, the greatest radius of the table, is given.
    """
    gates = [F.abs(F.col(d.name) - view.at(d)) <= DISCRETE_REACH for d in view.sliced() if d.discrete]
    gates += [near(F.col(d.name).cast("double"), view.at(d), DISCRETE_REACH + 1e-9) for d in view.sliced() if d.discrete]
    if max_radius is not None:
        gates += [near(F.col(d.name).cast("double"), view.at(d), max_radius + 1e-9) for d in view.sliced() if not d.discrete]
    gap = squared_distance(view)
    return df.filter(every(gates)).filter(gap < radius * radius).withColumn(out, F.sqrt(radius * radius - gap))


def project(df: DataFrame, axes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """x, y, z from up to three axes in the order given; missing ones are 0."""
    named = [F.col(axes[i]).cast("double") if i < len(axes) else F.lit(0.0) for i in range(3)]
    return df.select(*keep, *[c.alias(n) for c, n in zip(named, "xyz", strict=True)])


def slice_splats(df: DataFrame, view: View, amplitude: str, sigmas: dict[str, Column], max_amplitude: float | None = None, max_sigmas: dict[str, float] | None = None) -> DataFrame:
    """Axis-aligned splats on the slice: discrete axes gate at half a step, continuous ones attenuate by their Gaussian.

    Rows fainter than a millionth go only where a continuous hidden axis attenuates. Gates
    are stated as plain bounds too, which reach the scan; with the table's greatest amplitude
    and sigmas so is how far a splat can lie from the slice and still be seen.
    """
    gates = [F.abs(F.col(d.name) - view.at(d)) <= DISCRETE_REACH * d.stepping() for d in view.sliced() if d.discrete]
    gates += [near(F.col(d.name).cast("double"), view.at(d), DISCRETE_REACH * d.stepping() + 1e-9) for d in view.sliced() if d.discrete]
    if max_amplitude is not None and max_sigmas is not None and max_amplitude > 0:
        far = math.sqrt(2 * max(0.0, math.log(max_amplitude / LEAST_AMPLITUDE))) + 1e-6
        gates += [near(F.col(d.name).cast("double"), view.at(d), far * max_sigmas[d.name]) for d in view.hidden() if not d.discrete and d.name not in view.extend]
    smooth = [d for d in view.hidden() if not d.discrete and d.name not in view.extend]
    exponent = reduce(lambda a, b: a + b, [F.pow((F.col(d.name) - view.at(d)) / F.nullif(sigmas[d.name], F.lit(0.0)), 2) for d in smooth], F.lit(0.0))
    out = df.filter(every(gates)).withColumn("sliced_amplitude", F.col(amplitude) * F.exp(-exponent / 2))
    return out.filter(F.col("sliced_amplitude") >= LEAST_AMPLITUDE) if smooth else out


def in_slab(view: View, axes: dict[str, Column]) -> Column:
    """Vertices within the tolerance on every hidden axis; NaN and infinite coordinates are out even where the axis is not sliced."""
    finite = [~F.isnan(axes[d.name]) & (F.abs(axes[d.name]) < F.lit(float("inf"))) for d in view.hidden()]
    inside = [axes[d.name].between(view.at(d) - view.within(d), view.at(d) + view.within(d)) for d in view.sliced()]
    return every([*finite, *inside])


def clip_segments(df: DataFrame, view: View, start: str = "a_", end: str = "b_", lerp: Sequence[str] = ()) -> DataFrame:
    """Segments clipped to the slab of the sliced axes: those outside go, others get t0..t1 and interpolated ends.

    Columns are ``start``/``end`` + axis; ``lerp`` names further columns that have both prefixes.
    """
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    alive = []
    for d in view.sliced():
        reach = DISCRETE_REACH if d.discrete else view.within(d)
        a, b = F.col(start + d.name), F.col(end + d.name)
        run = b - a
        t = [(F.lit(view.at(d) + s * reach) - a) / F.nullif(run, F.lit(0.0)) for s in (-1, 1)]
        low.append(F.coalesce(F.least(*t), F.lit(0.0)))
        high.append(F.coalesce(F.greatest(*t), F.lit(1.0)))
        alive.append((run != 0) | (F.abs(a - view.at(d)) <= reach))
    t0 = F.greatest(*low) if len(low) > 1 else low[0]
    t1 = F.least(*high) if len(high) > 1 else high[0]
    kept = df.withColumn("t0", t0).withColumn("t1", t1).filter(every(alive)).filter("t0 <= t1")
    axes = [*(d.name for d in view.dims), *lerp]
    ends = {}
    for x in axes:
        a, b = F.col(start + x), F.col(end + x)
        ends[start + x], ends[end + x] = a + (b - a) * F.col("t0"), a + (b - a) * F.col("t1")
    return kept.withColumns(ends)


def parts_on_slice(parts: DataFrame, view: View) -> DataFrame:
    """Parts (columns ``lo_``/``hi_`` + axis) whose bounds a slice can meet; only discrete, non-spatial axes that are not extended prune."""
    from ..dims import partition_margin

    checks = []
    for d in view.hidden():
        if d.discrete and not d.spatial and d.name not in view.extend:
            margin = partition_margin(d.stepping(), view.at(d))
            checks.append((F.col(f"hi_{d.name}") >= view.at(d) - margin) & (F.col(f"lo_{d.name}") <= view.at(d) + margin))
    return parts.filter(every(checks))


def sliced_dims(view: View) -> dict[str, list[str]]:
    """Hidden axes by how they restrict: extend, discrete, continuous."""
    out: dict[str, list[str]] = {"extend": [], "discrete": [], "continuous": []}
    for d in view.hidden():
        out["extend" if view.within(d) >= UNSLICED else "discrete" if d.discrete else "continuous"].append(d.name)
    return out
