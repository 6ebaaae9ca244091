"""Grids: rasterised splats, histograms, thresholds, quality of reconstructions. A volume is a DataFrame of integer axes and a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import held, quantiles, unsent


def render(splats: DataFrame, axes: Sequence[str], sigmas: Sequence[str], amplitude: str, shape: Sequence[int], truncate: float = 3.0, floor: float = 1e-5) -> DataFrame:
    """(axes, value): the sum of axis-aligned Gaussians at the integer voxels of ``shape`` within ``truncate`` sigmas; values under the floor go."""
    out = splats.filter(F.abs(amplitude) >= floor).select(F.col(amplitude).alias("__a"), *[F.col(a).alias(f"__m{i}") for i, a in enumerate(axes)], *[F.col(s).alias(f"__s{i}") for i, s in enumerate(sigmas)])
    for i, n in enumerate(shape):
        low = F.greatest(F.ceil(F.col(f"__m{i}") - truncate * F.col(f"__s{i}")), F.lit(0)).cast("int")
        high = F.least(F.floor(F.col(f"__m{i}") + truncate * F.col(f"__s{i}")), F.lit(n - 1)).cast("int")
        cells = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(f"__v{i}", F.explode(cells))
    d2 = sum((F.pow((F.col(f"__v{i}") - F.col(f"__m{i}")) / F.col(f"__s{i}"), 2) for i in range(len(axes))), F.lit(0.0))
    inside = out.withColumn("__d2", d2).filter(F.col("__d2") <= truncate * truncate)
    grouped = inside.groupBy(*[F.col(f"__v{i}").alias(a) for i, a in enumerate(axes)])
    return grouped.agg(F.sum(F.col("__a") * F.exp(-F.col("__d2") / 2)).alias("value")).filter(F.abs("value") >= floor)


def grid_histogram(df: DataFrame, cells: dict[str, float], weight: Column | None = None) -> DataFrame:
    """(cell_*, n or weight) by floor(coordinate / cell)."""
    keys = [F.floor(F.col(a) / c).cast("bigint").alias(f"cell_{a}") for a, c in cells.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *([F.sum(weight).alias("weight")] if weight is not None else []))


def box_sum(grid: DataFrame, box: dict[str, tuple[int, int]], value: str) -> DataFrame:
    """One row: the sum over low <= cell < high on each axis."""
    cond = F.lit(True)
    for a, (low, high) in box.items():
        cond = cond & (F.col(a) >= low) & (F.col(a) < high)
    return grid.filter(cond).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def cumulative(grid: DataFrame, axes: Sequence[str], value: str, out: str = "cumulated") -> DataFrame:
    """Summed-area table by one running sum along each axis in turn; each line of cells is a window of its own."""
    at = F.col(value)
    for a in axes:
        others = [x for x in axes if x != a]
        window = Window.partitionBy(*(others or [F.lit(0)])).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)
        grid = grid.withColumn(out, F.sum(at).over(window))
        at = F.col(out)
    return grid


def marginal(grid: DataFrame, axis: str, value: str) -> DataFrame:
    return grid.groupBy(axis).agg(F.sum(value).alias(value))


def densest(grid: DataFrame, cells: Sequence[str], value: str) -> DataFrame:
    """One row: the cell of the greatest value, ties by the least cell."""
    return grid.agg(F.min(F.struct((-F.col(value)).alias("v"), *cells)).alias("m")).select(*[F.col(f"m.{c}") for c in cells], (-F.col("m.v")).alias(value))


def downscale(volume: DataFrame, axes: dict[str, int], value: str = "value") -> DataFrame:
    """Blocks of the given sizes averaged."""
    return volume.groupBy(*[F.floor(F.col(a) / f).cast("bigint").alias(a) for a, f in axes.items()]).agg(F.avg(value).alias(value))


def normalise(volume: DataFrame, value: str = "value") -> DataFrame:
    """To 0..1 by the least and greatest value; a constant volume is 0."""
    ends = F.broadcast(volume.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")))  # one row
    t = F.coalesce((F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)), F.lit(0.0))
    return volume.crossJoin(ends).withColumn(value, t).drop("__lo", "__hi")


def histogram(volume: DataFrame, bins: int = 256, value: str = "value") -> DataFrame:
    """(bin, n, center) over the data's range, all bins, empty ones included."""
    ends = F.broadcast(volume.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")))  # one row
    width = F.col("__hi") - F.col("__lo")
    at = F.least(F.coalesce(F.floor((F.col(value) - F.col("__lo")) / F.nullif(width, F.lit(0.0)) * bins), F.lit(0)), F.lit(bins - 1))
    counts = volume.crossJoin(ends).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("__lo") + (F.col("bin") + 0.5) * width / bins).alias("center"))


def otsu(volume: DataFrame, bins: int = 256, value: str = "value") -> DataFrame:
    """One row: the threshold (a bin's center) of the greatest variance between the sides; foreground lies strictly above."""
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each bin
    totals = Window.partitionBy()
    weighed = F.col("n") * F.col("bin")
    h = histogram(volume, bins, value).withColumn("w", F.sum("n").over(up)).withColumn("m", F.sum(weighed).over(up))
    h = h.withColumn("all_n", F.sum("n").over(totals)).withColumn("all_m", F.sum(weighed).over(totals))
    gap = (F.col("m") * F.col("all_n") - F.col("all_m") * F.col("w")).cast("double")
    between = gap * gap / F.nullif((F.col("w") * (F.col("all_n") - F.col("w"))).cast("double"), F.lit(0.0))
    return h.withColumn("v", F.coalesce(between, F.lit(-1.0))).agg(F.min(F.struct((-F.col("v")).alias("v"), "center")).alias("b")).select(F.col("b.center").alias("threshold"))


def background(volume: DataFrame, method: str = "mode", bins: int = 256, value: str = "value") -> DataFrame:
    """One row: mode of the histogram held at the median, or the tenth percentile, or a second threshold below the first; exact zeros have no vote."""
    seen = volume.filter(F.col(value) != 0)
    if method == "percentile":
        return volume.sparkSession.range(1).select(F.lit(quantiles(seen, [(F.col(value), 0.1)])[0]).cast("double").alias("floor"))
    if method == "specimen":
        first = F.broadcast(otsu(seen, bins, value))
        below = seen.crossJoin(first).filter(F.col(value) <= F.col("threshold")).drop("threshold")
        return otsu(below, bins, value).withColumnRenamed("threshold", "floor")
    if method != "mode":
        raise ValueError(f"unknown method {method}")
    mode = histogram(seen, bins, value).agg(F.min(F.struct((-F.col("n")).alias("n"), "center")).alias("m")).select(F.col("m.center").alias("mode"))
    median = quantiles(seen, [(F.col(value), 0.5)])[0]
    return mode.select(F.least("mode", F.lit(median).cast("double")).alias("floor"))


def local_maxima(volume: DataFrame, axes: Sequence[str], threshold: float, value: str = "value") -> DataFrame:
    """Voxels over the threshold that no neighbour (of 3^d - 1) exceeds, of equal neighbours the first."""
    cells = volume.filter(F.col(value) > threshold)
    near = cells.select(*[F.col(a).alias(f"__{a}") for a in axes], F.col(value).alias("__v"))
    for a in axes:
        near = near.withColumn(a, F.explode(F.array(*[F.col(f"__{a}") + d for d in (-1, 0, 1)])))
    first = F.struct(*[F.col(f"__{a}") for a in axes]) < F.struct(*[F.col(a) for a in axes])
    beaten = cells.join(near, list(axes)).filter((F.col("__v") > F.col(value)) | ((F.col("__v") == F.col(value)) & first)).select(*axes).distinct()
    return cells.join(beaten, list(axes), "left_anti")


def donut_median(volume: DataFrame, axes: Sequence[str], masked: str, value: str = "value", radius: int = 1) -> DataFrame:
    """Masked voxels with the median of the unmasked voxels around them within ``radius``; null where there are none."""
    holes = volume.filter(masked).select(*axes)
    near = holes.select(*[F.col(a).alias(f"__{a}") for a in axes])
    for a in axes:
        near = near.withColumn(a, F.explode(F.array(*[F.col(f"__{a}") + d for d in range(-radius, radius + 1)])))
    known = volume.filter(~F.col(masked)).select(*axes, F.col(value).alias("__v"))
    found = near.join(known, list(axes)).groupBy(*[F.col(f"__{a}").alias(a) for a in axes]).agg(F.percentile("__v", 0.5).alias("filled"))
    return holes.join(found, list(axes), "left")


def hash_mask(key: Column, share: float, seed: int = 42) -> Column:
    """A reproducible mask of about a share of rows, by hash; the same rows on any cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000)


def psnr(truth: Column, estimate: Column, where: Column | None = None, data_range: Column | None = None) -> Column:
    """10 log10(range^2 / mse) over the rows of a condition: infinite without error, NaN without rows."""
    where = F.lit(True) if where is None else where
    mse = F.avg(F.when(where, (truth - estimate) * (truth - estimate)))
    span = F.max(truth) - F.min(truth) if data_range is None else data_range
    return F.when(mse.isNull(), float("nan")).when(mse == 0, float("inf")).otherwise(10 * F.log10(span * span / F.nullif(mse, F.lit(0.0))))


def baseline_mse(truth: Column, where: Column) -> Column:
    return F.avg(F.when(where, truth * truth))


def weighted_psnr(truth: Column, estimate: Column, held: Column, foreground: Column, ratio: float = 1.0) -> Column:
    """PSNR with the background's weight such that foreground counts ``ratio`` times as much; NaN if a stratum is empty."""
    error = (truth - estimate) * (truth - estimate)
    n1, n0 = F.sum(F.when(held & foreground, 1).otherwise(0)), F.sum(F.when(held & ~foreground, 1).otherwise(0))
    e1, e0 = F.sum(F.when(held & foreground, error).otherwise(0.0)), F.sum(F.when(held & ~foreground, error).otherwise(0.0))
    w = n1 / F.nullif(ratio * n0, F.lit(0.0))
    mse = (e1 + w * e0) / F.nullif(n1 + w * n0, F.lit(0.0))
    span = F.max(truth) - F.min(truth)
    return F.when((n1 == 0) | (n0 == 0), float("nan")).when(mse == 0, float("inf")).otherwise(10 * F.log10(span * span / F.nullif(mse, F.lit(0.0))))


def sample_by_intensity(volume: DataFrame, n: int, keys: Sequence[str], value: str = "value", seed: int = 42) -> DataFrame:
    """n voxels without replacement, by weight: the n greatest of ln(u) / weight with u from a hash; zeros never, all if there are no more than n."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return volume.filter(F.col(value) > 0).withColumn("__p", F.ln(u) / F.col(value)).orderBy(F.desc("__p"), *keys).limit(n).drop("__p")


def equalise_tiles(volume: DataFrame, axes: Sequence[str], tile: int = 16, clip: float = 2.0, bins: int = 256, value: str = "value") -> DataFrame:
    """Contrast-limited equalisation of values in 0..1: clipped histograms of tiles, the excess spread evenly, and between the tiles' middles their curves interpolated.

    A voxel is mapped by the curves of the 2^d tiles around it, weighed by the distance
    from their middles; beyond the outer middles, and where a tile has no voxels, the others count alone.
    """
    names = [f"__t{i}" for i in range(len(axes))]
    binned = volume.withColumn("__b", F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*[F.floor(F.col(a) / tile).cast("bigint").alias(n) for a, n in zip(axes, names, strict=True)], "__b").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*names).agg(F.sum("n").alias("all_n"), F.collect_list(F.struct("__b", "n")).alias("h"))  # at most ``bins`` in a list
    limit = F.greatest(F.lit(1.0), clip * F.col("all_n") / bins)
    kept = F.transform("h", lambda e: F.struct(e["__b"].alias("b"), F.least(e["n"].cast("double"), limit).alias("k")))
    curves = totals.withColumn("kept", kept)
    curves = curves.withColumn("spread", (F.col("all_n") - F.aggregate("kept", F.lit(0.0), lambda s, e: s + e["k"])) / bins)
    up_to = F.aggregate(F.filter("kept", lambda e: e["b"] <= F.col("__b")), F.lit(0.0), lambda s, e: s + e["k"])
    curves = curves.select(*names, "all_n", "kept", "spread", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("__b"))
    curves = curves.select(*names, "__b", ((up_to + F.col("spread") * (F.col("__b") + 1)) / F.col("all_n")).alias("cdf"))
    around, weight = binned, F.lit(1.0)
    for a, n in zip(axes, names, strict=True):
        middle = (F.col(a) + 0.5) / tile - 0.5
        low = F.floor(middle).cast("bigint")
        around = around.withColumn(n, F.explode(F.array(low, low + 1)))
        weight = weight * (1 - F.abs(middle - F.col(n)))
    joined = around.withColumn("__w", weight).filter("__w > 0").join(curves, [*names, "__b"])
    mapped = joined.groupBy(*axes).agg((F.sum(F.col("__w") * F.col("cdf")) / F.sum("__w")).alias("__v"))
    return volume.join(mapped, list(axes)).withColumn(value, F.col("__v")).select(*volume.columns)


def trilinear(points: DataFrame, grid: DataFrame, axes: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Grid values at points between voxels: 8 corners joined, weighted, summed; corners outside the grid count 0."""
    at = points.withColumn("__row", F.monotonically_increasing_id())
    corners = at
    weight = F.lit(1.0)
    for i, a in enumerate(axes):
        corners = corners.withColumn(f"__d{i}", F.explode(F.array(F.lit(0), F.lit(1))))
        low = F.floor(F.col(a))
        corners = corners.withColumn(f"__c{i}", (low + F.col(f"__d{i}")).cast("bigint"))
        share = F.col(a) - low
        weight = weight * F.when(F.col(f"__d{i}") == 1, share).otherwise(1 - share)
    corners = corners.withColumn("__share", weight)
    g = grid.select(*[F.col(a).cast("bigint").alias(f"__c{i}") for i, a in enumerate(axes)], *[F.col(v).alias(f"__{v}") for v in values])
    joined = corners.join(g, [f"__c{i}" for i in range(len(axes))], "left")
    keep = points.columns
    return joined.groupBy("__row").agg(*[F.first(c).alias(c) for c in keep], *[F.sum(F.col("__share") * F.coalesce(F.col(f"__{v}"), F.lit(0.0))).alias(f"at_{v}") for v in values]).drop("__row")


def rk4(points: DataFrame, grid: DataFrame, axes: Sequence[str], flow: Sequence[str], step: float) -> DataFrame:
    """One fourth-order step along the unit flow; points in still water stay."""
    origin = [f"__o{i}" for i in range(len(axes))]
    state = points.withColumns({o: F.col(a) for o, a in zip(origin, axes, strict=True)})
    slopes = []
    for k, part in enumerate((0.5, 0.5, 1.0, None)):
        state = trilinear(state, grid, axes, flow)
        length = F.sqrt(sum((F.col(f"at_{v}") * F.col(f"at_{v}") for v in flow), F.lit(0.0)))
        names = [f"__k{k}_{i}" for i in range(len(axes))]
        state = state.withColumns({n: F.coalesce(F.col(f"at_{v}") / F.nullif(length, F.lit(0.0)), F.lit(0.0)) for n, v in zip(names, flow, strict=True)}).drop(*[f"at_{v}" for v in flow])
        slopes.append(names)
        if part is not None:
            state = state.withColumns({a: F.col(o) + step * part * F.col(n) for a, o, n in zip(axes, origin, names, strict=True)})
    moved = {a: F.col(origin[i]) + step / 6 * (F.col(slopes[0][i]) + 2 * F.col(slopes[1][i]) + 2 * F.col(slopes[2][i]) + F.col(slopes[3][i])) for i, a in enumerate(axes)}
    return state.withColumns(moved).select(*points.columns)


def noise_floor(volume: DataFrame, axes: Sequence[str], value: str = "value") -> dict[str, float]:
    """Three estimates of the noise's deviation, and their median as ``ensemble``; NaN without pairs of neighbours.

    difference: the median distance of neighbours along the last axis; laplacian: the median
    second difference; background: the median distance from the median, of the values up to
    it. Each is scaled to the deviation of a normal distribution.
    """
    last, volume = axes[-1], held(volume.select(*axes, value))
    up, down = (volume.select(*[(F.col(a) + s if a == last else F.col(a)).alias(a) for a in axes], F.col(value).alias(n)) for s, n in ((-1, "__up"), (1, "__down")))
    near = volume.join(unsent(up), list(axes), "left").join(unsent(down), list(axes), "left")
    median = quantiles(volume, [(F.col(value), 0.5)])[0]
    if median is None:
        return dict.fromkeys(("difference", "laplacian", "background", "ensemble"), float("nan"))
    wanted = [F.abs(F.col("__up") - F.col(value)), F.abs(F.col("__up") + F.col("__down") - 2 * F.col(value)), F.when(F.col(value) <= median, median - F.col(value))]
    found = quantiles(near, [(w, 0.5) for w in wanted])
    scales = (0.6744897501960817 * 2**0.5, 0.6744897501960817 * 6**0.5, 0.6744897501960817)
    out = {n: float("nan") if f is None else f / s for n, f, s in zip(("difference", "laplacian", "background"), found, scales, strict=True)}
    known = sorted(v for v in out.values() if v == v)
    return out | {"ensemble": known[len(known) // 2] if known else float("nan")}


def gain_db(held_mse: Column, base_mse: Column) -> Column:
    """Decibels by which an estimate beats predicting zero: infinite without error, NaN without a baseline."""
    return F.when(base_mse.isNull() | held_mse.isNull() | (base_mse <= 0), float("nan")).when(held_mse <= 0, float("inf")).otherwise(10 * F.log10(base_mse / F.nullif(held_mse, F.lit(0.0))))


def spot_peak_ratio(rendered: DataFrame, spots: DataFrame, axes: Sequence[str], value: str = "value", peak: str = "peak") -> float:
    """The median of rendered over true value at the spots (their axes and ``peak``); voxels that aren't rendered are 0; NaN without spots of a positive peak."""
    at = spots.filter(F.col(peak) > 0).join(rendered.select(*axes, F.col(value).alias("__v")), list(axes), "left")
    found = quantiles(at, [(F.coalesce("__v", F.lit(0.0)) / F.col(peak), 0.5)])[0]
    return float("nan") if found is None else found


def on_basis(volume: DataFrame, floor: float | None, value: str = "value") -> DataFrame:
    """The volume less a stored floor, never below 0; unchanged without one."""
    return volume if floor is None else volume.withColumn(value, F.greatest(F.col(value) - floor, F.lit(0.0)))


def plateau(curve: DataFrame, at: str, gain: str, patience: int = 2, least: float = 0.1) -> DataFrame:
    """One row (stop): the first point of a curve by which ``patience`` steps in a row have gained less than ``least``; null if none. A row for each point of a sweep, so one window."""
    here = Window.orderBy(at)
    poor = curve.select(at, F.when(F.col(gain) - F.lag(gain).over(here) < least, 1).otherwise(0).alias("__p"))
    run = F.sum("__p").over(here.rowsBetween(-(patience - 1), 0))
    return poor.withColumn("__r", run).agg(F.min(F.when(F.col("__r") >= patience, F.col(at))).alias("stop"))
