"""Level-of-detail ladders: rankings, cuts, samples, and mixtures reduced by moment matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import covariance
from .ordering import grid_codes, held, ranked, sized


def stream_cuts(n: int, chunk: int, max_levels: int | None = None) -> list[int]:
    """Ends of levels: doubling from a chunk up to n; a last level that is less than half a chunk folds into the one before."""
    if n <= chunk:
        return [n]
    cuts, at = [], chunk
    while at < n:
        cuts.append(at)
        at *= 2
    if max_levels is not None and len(cuts) >= max_levels:
        cuts = cuts[: max_levels - 1]
    if cuts and n - cuts[-1] < chunk / 2:
        cuts.pop()
    return [*cuts, n]


def with_levels(df: DataFrame, order: Sequence[Column], cuts: Sequence[int], out: str = "lod", energy: Column | None = None) -> DataFrame:
    """``df`` with a rank and the level its rank falls into; with ``energy`` also the share of it up to the row."""
    at = ranked(df, order, "rank", energy, "running")
    level = F.lit(len(cuts) - 1)
    for i in range(len(cuts) - 2, -1, -1):
        level = F.when(F.col("rank") <= cuts[i], i).otherwise(level)
    at = at.withColumn(out, level)
    if energy is None:
        return at
    total = F.broadcast(df.agg(F.sum(energy.cast("double")).alias("__t")))  # one row
    return at.crossJoin(total).withColumn("energy", F.col("running") / F.col("__t")).drop("running", "__t")


def level_energy(df: DataFrame, lod: str, energy: Column) -> DataFrame:
    """(lod, n, energy): rows and share of energy up to each level."""
    levels = df.groupBy(lod).agg(F.count("*").alias("n"), F.sum(energy).alias("e"))
    up_to = Window.orderBy(lod).rowsBetween(Window.unboundedPreceding, 0)  # a row for each level
    return levels.select(lod, "n", (F.sum("e").over(up_to) / F.sum("e").over(Window.partitionBy())).alias("energy"))


def rung_for(levels: DataFrame, threshold: float, lod: str = "lod") -> DataFrame:
    """One row: the first level whose energy reaches the threshold, else the last."""
    return levels.agg(F.coalesce(F.min(F.when(F.col("energy") >= threshold, F.col(lod))), F.max(lod)).alias(lod))


def prefix(df: DataFrame, k: int, lod: str = "lod") -> DataFrame:
    return df.filter(F.col(lod) <= k)


def resolve_target(target: float | int, n: int) -> int:
    """A float is a share of n, an int a count; held within 1..n; a bool raises."""
    if isinstance(target, bool):
        raise TypeError("target is a count or a share")
    if isinstance(target, float):
        if not 0 < target <= 1:
            raise ValueError("a share is above 0 and at most 1")
        target = round(target * n)
    return max(1, min(int(target), n))


def reduction_method(target: int, n: int, method: str = "auto") -> str:
    """A prefix is better for at least half of the rows, merging below."""
    return ("prefix" if target >= 0.5 * n else "merge") if method == "auto" else method


def stratified_levels(df: DataFrame, axes: Sequence[str], key: str, levels: int) -> DataFrame:
    """Coarse to fine: level i takes the first row left of every cell of a grid of 2^(i+1) along up to three axes; the last takes the rest."""
    axes = list(axes)[:3]
    ranges = F.broadcast(df.agg(*[f(a).alias(f"__{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]))  # one row
    left = df.crossJoin(ranges)
    done = []
    for i in range(levels - 1):
        n = 2 ** (i + 1)
        cells = [F.least(F.floor((F.col(a) - F.col(f"__lo_{a}")) / F.nullif(F.col(f"__hi_{a}") - F.col(f"__lo_{a}"), F.lit(0.0)) * n), F.lit(n - 1)) for a in axes]
        cells = [F.coalesce(c, F.lit(0)).alias(f"__c{j}") for j, c in enumerate(cells)]
        first = sized(held(left.groupBy(*cells).agg(F.min(key).alias(key)).select(key)))  # a row for each cell, combined before the shuffle
        done.append(left.join(first, key, "left_semi").withColumn("lod", F.lit(i)))
        left = held(left.join(first, key, "left_anti"))
    out = left.withColumn("lod", F.lit(levels - 1))
    for d in done:
        out = out.unionByName(d)
    return out.drop(*[f"__{n}_{a}" for a in axes for n in ("lo", "hi")])


def equal_bins(df: DataFrame, axes: Sequence[str], ties: Sequence[str], bins: int, out: str = "bin", bits: int | None = None) -> DataFrame:
    """Bins of equal size along the Z-order: floor((rank - 1) * bins / n)."""
    n = F.broadcast(df.agg(F.count("*").alias("__n")))  # one row
    at = ranked(grid_codes(df, axes, bits), [F.col("code"), *[F.col(t) for t in ties]], "__r").crossJoin(n)
    return at.withColumn(out, F.floor((F.col("__r") - 1) * bins / F.col("__n")).cast("bigint")).drop("__r", "__n", "code")


def merge_bins(df: DataFrame, bin_: str, axes: Sequence[str], sigmas: Sequence[str], amplitude: str, colors: Sequence[str] = ()) -> DataFrame:
    """One splat for each bin: mean and variance by mass (within plus between), mass kept, colours by mass.

    Axis-aligned; a bin without mass weighs its rows alike. Sums combine before the shuffle.
    """
    mass = covariance.mass(F.col(amplitude), [F.col(s) for s in sigmas])
    weighed = df.withColumn("__m", mass)
    aggregates = [F.count("*").alias("n"), F.sum("__m").alias("__m")]
    for a, s in zip(axes, sigmas, strict=True):
        second = F.col(s) * F.col(s) + F.col(a) * F.col(a)
        aggregates += [F.sum(F.col("__m") * F.col(a)).alias(f"__x_{a}"), F.sum(F.col("__m") * second).alias(f"__q_{a}"), F.avg(a).alias(f"__ux_{a}"), F.avg(second).alias(f"__uq_{a}")]
    aggregates += [F.sum(F.col("__m") * F.col(c)).alias(f"__c_{c}") for c in colors] + [F.avg(c).alias(f"__uc_{c}") for c in colors]
    g = weighed.groupBy(bin_).agg(*aggregates)
    m = F.nullif(F.when(F.col("__m") > 0, F.col("__m")).otherwise(0.0), F.lit(0.0))
    out = {}
    for a, s in zip(axes, sigmas, strict=True):
        mean = F.coalesce(F.col(f"__x_{a}") / m, F.col(f"__ux_{a}"))
        square = F.coalesce(F.col(f"__q_{a}") / m, F.col(f"__uq_{a}"))
        out[a], out[s] = mean, F.sqrt(F.greatest(square - mean * mean, F.lit(1e-24)))
    merged = g.select(bin_, "n", F.col("__m").alias("mass"), *[c.alias(k) for k, c in out.items()], *[F.coalesce(F.col(f"__c_{c}") / m, F.col(f"__uc_{c}")).alias(c) for c in colors])
    return merged.withColumn(amplitude, F.col("mass") / covariance.product([F.col(s) for s in sigmas]))


def optimal_amplitude(inner: Column, norm: Column) -> Column:
    """The amplitude of least squared error: inner product over the template's squared norm."""
    return F.coalesce(inner / F.nullif(norm, F.lit(0.0)), F.lit(0.0))


def residual_energy(norm: Column, inner: Column, template: Column) -> Column:
    """What the best single splat leaves of a bin's energy; never negative."""
    return F.greatest(norm - F.coalesce(inner * inner / F.nullif(template, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def decimate(df: DataFrame, target: float | int, axes: Sequence[str], sigmas: Sequence[str], amplitude: str, key: str, method: str = "auto") -> DataFrame:
    """Reduced to a count or share: the rows of greatest energy, or bins along the Z-order merged."""
    n = df.count()
    k = resolve_target(target, n)
    if reduction_method(k, n, method) == "prefix":
        energy = covariance.self_energy(F.col(amplitude), [F.col(s) for s in sigmas])
        return ranked(df, [energy.desc(), F.col(key)], "__r").filter(F.col("__r") <= k).select(*df.columns)
    return merge_bins(equal_bins(df, axes, [key], k), "bin", axes, sigmas, amplitude)


def refine_bins(df: DataFrame, bin_: str, axes: Sequence[str], sigmas: Sequence[str], amplitude: str, key: str, cell: float, rounds: int = 3) -> DataFrame:
    """Lloyd's reassignment: each row moves to the nearest representative among those of its own and neighbouring cells; its own bin stays where none is near."""
    for _ in range(rounds):
        means = merge_bins(df, bin_, axes, sigmas, amplitude).select(F.col(bin_).alias("__b"), *[F.col(a).alias(f"__{a}") for a in axes])
        here = [F.floor(F.col(f"__{a}") / cell) for a in axes]
        around = means
        for i, h in enumerate(here):
            around = around.withColumn(f"__k{i}", F.explode(F.array(*[h + d for d in (-1, 0, 1)])))
        keys = [F.floor(F.col(a) / cell).alias(f"__k{i}") for i, a in enumerate(axes)]
        placed = df.select("*", *keys)
        distance = sum(((F.col(a) - F.col(f"__{a}")) * (F.col(a) - F.col(f"__{a}")) for a in axes), F.lit(0.0))
        joined = placed.join(around, [f"__k{i}" for i in range(len(axes))])
        best = joined.groupBy(key).agg(F.min(F.struct(distance.alias("d"), F.col("__b").alias("b"))).alias("__best"))
        df = held(df.join(best, key, "left").withColumn(bin_, F.coalesce("__best.b", bin_)).drop("__best"))
    return df


METHODS = ("amplitude", "mass", "self_energy", "random", "radial", "spectral", "greedy")


def ranking(df: DataFrame, method: str, axes: Sequence[str], sigmas: Sequence[str], amplitude: str, key: str, seed: int = 42) -> tuple[DataFrame, list[Column]]:
    """(``df``, maybe with columns to order by, and the order) of a method, ties by ``key``.

    amplitude, mass and self_energy: the greatest first. random: by hash. radial: from the
    centroid by mass outwards. spectral: the widest first, which have the lowest
    frequencies; among equally wide ones (by octaves) the most energy. greedy: the most
    energy that no row nearby has shown yet: cells of grids twice as fine each time give
    their best row in turn, so each step covers what is least covered.
    """
    amp, widths = F.col(amplitude), [F.col(s) for s in sigmas]
    energy = covariance.self_energy(amp, widths)
    if method == "amplitude":
        return df, [amp.desc(), F.col(key)]
    if method == "mass":
        return df, [covariance.mass(amp, widths).desc(), F.col(key)]
    if method == "self_energy":
        return df, [energy.desc(), F.col(key)]
    if method == "random":
        return df, [F.xxhash64(F.lit(seed), key), F.col(key)]
    if method == "radial":
        mass = covariance.mass(amp, widths)
        middle = df.agg(*[F.coalesce(F.sum(mass * F.col(a)) / F.nullif(F.sum(mass), F.lit(0.0)), F.avg(a)).alias(f"__m_{a}") for a in axes])
        far = sum(((F.col(a) - F.col(f"__m_{a}")) * (F.col(a) - F.col(f"__m_{a}")) for a in axes), F.lit(0.0))
        placed = df.crossJoin(F.broadcast(middle)).withColumn("__far", far).drop(*[f"__m_{a}" for a in axes])  # one row
        return placed, [F.col("__far"), F.col(key)]
    if method == "spectral":
        return df, [F.floor(F.log2(covariance.geometric_mean(widths))).desc(), energy.desc(), F.col(key)]
    if method == "greedy":
        marked = df.withColumn("__e", energy)
        ranges = F.broadcast(marked.agg(*[f(a).alias(f"__{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]))  # one row
        left, done = marked.crossJoin(ranges), []
        for i in range(1, GREEDY_GRIDS + 1):
            cells = [F.coalesce(F.least(F.floor((F.col(a) - F.col(f"__lo_{a}")) / F.nullif(F.col(f"__hi_{a}") - F.col(f"__lo_{a}"), F.lit(0.0)) * 2**i), F.lit(2**i - 1)), F.lit(0)).alias(f"__c{j}") for j, a in enumerate(axes)]
            best = sized(held(left.groupBy(*cells).agg(F.max_by(key, F.struct("__e", key)).alias(key)).select(key)))
            done.append(left.join(best, key, "left_semi").withColumn("__turn", F.lit(i)))
            left = held(left.join(best, key, "left_anti"))
        every = left.withColumn("__turn", F.lit(GREEDY_GRIDS + 1))
        for d in done:
            every = every.unionByName(d)
        return held(every.drop(*[f"__{n}_{a}" for a in axes for n in ("lo", "hi")])), [F.col("__turn"), F.col("__e").desc(), F.col(key)]
    raise ValueError(f"unknown method {method}: choose one of {METHODS}")


#: Grids (of 2, 4, ... cells along an axis) that the greedy ranking takes in turn.
GREEDY_GRIDS = 6


def ladder(df: DataFrame, method: str, chunk: int, axes: Sequence[str], sigmas: Sequence[str], amplitude: str, key: str, max_levels: int | None = None) -> DataFrame:
    """``df`` with ``rank`` and ``lod``: additive levels that double from a chunk, in the method's order."""
    placed, order = ranking(df, method, axes, sigmas, amplitude, key)
    return with_levels(placed, order, stream_cuts(df.count(), chunk, max_levels)).drop("__far", "__e", "__turn")


def pyramid(df: DataFrame, axes: Sequence[str], sigmas: Sequence[str], amplitude: str, key: str, factor: int = 4, levels: int = 3, chunk: int = 65536, method: str = "self_energy") -> DataFrame:
    """(level, lod, key, rank, axes, sigmas, amplitude): substitutive levels, each of a ``factor`` fewer rows (at least one), each with an additive ladder.

    Level 0 is the data, level k its reduction to n / factor^k rows by merging along the Z-order.
    """
    if factor < 2 or levels < 1:
        raise ValueError("a pyramid needs a factor of 2 or more and a level")
    columns = [key, *axes, *sigmas, amplitude]
    base = held(df.select(*columns))
    n, parts = base.count(), []
    for k in range(levels):
        target = max(1, n // factor**k)
        one = base if k == 0 else merge_bins(equal_bins(base, axes, [key], target), "bin", axes, sigmas, amplitude).withColumnRenamed("bin", key).select(*columns)
        parts.append(ladder(one, method, chunk, axes, sigmas, amplitude, key).select(F.lit(k).alias("level"), "lod", "rank", *columns))
        if target == 1:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def level_matrix(pyramid: DataFrame, amplitude: str) -> DataFrame:
    """(level, lod, n, amplitude): what each rung of each level holds."""
    return pyramid.groupBy("level", "lod").agg(F.count("*").alias("n"), F.sum(amplitude).alias(amplitude))
