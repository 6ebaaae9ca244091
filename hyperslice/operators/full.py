"""Splats of full covariance: a center ARRAY<DOUBLE>, a packed Cholesky factor ARRAY<DOUBLE>, an amplitude."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import DISCRETE_REACH, View
from ..functions import covariance
from .mixture import PAIRED
from .neighbors import dealt
from .ordering import held, met
from .slicing import LEAST_AMPLITUDE, every

REACH = 12.0


def conditional_slice(df: DataFrame, view: View, center: str = "center", chol: str = "chol", amplitude: str = "amp", max_sigmas: dict[str, float] | None = None, max_amplitude: float | None = None) -> DataFrame:
    """Splats cut by the slice: center and factor of the shown axes given the hidden ones, and the amplitude that is left.

    Discrete hidden axes gate at half a step and have no part in the rest; extended ones are
    left out as well. Rows fainter than a millionth go. With the table's greatest sigmas and
    amplitude, splats too far to be seen are dropped before any matrix is made.
    """
    axes = [d.name for d in view.dims]
    hidden = [d for d in view.hidden() if d.name not in view.extend]
    smooth = [d for d in hidden if not d.discrete]
    x = lambda d: F.col(center)[axes.index(d.name)]
    gates = [F.abs(x(d) - view.at(d)) <= DISCRETE_REACH * d.stepping() for d in hidden if d.discrete]
    if max_sigmas and max_amplitude and max_amplitude > 0:
        far = math.sqrt(2 * max(0.0, math.log(max_amplitude / LEAST_AMPLITUDE))) + 1e-6
        gates += [F.abs(x(d) - view.at(d)) <= far * max_sigmas[d.name] for d in smooth]
    shown = [i for i, d in enumerate(view.dims) if d.display]
    near = df.filter(every(gates))
    if not smooth:
        keep = F.array(*[F.col(center)[i] for i in shown])
        return near.withColumn(chol, covariance.marginal_packed(F.col(chol), shown)).withColumn(center, keep)
    cut = covariance.conditional(F.col(center), F.col(chol), shown, [axes.index(d.name) for d in smooth], [view.at(d) for d in smooth])
    out = near.withColumn("__cut", cut).withColumn(amplitude, F.col(amplitude) * F.col("__cut.weight")).filter(F.col(amplitude) >= LEAST_AMPLITUDE)
    return out.withColumn(center, F.col("__cut.center")).withColumn(chol, F.col("__cut.chol")).drop("__cut")


def merge_bins(df: DataFrame, bin_: str, dims: int, center: str = "center", chol: str = "chol", amplitude: str = "amp") -> DataFrame:
    """One splat for each bin: mean and covariance by mass (within plus between), mass kept. Sums of native expressions combine before the shuffle; a bin without mass weighs its rows alike."""
    c, l = F.col(center), F.col(chol)
    volume = covariance.product([F.abs(l[i * (i + 1) // 2 + i]) for i in range(dims)])
    weighed = df.withColumn("__m", F.col(amplitude) * volume)
    pairs = [(i, j) for i in range(dims) for j in range(i + 1)]
    second = [e + c[i] * c[j] for e, (i, j) in zip(covariance.sigma_elements(l, dims), pairs, strict=True)]
    sums = [F.sum(F.col("__m") * c[i]).alias(f"__x{i}") for i in range(dims)] + [F.avg(c[i]).alias(f"__u{i}") for i in range(dims)]
    sums += [F.sum(F.col("__m") * q).alias(f"__q{k}") for k, q in enumerate(second)] + [F.avg(q).alias(f"__v{k}") for k, q in enumerate(second)]
    g = weighed.groupBy(bin_).agg(F.count("*").alias("n"), F.sum("__m").alias("mass"), *sums)
    m = F.when(F.col("mass") > 0, F.col("mass"))
    mean = [F.coalesce(F.col(f"__x{i}") / m, F.col(f"__u{i}")) for i in range(dims)]
    sigma = [F.coalesce(F.col(f"__q{k}") / m, F.col(f"__v{k}")) - mean[i] * mean[j] for k, (i, j) in enumerate(pairs)]
    out = g.select(bin_, "n", "mass", F.array(*mean).alias(center), covariance.factor_of(F.array(*sigma)).alias(chol))
    made = F.col(chol)
    return out.withColumn(amplitude, F.col("mass") / covariance.product([made[i * (i + 1) // 2 + i] for i in range(dims)]))


def inner_product(a: DataFrame, b: DataFrame, dims: int, center: str = "center", chol: str = "chol", amplitude: str = "amp") -> DataFrame:
    """One row: the sum of pair kernels over splats in the same or touching cells of ``REACH`` of the widest sigma, which is the whole sum to double precision.

    Equal splats are one (the kernel is linear in the amplitude), dense cells go to several tasks.
    """
    widest = max((df.agg(F.max(F.greatest(*[covariance.packed_sigma(F.col(chol), i) for i in range(dims)], F.lit(0.0)))).first()[0] or 0.0 for df in (a, b)))
    cell = REACH * widest or 1.0

    def placed(df: DataFrame, side: str, ring: int) -> DataFrame:
        alike = df.groupBy(F.col(center).alias(f"{side}_c"), F.col(chol).alias(f"{side}_l")).agg(F.sum(amplitude).alias(f"{side}_a"))
        l = F.col(f"{side}_l")
        root = covariance.product([l[i * (i + 1) // 2 + i] for i in range(dims)]).alias(f"{side}_r")
        out = held(alike.select("*", *[F.col(f"{side}_c")[i].alias(f"{side}_x{i}") for i in range(dims)], *[e.alias(f"{side}_s{i}") for i, e in enumerate(covariance.sigma_elements(l, dims))], root))
        if dims == 2:
            out = out.drop(f"{side}_c", f"{side}_l")
        for i in range(dims):
            at = F.floor(F.col(f"{side}_x{i}") / cell).cast("bigint")
            out = out.withColumn(f"__k{i}", F.explode(F.sequence(at - ring, at + ring)) if ring else at)
        return out

    p, q, cells = dealt(placed(a, "p", 0), placed(b, "q", 1), [f"__k{i}" for i in range(dims)], [*[f"p_x{i}" for i in range(dims)], *[f"p_s{i}" for i in range(dims * (dims + 1) // 2)]], PAIRED)
    if dims == 2:
        kernel = covariance.pair_kernel_of(*[c for s in "pq" for c in (F.col(f"{s}_a"), [F.col(f"{s}_x{i}") for i in range(2)], [F.col(f"{s}_s{i}") for i in range(3)], F.col(f"{s}_r"))])
    else:
        kernel = covariance.packed_pair_kernel(*[F.col(n) for n in ("p_a", "p_c", "p_l", "q_a", "q_c", "q_l")])
    return met(q, p, cells).agg(F.coalesce(F.sum(kernel), F.lit(0.0)).alias("inner"))


def render(df: DataFrame, shape: Sequence[int], center: str = "center", chol: str = "chol", amplitude: str = "amp", truncate: float = 3.0, floor: float = 1e-5) -> DataFrame:
    """(v0, v1, ..., value): the sum of the splats at the integer voxels of ``shape`` within ``truncate`` in Mahalanobis distance; values under the floor go.

    A splat meets the voxels of its box only; the inverse covariance is made once for each.
    """
    n = len(shape)
    out = df.filter(F.abs(amplitude) >= floor).select(F.col(amplitude).alias("__a"), F.col(center).alias("__c"), F.col(chol).alias("__l"))
    out = out.withColumn("__p", covariance.precision_of(F.col("__l")))
    for i, size in enumerate(shape):
        reach = truncate * covariance.packed_sigma(F.col("__l"), i)
        low = F.greatest(F.ceil(F.col("__c")[i] - reach), F.lit(0)).cast("int")
        high = F.least(F.floor(F.col("__c")[i] + reach), F.lit(size - 1)).cast("int")
        out = out.withColumn(f"v{i}", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    gap = [F.col(f"v{i}") - F.col("__c")[i] for i in range(n)]
    d2 = sum(((1 if i == j else 2) * F.col("__p")[i * (i + 1) // 2 + j] * gap[i] * gap[j] for i in range(n) for j in range(i + 1)), F.lit(0.0))
    inside = out.withColumn("__d2", d2).filter(F.col("__d2") <= truncate * truncate)
    voxels = inside.groupBy(*[f"v{i}" for i in range(n)]).agg(F.sum(F.col("__a") * F.exp(-F.col("__d2") / 2)).alias("value"))
    return voxels.filter(F.abs("value") >= floor)

