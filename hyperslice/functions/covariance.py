"""Covariances: metrics of axis-aligned splats in closed form, full matrices from packed Cholesky factors.

A packed factor lists the lower triangle by rows: L[i][j] is element i(i+1)/2 + j.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

TRUNCATION = 3.0
LEAST_SIGMA = 1e-12


def product(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a * b, columns)


def geometric_mean(sigmas: Sequence[Column]) -> Column:
    """exp of the mean log, of values clipped from below."""
    logs = [F.ln(F.greatest(s, F.lit(LEAST_SIGMA))) for s in sigmas]
    return F.exp(reduce(lambda a, b: a + b, logs) / len(sigmas))


def mass(amplitude: Column, sigmas: Sequence[Column]) -> Column:
    return amplitude * product(sigmas)


def volume(sigmas: Sequence[Column]) -> Column:
    """det(Sigma) to the power 1/d."""
    return F.pow(product([s * s for s in sigmas]), 1 / len(sigmas))


def eccentricity(sigmas: Sequence[Column]) -> Column:
    """Largest over least sigma; 1 where the least is zero."""
    low = F.least(*sigmas) if len(sigmas) > 1 else sigmas[0]
    high = F.greatest(*sigmas) if len(sigmas) > 1 else sigmas[0]
    return F.when(low == 0, 1.0).otherwise(high / F.nullif(low, F.lit(0.0)))


def self_energy(amplitude: Column, sigmas: Sequence[Column]) -> Column:
    """The integral of a splat's square: a^2 pi^(d/2) prod(sigma)."""
    return amplitude * amplitude * float(np.pi ** (len(sigmas) / 2)) * product(sigmas)


def pair_kernel(a: Column, mu: Sequence[Column], sigma: Sequence[Column], b: Column, nu: Sequence[Column], tau: Sequence[Column]) -> Column:
    """The inner product of two axis-aligned splats; 0 where a variance vanishes."""
    var = [s * s + t * t for s, t in zip(sigma, tau, strict=True)]
    distance = reduce(lambda x, y: x + y, [(m - n) * (m - n) / F.nullif(v, F.lit(0.0)) for m, n, v in zip(mu, nu, var, strict=True)])
    norm = product([F.sqrt(2 * np.pi * s * s * t * t / F.nullif(v, F.lit(0.0))) for s, t, v in zip(sigma, tau, var, strict=True)])
    return F.coalesce(a * b * norm * F.exp(-distance / 2), F.lit(0.0))


def packed_sigma(chol: Column, axis: int) -> Column:
    """sqrt(Sigma_ii) from a packed factor."""
    at = axis * (axis + 1) // 2
    return F.sqrt(reduce(lambda a, b: a + b, [chol[at + j] * chol[at + j] for j in range(axis + 1)]))


def packed_volume(chol: Column, dims: int) -> Column:
    return F.pow(product([chol[i * (i + 1) // 2 + i] for i in range(dims)]), 2 / dims)


def unpack(packed: np.ndarray) -> np.ndarray:
    """Rows of packed factors to matrices."""
    n = int((np.sqrt(8 * packed.shape[1] + 1) - 1) / 2)
    out = np.zeros((len(packed), n, n))
    out[(slice(None), *np.tril_indices(n))] = packed
    return out


def pack(lower: np.ndarray) -> np.ndarray:
    return lower[(slice(None), *np.tril_indices(lower.shape[1]))]


def _udf(work, columns: Column):
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        if not len(s):
            return s
        return pd.Series(list(work(np.stack(s.to_numpy()))), index=s.index)

    return run(columns)


def _factor(sigma: np.ndarray) -> np.ndarray:
    """Cholesky factors of symmetric matrices that may be semi-definite only."""
    n = sigma.shape[1]
    return np.linalg.cholesky(sigma + np.eye(n) * 1e-14 * np.maximum(1e-12, np.trace(sigma, axis1=1, axis2=2))[:, None, None])


def transform_packed(chol: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """The factor of A Sigma A^T."""
    a = np.array(matrix, float)

    def work(packed: np.ndarray) -> np.ndarray:
        lower = a @ unpack(packed)
        return pack(_factor(lower @ lower.transpose(0, 2, 1)))

    return _udf(work, chol)


def permute_packed(chol: Column, order: Sequence[int]) -> Column:
    """The factor with axis i taken from axis order[i]."""
    if sorted(order) != list(range(len(order))):
        raise ValueError(f"not a permutation: {order}")
    return transform_packed(chol, np.eye(len(order))[list(order)])


def embed_packed(chol: Column, places: Sequence[int], dims: int, fill: float = 1.0) -> Column:
    """The factor in ``dims`` dimensions: axis i goes to places[i], the others get sigma ``fill`` and no covariance."""

    def work(packed: np.ndarray) -> np.ndarray:
        lower = unpack(packed)
        sigma = np.broadcast_to(np.eye(dims) * fill**2, (len(packed), dims, dims)).copy()
        sigma[np.ix_(range(len(packed)), places, places)] = lower @ lower.transpose(0, 2, 1)
        return pack(_factor(sigma))

    return _udf(work, chol)


def marginal_packed(chol: Column, keep: Sequence[int]) -> Column:
    """The factor of the covariance of some axes."""

    def work(packed: np.ndarray) -> np.ndarray:
        lower = unpack(packed)
        sigma = lower @ lower.transpose(0, 2, 1)
        return pack(_factor(sigma[np.ix_(range(len(packed)), keep, keep)]))

    return _udf(work, chol)


def principal_radius(chol: Column, truncation: float = TRUNCATION, anisotropy: bool = True) -> Column:
    """Truncation times sqrt of the largest eigenvalue, or of the geometric mean."""

    @F.pandas_udf(DoubleType())
    def run(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=float)
        lower = unpack(np.stack(s.to_numpy()))
        values = np.linalg.eigvalsh(lower @ lower.transpose(0, 2, 1))
        radius = np.sqrt(np.maximum(values[:, -1], 0)) if anisotropy else np.exp(np.log(np.maximum(values, 1e-300)).mean(1) / 2)
        return pd.Series(truncation * radius, index=s.index)

    return run(chol)


def from_quaternion(w: Column, x: Column, y: Column, z: Column, scales: Sequence[Column]) -> Column:
    """The packed factor of a rotated, scaled splat, in closed form for three dimensions."""
    from .scalar import quaternion_to_matrix

    r = quaternion_to_matrix(w, x, y, z)
    s = [[reduce(lambda p, q: p + q, [r[i][k] * r[j][k] * scales[k] * scales[k] for k in range(3)]) for j in range(3)] for i in range(3)]
    l00 = F.sqrt(s[0][0])
    l10, l20 = s[1][0] / l00, s[2][0] / l00
    l11 = F.sqrt(s[1][1] - l10 * l10)
    l21 = (s[2][1] - l20 * l10) / l11
    l22 = F.sqrt(F.greatest(s[2][2] - l20 * l20 - l21 * l21, F.lit(0.0)))
    return F.array(l00, l10, l11, l20, l21, l22)


def unpack_symmetric(packed: np.ndarray) -> np.ndarray:
    """Rows of lower triangles to symmetric matrices."""
    lower = unpack(packed)
    return lower + lower.transpose(0, 2, 1) - np.einsum("nii->ni", lower)[:, :, None] * np.eye(lower.shape[1])


def sigma_elements(chol: Column, dims: int) -> list[Column]:
    """The lower triangle of Sigma, by rows, from a packed factor: native expressions."""
    at = lambda i, j: chol[i * (i + 1) // 2 + j]
    return [reduce(lambda a, b: a + b, [at(i, k) * at(j, k) for k in range(j + 1)]) for i in range(dims) for j in range(i + 1)]


def factor_of(sigma: Column) -> Column:
    """The packed factor of a covariance's lower triangle."""
    return _udf(lambda packed: pack(_factor(unpack_symmetric(packed))), sigma)


def precision_of(chol: Column) -> Column:
    """The lower triangle of the inverse covariance; a singular one is regularised as its factor is."""

    def work(packed: np.ndarray) -> np.ndarray:
        lower = unpack(packed)
        sigma = lower @ lower.transpose(0, 2, 1)
        factor = _factor(sigma)
        inverse = np.linalg.inv(factor)
        return pack(inverse.transpose(0, 2, 1) @ inverse)

    return _udf(work, chol)


def conditional(center: Column, chol: Column, shown: Sequence[int], hidden: Sequence[int], at: Sequence[float]) -> Column:
    """A struct (center, chol, weight): the splat cut where its hidden axes have the values ``at``.

    The conditional mean and covariance of the shown axes, and what the Gaussian of the
    hidden ones leaves of the amplitude. Hidden axes without variance gate: weight 1 on the
    value, 0 beside it.
    """
    from pyspark.sql.types import StructField, StructType

    s, h, values = list(shown), list(hidden), np.array(at, float)
    result = StructType([StructField("center", ArrayType(DoubleType())), StructField("chol", ArrayType(DoubleType())), StructField("weight", DoubleType())])

    @F.pandas_udf(result)
    def run(centers: pd.Series, factors: pd.Series) -> pd.DataFrame:
        if not len(centers):
            return pd.DataFrame({"center": [], "chol": [], "weight": []})
        mu, lower = np.stack(centers.to_numpy()), unpack(np.stack(factors.to_numpy()))
        sigma = lower @ lower.transpose(0, 2, 1)
        gap = values - mu[:, h]
        hh = sigma[np.ix_(range(len(mu)), h, h)]
        inverse = np.linalg.pinv(hh, hermitian=True)
        sh = sigma[np.ix_(range(len(mu)), s, h)]
        gain = sh @ inverse
        center = mu[:, s] + (gain @ gap[:, :, None])[:, :, 0]
        rest = sigma[np.ix_(range(len(mu)), s, s)] - gain @ sh.transpose(0, 2, 1)
        d2 = np.einsum("ni,nij,nj->n", gap, inverse, gap)
        flat = np.einsum("nii->ni", hh) <= LEAST_SIGMA**2
        weight = np.where((flat & (np.abs(gap) > 1e-9)).any(1), 0.0, np.exp(-d2 / 2))
        return pd.DataFrame({"center": list(center), "chol": list(pack(_factor(rest))), "weight": weight})

    return run(center, chol)


def pair_kernel_of(a: Column, mu: Sequence[Column], sigma: Sequence[Column], root: Column, b: Column, nu: Sequence[Column], tau: Sequence[Column], other: Column) -> Column:
    """The same in two dimensions, of the lower triangles of Sigma and the products of the factors' diagonals: native expressions."""
    s00, s10, s11 = (s + t for s, t in zip(sigma, tau, strict=True))
    x, y = (m - n for m, n in zip(mu, nu, strict=True))
    det = F.greatest(s00 * s11 - s10 * s10, F.lit(1e-300))
    d2 = (x * x * s11 - 2 * x * y * s10 + y * y * s00) / det
    volume = F.abs(root * other)
    return F.when(volume > 0, a * b * (2 * np.pi) * volume / F.sqrt(det) * F.exp(-d2 / 2)).otherwise(0.0)


def packed_pair_kernel(a: Column, mu: Column, chol_a: Column, b: Column, nu: Column, chol_b: Column) -> Column:
    """The inner product of two splats of full covariance; 0 where one has no volume."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, m: pd.Series, p: pd.Series, y: pd.Series, n: pd.Series, q: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        lp, lq = unpack(np.stack(p.to_numpy())), unpack(np.stack(q.to_numpy()))
        gap = np.stack(m.to_numpy()) - np.stack(n.to_numpy())
        total = lp @ lp.transpose(0, 2, 1) + lq @ lq.transpose(0, 2, 1)
        root = np.abs(np.einsum("nii->ni", lp).prod(1) * np.einsum("nii->ni", lq).prod(1))
        det = np.maximum(np.linalg.det(total), 1e-300)
        d2 = np.einsum("ni,ni->n", gap, np.linalg.solve(total + np.eye(total.shape[1]) * 1e-300, gap[:, :, None])[:, :, 0])
        value = x * y * (2 * np.pi) ** (gap.shape[1] / 2) * root / np.sqrt(det) * np.exp(-d2 / 2)
        return pd.Series(np.where(root > 0, value, 0.0), index=x.index)

    return run(a, mu, chol_a, b, nu, chol_b)
