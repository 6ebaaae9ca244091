"""Edits of amplitudes, centres and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import quantiles


def scale_offset(df: DataFrame, amplitude: str, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    return df.withColumn(amplitude, F.col(amplitude) * scale + offset)


def clamp_amplitude(df: DataFrame, amplitude: str, low: float | None = None, high: float | None = None) -> DataFrame:
    c = F.col(amplitude)
    c = c if low is None else F.greatest(c, F.lit(low))
    return df.withColumn(amplitude, c if high is None else F.least(c, F.lit(high)))


def normalise_amplitude(df: DataFrame, amplitude: str, level: str | None = None) -> DataFrame:
    """Divided by the greatest amplitude (of the finest level, where there are levels); a greatest of 0 changes nothing."""
    finest = df.filter(F.col(level) == 0) if level else df
    top = F.broadcast(finest.agg(F.max(amplitude).alias("__top")))  # one row
    return df.crossJoin(top).withColumn(amplitude, F.when(F.col("__top") != 0, F.col(amplitude) / F.nullif(F.col("__top"), F.lit(0.0))).otherwise(F.col(amplitude))).drop("__top")


def brightness_factor(df: DataFrame, amplitude: str, target: float = 1.0, percentile: float = 0.999) -> tuple[float | None, float | None]:
    """(reference, factor): the robust reference, and target over it; None where that is not positive."""
    reference = quantiles(df, [(F.col(amplitude), percentile)])[0]
    return reference, target / reference if reference is not None and reference > 0 else None


def normalise_brightness(df: DataFrame, amplitude: str, target: float = 1.0, percentile: float = 0.999) -> DataFrame:
    factor = brightness_factor(df, amplitude, target, percentile)[1]
    return df if factor is None else df.withColumn(amplitude, F.col(amplitude) * factor)


def translate(df: DataFrame, by: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) + v for c, v in by.items()})


def rescale(df: DataFrame, factors: dict[str, float], sigmas: dict[str, str] | None = None) -> DataFrame:
    """Centres times factors, and sigmas of the same axes."""
    out = {c: F.col(c) * f for c, f in factors.items()}
    return df.withColumns(out | {s: F.col(s) * factors[a] for a, s in (sigmas or {}).items()})


def to_voxels(df: DataFrame, scale: dict[str, float], origin: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / s - origin.get(c, 0.0) for c, s in scale.items()})


def weighted_centroid(df: DataFrame, axes: Sequence[str], weight: str) -> DataFrame:
    """One row: the weighted mean of each axis, the plain mean where all weights are 0."""
    total = F.sum(weight)
    return df.agg(*[F.coalesce(F.sum(F.col(a) * F.col(weight)) / F.nullif(total, F.lit(0.0)), F.avg(a)).alias(a) for a in axes])


def center(df: DataFrame, axes: Sequence[str], weight: str) -> DataFrame:
    """Rows moved so that the centroid of the spatial axes is the origin; other axes stay."""
    mean = weighted_centroid(df, axes, weight).select(*[F.col(a).alias(f"__{a}") for a in axes])
    return df.crossJoin(F.broadcast(mean)).withColumns({a: F.col(a) - F.col(f"__{a}") for a in axes}).drop(*[f"__{a}" for a in axes])


def linear_map(df: DataFrame, axes: Sequence[str], matrix: Sequence[Sequence[float]]) -> DataFrame:
    """Centres by a d x d matrix or a homogeneous (d+1) x (d+1) one, whose last row must be 0 ... 0 1."""
    d = len(axes)
    if len(matrix) == d + 1 and list(matrix[-1]) != [0.0] * d + [1.0]:
        raise ValueError("the last row of a homogeneous matrix must be 0 ... 0 1")
    if len(matrix) not in (d, d + 1) or any(len(r) != len(matrix) for r in matrix):
        raise ValueError(f"not a matrix for {d} axes")

    def row(i: int) -> Column:
        moved = F.lit(float(matrix[i][d])) if len(matrix) > d else F.lit(0.0)
        return sum((F.col(a) * float(matrix[i][j]) for j, a in enumerate(axes)), moved)

    return df.withColumns({a: row(i) for i, a in enumerate(axes)})


def weigh(df: DataFrame, weights: DataFrame, key: str, amplitude: str, weight: str = "weight") -> DataFrame:
    """Amplitudes times a weight for each key; rows without one keep theirs."""
    return df.join(weights.select(key, weight), key, "left").withColumn(amplitude, F.col(amplitude) * F.coalesce(weight, F.lit(1.0))).drop(weight)


def with_labels(df: DataFrame, vocabulary: Sequence[str], label: str, out: str = "label_id") -> DataFrame:
    """The position in the vocabulary, or null for a name outside it."""
    return df.withColumn(out, F.nullif(F.array_position(F.array(*[F.lit(v) for v in vocabulary]), F.col(label)) - 1, F.lit(-1)).cast("int"))


def label_names(df: DataFrame, vocabulary: Sequence[str], label_id: str = "label_id", out: str = "label") -> DataFrame:
    return df.withColumn(out, F.get(F.array(*[F.lit(v) for v in vocabulary]), F.col(label_id)))


def without_labels(df: DataFrame, label_id: str = "label_id", label: str = "label") -> DataFrame:
    """Rows of all levels without the categorical channel; nothing to drop is no error."""
    return df.drop(label_id, label)
