"""Filters by attributes and percentiles, and cumulative culling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import soft_pass
from .ordering import quantiles, ranked
from .slicing import every

Limit = tuple[str, str, float | str]


def in_box(box: dict[str, tuple[float | None, float | None]], half_open: bool = False) -> Column:
    """Within low..high on each axis; open ends allowed, the upper end excluded with ``half_open``."""
    checks = []
    for axis, (low, high) in box.items():
        if low is not None:
            checks.append(F.col(axis) >= low)
        if high is not None:
            checks.append(F.col(axis) < high if half_open else F.col(axis) <= high)
    return every(checks)


def filter_by(df: DataFrame, limits: Sequence[tuple[Column, str, str, float]]) -> DataFrame:
    """Rows that keep all limits (value, ``min`` or ``max``, mode, number).

    Mode ``absolute`` compares with the number, ``normalized`` with that share of the
    greatest value, ``percentile`` with that percentile (0..100, linear between rows).
    The greatest value is joined back as one row; percentiles are found first, by counts of
    parts of the range (``ordering.quantiles``), and are literals of the filter.
    """
    statistics = []
    for i, (value, _, mode, number) in enumerate(limits):
        if mode == "normalized":
            statistics.append((F.max(value) * number).alias(f"__t{i}"))
        elif mode not in ("absolute", "percentile"):
            raise ValueError(f"unknown mode {mode}")
    shares = [(value, number / 100) for value, _, mode, number in limits if mode == "percentile"]
    found = iter(quantiles(df, shares))
    joined = df.crossJoin(F.broadcast(df.agg(*statistics))) if statistics else df  # one row
    checks = []
    for i, (value, side, mode, number) in enumerate(limits):
        limit = F.lit(float(number)) if mode == "absolute" else F.lit(next(found)).cast("double") if mode == "percentile" else F.col(f"__t{i}")
        checks.append(value >= limit if side == "min" else value <= limit)
    return joined.filter(every(checks)).select(*df.columns)


def soft_filter(df: DataFrame, amplitude: str, scale: Column, highpass: float | None = None, lowpass: float | None = None, width: float = 1.0) -> DataFrame:
    """Amplitudes reweighted by size; the number of rows stays."""
    return df.withColumn(amplitude, F.col(amplitude) * soft_pass(scale, highpass, lowpass, width))


def cull_cumulative(df: DataFrame, amplitude: str, keys: Sequence[str], retention: float) -> DataFrame:
    """The brightest rows that hold ``retention`` of the sum: a row stays while the share before it is less.

    The row that crosses the limit stays, and so does the first. Where the sum is zero
    all rows stay if retention is above 0. Sums are of doubles; ties go by ``keys``.
    """
    total = F.broadcast(df.agg(F.sum(F.col(amplitude).cast("double")).alias("__total")))  # one row
    order = [F.desc(amplitude), *[F.col(k) for k in keys]]
    running = ranked(df, order, "__rank", F.col(amplitude), "__running").crossJoin(total)
    before = F.col("__running") - F.col(amplitude)
    kept = F.when(F.col("__total") == 0, F.lit(retention > 0)).otherwise((before < retention * F.col("__total")) | (F.col("__rank") == 1))
    return running.filter(kept).select(*df.columns)


def cull_percentile(df: DataFrame, amplitude: str, percentile: float) -> DataFrame:
    return filter_by(df, [(F.col(amplitude), "min", "percentile", percentile)])


def cull_combined(df: DataFrame, amplitude: str, volume: Column, amplitude_percentile: float = 5.0, volume_percentile: float = 95.0) -> DataFrame:
    return filter_by(df, [(F.col(amplitude), "min", "percentile", amplitude_percentile), (volume, "max", "percentile", volume_percentile)])


def cull(df: DataFrame, amplitude: str, keys: Sequence[str], method: str = "auto", retention: float = 0.95, percentile: float = 5.0, volume: Column | None = None) -> DataFrame:
    """Dispatch by name; ``auto`` is cumulative."""
    if method in ("auto", "cumulative"):
        return cull_cumulative(df, amplitude, keys, retention)
    if method == "percentile":
        return cull_percentile(df, amplitude, percentile)
    if method == "combined" and volume is not None:
        return cull_combined(df, amplitude, volume, percentile)
    raise ValueError(f"unknown method {method}, or no volume for it")


def drop_faint(df: DataFrame, extent: Column, least: float) -> DataFrame:
    """Rows of at least an extent; a limit of 0 or less disables the rule."""
    return df if least <= 0 else df.filter(extent >= least)


def removal_report(before: DataFrame, after: DataFrame, amplitude: str, mass: Column) -> DataFrame:
    """One row: how many rows, how much mass and amplitude a filter removed."""
    def sums(df: DataFrame, p: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"{p}n"), F.coalesce(F.sum(mass), F.lit(0.0)).alias(f"{p}mass"), F.coalesce(F.sum(amplitude), F.lit(0.0)).alias(f"{p}amp"))

    both = sums(before, "b_").crossJoin(sums(after, "a_"))  # a row each
    return both.select((F.col("b_n") - F.col("a_n")).alias("removed"), (F.col("b_mass") - F.col("a_mass")).alias("removed_mass"), (F.col("b_amp") - F.col("a_amp")).alias("removed_amplitude"))
