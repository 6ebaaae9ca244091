"""Schema inference and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import Dimension
from .ordering import sized


def bounds(df: DataFrame, axes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, lo_*, hi_*) in one aggregation; without rows all are 0."""
    aggregates = [F.coalesce(f(a), F.lit(0)).cast("double").alias(f"{p}_{a}") for a in axes for f, p in ((F.min, "lo"), (F.max, "hi"))]
    return df.groupBy(*by).agg(*aggregates)


def barrier_axes(df: DataFrame, axes: Sequence[str], most: int = 1024) -> DataFrame:
    """(axis, barrier): integers within 1e-3, at most 1024 distinct, and at most a quarter as many as rows. Errs to not flagging."""
    checks = []
    for a in axes:
        x = F.col(a).cast("double")
        checks.append(F.struct(F.lit(a).alias("axis"), F.max(F.abs(x - F.rint(x))).alias("off"), F.count_distinct(F.rint(x)).alias("n"), F.count("*").alias("rows")))
    row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)])
    each = row.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(axes))])).alias("c"))
    barrier = (F.col("c.off") <= 1e-3) & (F.col("c.n") <= most) & (4 * F.col("c.n") <= F.col("c.rows"))
    return each.select("c.axis", F.col("c.n").alias("distinct"), F.coalesce(barrier, F.lit(False)).alias("barrier"))


def _gcd(a: Column, b: Column) -> Column:
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, 0).otherwise(s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda s: s["a"])


def discrete_step(df: DataFrame, axis: str, by: Sequence[str] = (), parts: int = 256) -> DataFrame:
    """(by, step): the greatest common divisor of the gaps between distinct integer coordinates; 1 where they are not integers, too large, or fewer than two.

    That is the divisor of all distances from the least coordinate, folded in parts of their hash and then over the parts.
    """
    x = F.col(axis).cast("double")
    bad = F.isnan(x) | (F.abs(x) > float(1 << 24)) | (x != F.rint(x))
    ends = df.groupBy(*by).agg(F.min(F.when(~bad, x)).alias("__lo"), F.max(bad).alias("__bad"))
    integers = df.filter(~bad).select(*by, x.alias("x")).distinct()
    away = (integers.join(sized(ends), list(by)) if by else integers.crossJoin(F.broadcast(ends))).withColumn("__d", (F.col("x") - F.col("__lo")).cast("bigint")).filter("__d > 0")
    fold = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: _gcd(s, v))
    folded = away.groupBy(*by, F.pmod(F.xxhash64("__d"), F.lit(parts)).alias("__p")).agg(fold(F.collect_set("__d")).alias("__g"))
    folded = folded.groupBy(*by).agg(fold(F.collect_set("__g")).alias("__g"))
    joined = ends.join(folded, list(by), "left") if by else ends.crossJoin(F.broadcast(folded))
    return joined.select(*by, F.when(F.col("__bad") | F.col("__g").isNull() | (F.col("__g") == 0), 1.0).otherwise(F.col("__g").cast("double")).alias("step"))


def missing_values(df: DataFrame, group: str, axis: str) -> DataFrame:
    """(group, axis) of the values that the group with the most distinct values has and another lacks."""
    seen = df.select(group, axis).distinct()
    sizes = seen.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group)
    reference = sizes.limit(1).select(F.col(group).alias("__ref"))
    wanted = seen.join(F.broadcast(reference), seen[group] == reference["__ref"], "left_semi").select(axis)
    pairs = sizes.select(group).crossJoin(sized(wanted))  # what is asked for: each group against each value of the reference
    return pairs.join(seen, [group, axis], "left_anti")


def extend_candidates(df: DataFrame, dims: Sequence[Dimension]) -> list[str]:
    """Hidden axes on which all rows have one value inside a wider declared range."""
    hidden = [d for d in dims if not d.display and d.low is not None and d.high is not None and d.high > d.low]
    if not hidden:
        return []
    row = df.agg(*[f(d.name).alias(f"{p}{i}") for i, d in enumerate(hidden) for f, p in ((F.min, "lo"), (F.max, "hi"))]).first()
    return [d.name for i, d in enumerate(hidden) if row[f"lo{i}"] is not None and row[f"lo{i}"] == row[f"hi{i}"] and d.low <= row[f"lo{i}"] <= d.high]


def inferred_ranges(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, low, high) of the data; a range of one value is made one wide."""
    row = df.agg(*[F.struct(F.lit(a).alias("axis"), F.min(a).cast("double").alias("low"), F.max(a).cast("double").alias("high")).alias(f"c{i}") for i, a in enumerate(axes)])
    each = row.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(axes))])).alias("c")).select("c.*")
    return each.withColumn("high", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1))


def dims_for(n: int) -> list[Dimension]:
    """Names and display flags for n columns: the first three are shown, no range is set."""
    names = ["x", "y", "z", *[f"d{i}" for i in range(3, n)]][:n]
    return [Dimension(name, display=i < 3) for i, name in enumerate(names)]


def scan_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, rows) of every rule, a condition that good rows meet; nulls violate. One pass."""
    counts = [F.struct(F.lit(n).alias("rule"), F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)).alias("violations"), F.count("*").alias("rows")).alias(f"c{i}") for i, (n, c) in enumerate(rules.items())]
    row = df.agg(*counts)
    return row.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(rules))])).alias("c")).select("c.*").withColumn("violations", F.coalesce("violations", F.lit(0)))


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def aligned(df: DataFrame, columns: dict[str, str | float]) -> DataFrame:
    """Columns in a scene's order: a name of the data, or a number to fill with."""
    require_columns(df, [c for c in columns.values() if isinstance(c, str)])
    return df.select(*[(F.col(c) if isinstance(c, str) else F.lit(float(c))).alias(k) for k, c in columns.items()])
