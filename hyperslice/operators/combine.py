"""Unions of datasets and levels, stacked axes, replicated rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = (1.0, 1.0, 1.0)


def white(channels: int = 3) -> Column:
    return F.array(*[F.lit(1.0)] * channels)


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def agree(parts: Sequence[DataFrame], columns: Sequence[str]) -> None:
    """Raise, with the part's number, where a required column is missing or of another type."""
    types = dict(parts[0].dtypes)
    for i, p in enumerate(parts):
        own = dict(p.dtypes)
        for c in columns:
            if own.get(c) != types.get(c) or c not in own:
                raise ValueError(f"part {i}: column {c} is {own.get(c)}, not {types.get(c)}")


def concatenate(parts: Sequence[DataFrame], color: str = "color") -> DataFrame:
    """All rows; a part without colours is white if another has them, three channels get an alpha of 1 if another has four."""
    colored = [color in p.columns for p in parts]
    if not any(colored):
        return union(parts)
    filled = [p if has else p.withColumn(color, F.lit(None).cast("array<double>")) for p, has in zip(parts, colored, strict=True)]
    all_rows = union(filled)
    widest = F.broadcast(all_rows.agg(F.coalesce(F.max(F.size(color)), F.lit(3)).alias("__w")))  # one row
    c = F.coalesce(F.col(color), white())
    return all_rows.crossJoin(widest).withColumn(color, F.when((F.col("__w") == 4) & (F.size(c) == 3), F.concat(c, F.array(F.lit(1.0)))).otherwise(c)).drop("__w")


def with_optional(parts: Sequence[DataFrame], column: str) -> DataFrame:
    """All rows, with an optional column only where every part that has rows has it; empty parts have no vote."""
    voters = [p for p in parts if not p.isEmpty()]
    keep = bool(voters) and all(column in p.columns for p in voters)
    kind = next((dict(p.dtypes)[column] for p in parts if column in p.columns), "string")
    shaped = []
    for p in parts:
        if not keep:
            shaped.append(p.drop(column))
        else:
            shaped.append(p if column in p.columns else p.withColumn(column, F.lit(None).cast(kind)))
    return union(shaped)


def as_new_dimension(parts: Sequence[DataFrame], axis: str, values: Sequence[float], sigma: float = 0.0) -> DataFrame:
    """All rows with one more axis, constant for each part, and its sigma (0 becomes 1e-7)."""
    if len(parts) != len(values):
        raise ValueError(f"{len(parts)} parts but {len(values)} values")
    named = [p.withColumn(axis, F.lit(float(v))).withColumn(f"sigma_{axis}", F.lit(max(sigma, 1e-7))) for p, v in zip(parts, values, strict=True)]
    return union(named)


def with_channel_colors(parts: Sequence[DataFrame], colors: Sequence[Sequence[float]], color: str = "color") -> DataFrame:
    """All rows, in one colour for each part, whatever colours they had."""
    if len(parts) != len(colors):
        raise ValueError(f"{len(parts)} parts but {len(colors)} colours")
    return union([p.drop(color).withColumn(color, F.array(*[F.lit(float(x)) for x in c])) for p, c in zip(parts, colors, strict=True)])


def union_levels(ladders: Sequence[DataFrame], level: str = "level", label: str | None = None) -> DataFrame:
    """Ladders joined level by level; a label column must be in all of them or in none."""
    if label and len({label in p.columns for p in ladders}) > 1:
        raise ValueError(f"{label} must be in all ladders or in none")
    agree(ladders, [level])
    return union(ladders)


def stack_colorings(df: DataFrame, colorings: Sequence[Column], axis: str = "coloring", color: str = "color") -> DataFrame:
    """Every row once for each colouring, whose number becomes an axis; one generator, no join."""
    listed = F.array(*[F.struct(F.lit(i).alias("i"), c.alias("c")) for i, c in enumerate(colorings)])
    return df.withColumn("__c", F.explode(listed)).withColumn(axis, F.col("__c.i")).withColumn(color, F.col("__c.c")).drop("__c")


def to_all_slices(df: DataFrame, ranges: dict[str, tuple[float, float, float] | Sequence[float]]) -> DataFrame:
    """Every row at all combinations of hidden coordinates: low..high by step (both ends), or listed values."""
    for axis, r in ranges.items():
        if isinstance(r, tuple) and len(r) == 3:
            low, high, step = r
            values = [low + i * step for i in range(int((high - low) / step + 1e-9) + 1)]
        else:
            values = sorted({float(x) for x in r})
        df = df.withColumn(axis, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df


def distinct_content(df: DataFrame, content: Sequence[str], key: str) -> DataFrame:
    """One row (the least key) for each distinct content, by digest; copies are combined before the shuffle."""
    digest = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in content]), 256)
    return df.groupBy(digest.alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def restride(df: DataFrame, axis: str, stride: int) -> DataFrame:
    """Every stride-th frame of a stacked axis, renumbered from 0. Frames off the lattice by more than 0.05, or none kept, raise."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    at = F.rint(F.col(axis))
    state = df.agg(F.max(F.abs(F.col(axis) - at)).alias("off"), F.max((F.pmod(at, F.lit(float(stride))) == 0).cast("int")).alias("any")).first()
    if state["off"] is None or state["off"] > 0.05 or not state["any"]:
        raise ValueError(f"no frames on the lattice: {state}")
    kept = df.filter(F.pmod(at, F.lit(float(stride))) == 0)
    return kept.withColumn(axis, (F.rint(F.col(axis)) / stride).cast("bigint"))


def require_channel(levels: Sequence[DataFrame], channel: str, key: str) -> None:
    """Raise, before anything is written, where some levels carry a channel and others don't, or a level's channel has another length than its rows."""
    have = [channel in d.columns for d in levels]
    if any(have) and not all(have):
        raise ValueError(f"levels {[i for i, h in enumerate(have) if not h]} lack the channel {channel}")
    for i, d in enumerate(levels if any(have) else []):
        row = d.agg(F.count(key).alias("rows"), F.count(channel).alias("values")).first()
        if row["rows"] != row["values"]:
            raise ValueError(f"level {i}: {row['values']} values of {channel} for {row['rows']} rows")
