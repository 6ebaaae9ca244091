"""The chunk index: bounds of runs of ordered rows, pruning by them, row ranges and their union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import View, extrapolated
from .ordering import held, sized
from .slicing import every

BARRIER_SLACK = 1e-6


def chunk_bounds(df: DataFrame, chunk_size: int, spatial: Sequence[str], barriers: Sequence[str], extent: dict[str, Column] | Column | None = None, ord_: str = "ord") -> DataFrame:
    """(chunk, n, lo_*, hi_*): spatial axes widened by a radius or an extent for each axis, barrier axes by a little only."""
    aggregates = [F.count("*").alias("n")]
    for c in (*spatial, *barriers):
        wide = F.lit(BARRIER_SLACK) if c in barriers else (extent.get(c) if isinstance(extent, dict) else extent)
        wide = F.lit(0.0) if wide is None else wide
        aggregates += [F.min(F.col(c) - wide).alias(f"lo_{c}"), F.max(F.col(c) + wide).alias(f"hi_{c}")]
    return df.groupBy(F.floor(F.col(ord_) / chunk_size).cast("bigint").alias("chunk")).agg(*aggregates)


def prune(chunks: DataFrame, view: View, max_radius: float = 0.0) -> DataFrame:
    """Chunks that the view's box touches; all of them where a hidden axis is extended."""
    if view.load_all():
        return chunks
    checks = []
    for d in view.hidden():
        reach = view.fetch_tolerance(d, max_radius)
        checks.append((F.col(f"hi_{d.name}") >= view.at(d) - reach) & (F.col(f"lo_{d.name}") <= view.at(d) + reach))
    return chunks.filter(every(checks))


def row_ranges(chunks: DataFrame, chunk_size: int, rows: int) -> DataFrame:
    """(start, stop) of each chunk's rows, the last held at the number of rows."""
    return chunks.select((F.col("chunk") * chunk_size).alias("start"), F.least((F.col("chunk") + 1) * chunk_size, F.lit(rows)).alias("stop"))


def merge_ranges(ranges: DataFrame, *by: str) -> DataFrame:
    """Overlapping and touching ranges joined, within groups ``by``.

    Without groups ranges are range-partitioned by their start; within partitions a window
    finds what a range's predecessors reach, lifted by the reach of the partitions before.
    """
    if by:
        placed, here, order = ranges, Window.partitionBy(*by), ["start", "stop"]
    else:
        sorted_ = ranges.select("start", "stop").repartitionByRange("start", "stop").sortWithinPartitions("start", "stop")
        placed = held(sorted_.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
        here, order = Window.partitionBy("__part"), ["__at"]
    before = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("stop").over(before)
    if not by:
        earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        parts = placed.groupBy("__part").agg(F.max("stop").alias("__m")).select("__part", F.max("__m").over(earlier).alias("__reach"))
        placed = placed.join(F.broadcast(parts), "__part")
        reach = F.greatest(reach, "__reach")
    marked = placed.withColumn("__r", reach)
    marked = marked.withColumn("__fresh", F.when(F.col("__r").isNull() | (F.col("start") > F.col("__r")), 1).otherwise(0))
    island = F.sum("__fresh").over(here.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if not by:
        counts = marked.groupBy("__part").agg(F.sum("__fresh").alias("__f")).select("__part", F.coalesce(F.sum("__f").over(earlier), F.lit(0)).alias("__f0"))
        marked = marked.join(F.broadcast(counts), "__part")
        island = island + F.col("__f0")
    return marked.withColumn("__island", island).groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__island")


def id_ranges(ids: DataFrame, column: str, span: int = 1 << 20) -> DataFrame:
    """Runs of consecutive distinct ids as (start, stop): runs within blocks of ``span`` ids, joined over the blocks' edges."""
    blocks = ids.select(F.col(column).alias("id"), F.floor(F.col(column) / span).alias("b")).distinct()
    run = F.col("id") - F.row_number().over(Window.partitionBy("b").orderBy("id"))
    runs = blocks.withColumn("run", run).groupBy("b", "run").agg(F.min("id").alias("start"), (F.max("id") + 1).alias("stop"))
    return merge_ranges(runs.select("start", "stop"))


def chunks_of_range(ranges: DataFrame, chunk_size: int) -> DataFrame:
    """Chunks that row ranges cover."""
    first, last = F.floor(F.col("start") / chunk_size), F.floor((F.col("stop") - 1) / chunk_size)
    return ranges.filter("stop > start").select(F.explode(F.sequence(first, last)).alias("chunk")).distinct()


#: Ranges of chunks that a scan gets as bounds.
SCAN_RANGES = 512


def within_chunks(df: DataFrame, wanted: DataFrame, column: str, width: int = 1, most: int = SCAN_RANGES) -> DataFrame:
    """Rows of ``df`` whose ``floor(column / width)`` is among the distinct chunks ``wanted`` (a column ``chunk``).

    Runs of chunks become bounds on ``column`` that reach the scan, so files and row groups
    outside them aren't read. Of more than ``most`` runs the gaps within equal parts of the
    chunks are read too, and a semi join drops their rows: the rows are the same.
    """
    wanted = held(wanted.select("chunk").distinct())
    runs = held(id_ranges(wanted, "chunk"))
    exact = runs.count() <= most
    if not exact:
        ends = runs.agg(F.min("start").alias("a"), F.max("stop").alias("b")).first()
        span = -(-(ends["b"] - ends["a"]) // most)
        runs = wanted.groupBy(F.floor((F.col("chunk") - ends["a"]) / span).alias("__g")).agg(F.min("chunk").alias("start"), (F.max("chunk") + 1).alias("stop"))
    bounds = runs.collect()  # at most ``most`` rows
    inside = reduce(lambda a, b: a | b, [(F.col(column) >= r["start"] * width) & (F.col(column) < r["stop"] * width) for r in bounds], F.lit(False))
    rows = df.filter(inside)
    if exact:
        return rows
    marked = rows.withColumn("__chunk", F.floor(F.col(column) / width).cast("bigint"))
    return marked.join(sized(wanted.withColumnRenamed("chunk", "__chunk")), "__chunk", "left_semi").drop("__chunk")


def read_slice(df: DataFrame, chunks: DataFrame, view: View, chunk_size: int, max_radius: float = 0.0, ord_: str = "ord") -> DataFrame:
    """Rows of the chunks that the view touches: the index prunes, bounds on the rows' order reach the scan."""
    return within_chunks(df, prune(chunks, view, max_radius), ord_, chunk_size)


def prefetch(chunks: DataFrame, current: View, previous: View | None, max_radius: float = 0.0) -> DataFrame:
    """Chunks that the next view touches and the current one doesn't, when the slice goes on as it went."""
    if previous is None:
        return chunks.limit(0)
    here = prune(chunks, current, max_radius).select("chunk")
    return prune(chunks, extrapolated(previous, current), max_radius).join(here, "chunk", "left_anti")
