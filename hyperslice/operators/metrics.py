"""Counters of loaders, parts and jobs, summed and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a job from the last to the first that counts, when a part has reported several.
STATES = ("failed", "done", "running", "pending")


def totals(stats: DataFrame, sums: Sequence[str], maxima: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Counters summed and peaks kept, over all rows or by groups; without rows 0."""
    return stats.groupBy(*by).agg(F.count("*").alias("parts"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in maxima])


def merged_metrics(loaders: DataFrame, path: str, rows: str = "rows", bytes_: str = "bytes", millis: str = "millis", ready: str = "ready") -> DataFrame:
    """A node's metrics from those of its levels' loaders: sums, the slowest time, and whether all are ready."""
    return loaders.groupBy(path).agg(F.count("*").alias("loaders"), F.sum(rows).alias(rows), F.sum(bytes_).alias(bytes_), F.max(millis).alias(millis), F.min(F.col(ready).cast("int")).cast("boolean").alias(ready))


def merged_counts(parts: DataFrame, counts: str) -> DataFrame:
    """(name, n): maps of counts by name (classes, pruning rules) of all parts, summed."""
    return parts.select(F.explode(counts).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))


def job_states(reports: DataFrame, job: str = "job", state: str = "state") -> DataFrame:
    """(state, jobs): each job counts once, in the state of ``STATES`` that comes first; unknown states count as pending."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATES)), F.col(state)), F.lit(0)), F.lit(len(STATES)))
    last = reports.groupBy(job).agg(F.min(at).alias("at"))
    return last.groupBy(F.element_at(F.array(*map(F.lit, STATES)), F.col("at").cast("int")).alias("state")).agg(F.count("*").alias("jobs"))
