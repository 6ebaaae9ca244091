"""Progressive loading: a ladder as a stream of levels, newest views, and the rules between passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_ladder(df: DataFrame, path: str, lod: str = "lod") -> None:
    """One folder for each level."""
    df.write.partitionBy(lod).parquet(path)


def refine(spark: SparkSession, path: str, schema: StructType, on_level: Callable[[DataFrame, int], None], checkpoint: str, lod: str = "lod") -> list[int]:
    """Levels of a ladder one after another, the coarsest first: each level's folder is one micro-batch of a stream of its own, whatever files it has.

    ``on_level`` gets a level's rows (of ``schema``, with the column ``lod``) and its number. A batch is published
    whole or not at all; a restart goes on after the last published level. Returns the
    levels published by this call. A level without a folder is none.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(fs_path) if s.isDirectory()]
    published = []
    for level in sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{lod}=")):
        stream = spark.readStream.schema(schema).parquet(f"{path}/{lod}={level}").withColumn(lod, F.lit(level))

        def batch(df: DataFrame, _: int, level: int = level) -> None:
            on_level(df, level)
            published.append(level)

        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{level}").trigger(availableNow=True).start().awaitTermination()
    return published


def latest_views(requests: DataFrame, by: str, at: str) -> DataFrame:
    """The newest request of each key of a batch; earlier pending ones are superseded."""
    return requests.groupBy(by).agg(F.max_by(F.struct(*requests.columns), at).alias("r")).select("r.*")


def windowed_counts(events: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time windows; a watermark bounds the state."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def pass_kind(pinned: bool, budgeted: bool, playing: bool, prefetch: bool) -> str:
    """What a pass is for: pinned before prefetch before playback before refinement."""
    return "pinned" if pinned else "prefetch" if prefetch else "playback" if playing and budgeted else "refine"


def admitted_levels(sizes: list[int], pixels: int, per_pixel: float) -> int:
    """Levels to load so that elements for each pixel stay under a cap; the first always is."""
    total, n = 0, 0
    for s in sizes:
        total += s
        if n and total > per_pixel * max(1, pixels):
            break
        n += 1
    return n


def stop_after(level: int, levels: int, spent_bytes: int, budget_bytes: int | None) -> bool:
    """Whether a pass ends after a level: at the last, or beyond its budget; one level is always made."""
    return level + 1 >= levels or (budget_bytes is not None and spent_bytes >= budget_bytes)
