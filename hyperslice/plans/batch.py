"""Work by parts that can be taken up again: a plan's fingerprint, and parts written once each."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .partition import Box


def plan_fingerprint(boxes: Sequence[Box], settings: Mapping[str, object], source: str) -> str:
    """16 hex digits that name these boxes, worked this way, on this source."""
    told = json.dumps([[list(b.low), list(b.high)] for b in boxes]) + json.dumps(dict(settings), sort_keys=True, default=str) + source
    return hashlib.sha256(told.encode()).hexdigest()[:16]


def done_parts(spark: SparkSession, path: str, fingerprint: str) -> set[int]:
    """Parts whose marker under this fingerprint is there. A marker is written after its part's rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{fingerprint}/done")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {int(s.getPath().getName()) for s in fs.listStatus(folder)} if fs.exists(folder) else set()


def run_parts(rows: DataFrame, part: str, path: str, fingerprint: str, work: Callable[[DataFrame], DataFrame], parts: Sequence[int], wave: int = 64) -> list[int]:
    """Work the parts that aren't done, ``wave`` at a time, into ``path``/fingerprint/part=i; the parts worked by this call.

    ``work`` maps rows of some parts to rows that keep the column ``part``. A part's folder
    is overwritten as a whole, and its marker follows the write: after a failure, or in a
    second call, only parts without a marker are worked. A wave is one Spark job, whose
    tasks hold a partition at a time, so memory doesn't grow with the parts.
    """
    spark = rows.sparkSession
    todo = sorted(set(parts) - done_parts(spark, path, fingerprint))
    out = f"{path}/{fingerprint}/rows"
    for at in range(0, len(todo), wave):
        some = todo[at : at + wave]
        made = work(rows.filter(F.col(part).isin(some)))
        made.write.partitionBy(part).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)
        for p in some:
            marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{fingerprint}/done/{p}")
            marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, True).close()
    return todo
