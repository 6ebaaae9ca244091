"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import shared_dir

#: Rows in one Arrow batch. Texts may be very long, so batches stay short.
ARROW_ROWS = 256

#: Bytes in one Arrow batch, where the Spark version knows the setting.
ARROW_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` under ``sf_dir``, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small, whatever the length of a text.

    Spark reads these settings when a lazy result runs, so they stay for the session; a
    setting that is smaller already is left alone.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def distinct_names(keys: list[str], made: list[str]) -> None:
    """Refuse keys that bear the name of a result column, or a name twice: Spark takes names without regard to case."""
    names = [n.lower() for n in [*keys, *made]]
    again = sorted({n for n in names if names.count(n) > 1})
    if again:
        raise ValueError(f"columns {again} would occur twice: rename the keys")


def fresh(df: DataFrame, name: str) -> str:
    """A column name from ``name`` that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    made = f"__{name}"
    while made in taken:
        made = f"_{made}"
    return made


#: Folders that this session has written intermediate tables to, in order.
_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder beside the checkpoints, and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


def marked() -> int:
    """How many tables ``stored`` has written so far, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables that ``stored`` has written since a mark, but for the last ``keep``: what reads them must have been written."""
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: A key of over one in so many rows is hot; there are at most so many hot keys.
HOT = 1000


def join_hot(rows: DataFrame, table: DataFrame, on: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``: one row for each key ``on``, and ``n``, how many of the ``total`` rows have it.

    Hot keys (at most ``HOT`` of them, so they can be broadcast) are joined where their rows
    are; only the other keys are shuffled, so no task gets over one in ``HOT`` of the rows
    by one key. ``table`` should be stored: it is read three times.
    """
    hot = F.col("n") * HOT > total
    few = F.broadcast(table.filter(hot).drop("n"))
    cold = rows.join(F.broadcast(table.filter(hot).select(on)), on, "left_anti")
    return rows.join(few, on).unionByName(cold.join(table.filter(~hot).drop("n"), on, how))
