"""Tables of points and splats with their chunk index, and text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dims import View
from ..operators import chunks, ordering


def write_points(df: DataFrame, path: str, barriers: Sequence[str], spatial: Sequence[str], ties: Sequence[str], chunk_size: int = 65536, radius: Column | dict[str, Column] | None = None, labels: Sequence[str] = (), lod: str | None = None, compression: str = "zstd") -> None:
    """A table in spatial order (barrier axes first) under ``path``/rows, and its chunk bounds under ``path``/chunks.

    Null labels become empty strings. Rows are range-partitioned by their order, so a
    file holds whole runs of chunks, and a page holds at most a chunk's rows: statistics of
    files, row groups and pages skip what a slice doesn't touch.
    """
    for c in labels:
        df = df.withColumn(c, F.coalesce(c, F.lit("")))
    placed = ordering.held(ordering.spatial_order(df, barriers, spatial, ties).withColumn("chunk", F.floor(F.col("ord") / chunk_size).cast("bigint")))
    writer = placed.repartitionByRange("ord").sortWithinPartitions("ord").write.option("compression", compression).option("parquet.page.row.count.limit", chunk_size)
    (writer.partitionBy(lod) if lod else writer).parquet(f"{path}/rows")
    chunks.chunk_bounds(placed, chunk_size, spatial, barriers, radius).repartitionByRange("chunk").sortWithinPartitions("chunk").write.parquet(f"{path}/chunks")


def read_points(spark: SparkSession, path: str, view: View | None = None, max_radius: float = 0.0) -> DataFrame:
    """All rows, or those of the chunks that a view touches: the index gives bounds that reach the scan, so other row groups aren't read."""
    rows = spark.read.parquet(f"{path}/rows")
    if view is None:
        return rows
    return chunks.within_chunks(rows, chunks.prune(spark.read.parquet(f"{path}/chunks"), view, max_radius), "chunk")


def summary(spark: SparkSession, path: str) -> dict:
    """Columns and counts from schema and chunk index alone; no row is read."""
    rows = spark.read.parquet(f"{path}/rows")
    index = spark.read.parquet(f"{path}/chunks").agg(F.count("*").alias("chunks"), F.sum("n").alias("rows")).first()
    return {"columns": rows.columns, "chunks": index["chunks"], "rows": index["rows"]}


def row_range(df: DataFrame, start: int, stop: int, ord_: str = "ord") -> DataFrame:
    """Rows start <= ord < stop, by bounds that reach the scan."""
    return df.filter((F.col(ord_) >= start) & (F.col(ord_) < stop))


def dimension_table(spark: SparkSession, path: str, key: str, status: str = "Status", wanted: str = "Approved", location: str | None = None) -> DataFrame:
    """A tab-separated table: rows of a status with a key, the first of each key in the file's order; ``location`` gets a column of its chromosome."""
    raw = spark.read.csv(path, sep="\t", header=True).withColumn("__row", F.monotonically_increasing_id())
    kept = raw.filter(F.col(status) == wanted).dropna(subset=[key])
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__row"))).filter("__n = 1")
    if location:
        kept = kept.withColumn("chromosome", F.coalesce(F.nullif(F.regexp_extract(location, r"^(\d+|[XY]|MT)", 1), F.lit("")), F.lit("?")))
    return kept.drop("__n", "__row")


def edge_table(edges: DataFrame, names: DataFrame, a: str, b: str, id_: str, name: str, prefix: str = "") -> DataFrame:
    """Distinct undirected pairs of names: both ends with the prefix, no loops, ids looked up."""
    both = edges.filter(F.col(a).startswith(prefix) & F.col(b).startswith(prefix) & (F.col(a) != F.col(b)))
    for c in (a, b):
        to = names.select(F.col(id_).alias("__id"), F.col(name).alias("__name"))
        both = both.join(to, both[c] == to["__id"]).withColumn(c, F.col("__name")).drop("__id", "__name")
    return both.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def compact(spark: SparkSession, path: str, out: str, file_mb: int = 128) -> None:
    """Small files packed to fewer of about ``file_mb``; the number follows from the bytes read."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jvm).getLength()
    spark.read.parquet(path).coalesce(max(1, round(size / (file_mb << 20)))).write.parquet(out)


def frame_of(name: Column, pattern: str = r"(\d+)(?!.*\d)") -> Column:
    """The frame number in a file's name: by default its last digits; null without."""
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("int")
