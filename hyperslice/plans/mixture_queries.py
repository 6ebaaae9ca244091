"""Mixtures, seeds and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mixture, raster
from .grid_queries import _VOL, volume
from .registry import query, read
from .splat_queries import AXES, SIGMAS, SPLATS, splats

_PAIR = " * ".join(f"sqrt(2 * pi() * a.{s} * a.{s} * b.{s} * b.{s} / (a.{s} * a.{s} + b.{s} * b.{s}))" for s in SIGMAS[:2])
_GAP = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x}) / (a.{s} * a.{s} + b.{s} * b.{s})" for x, s in zip(AXES[:2], SIGMAS[:2], strict=True))


def _products(a: str, b: str) -> str:
    return f"(SELECT sum(a.amp * b.amp * {_PAIR} * exp(-({_GAP}) / 2)) FROM {a} a, {b} b)"


@query(f"WITH s AS (SELECT * FROM {SPLATS}) SELECT round({_products('s', 's')} / 1e9, 6) AS inner_product")
def mixture_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of splats in the SQL; here those that can add anything."""
    s = splats(spark, sf_dir)
    return mixture.inner_product(s, s, AXES[:2], SIGMAS[:2], "amp").select(F.round(F.col("inner") / 1e9, 6).alias("inner_product"))


@query(
    f"""WITH b AS (SELECT * FROM {SPLATS}), a AS (SELECT id, x + 0.25e0 AS x, y, 0.9e0 * amp AS amp, sx, sy FROM b),
    p AS (SELECT {_products('a', 'a')} AS aa, {_products('a', 'b')} AS ab, {_products('b', 'b')} AS bb)
    SELECT round(least(1, greatest(0, 1 - (aa - 2 * ab + bb) / bb)), 9) AS quality FROM p"""
)
def mixture_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture that is moved and dimmed, against itself as it was."""
    s = splats(spark, sf_dir)
    moved = s.withColumn("x", F.col("x") + 0.25).withColumn("amp", F.col("amp") * 0.9)
    return mixture.similarity(moved, s, AXES[:2], SIGMAS[:2], "amp").select(F.round("quality", 9).alias("quality"))


@query()
def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.greedy_merge(splats(spark, sf_dir), AXES[:2], SIGMAS[:2], "amp", 20.0, 0.25)


@query("SELECT x0 + i * 500.0e0 AS l_extendedprice, q0 + j * 10.0e0 AS l_quantity FROM (SELECT min(l_extendedprice) AS x0, max(l_extendedprice) AS x1, min(l_quantity) AS q0, max(l_quantity) AS q1 FROM lineitem), unnest(range(0, 400)) t(i), unnest(range(0, 10)) u(j) WHERE i <= floor((x1 - x0) / 500.0e0) AND j <= floor((q1 - q0) / 10.0e0)")
def grid_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.grid_seeds(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], [500.0, 10.0])


@query(f"WITH v AS {_VOL} SELECT v.a, v.b, round(sqrt(power((coalesce(u.value, v.value) - coalesce(d.value, v.value)) / 2, 2) + power((coalesce(r.value, v.value) - coalesce(l.value, v.value)) / 2, 2)), 4) AS edge FROM v LEFT JOIN v u ON u.a = v.a + 1 AND u.b = v.b LEFT JOIN v d ON d.a = v.a - 1 AND d.b = v.b LEFT JOIN v r ON r.a = v.a AND r.b = v.b + 1 LEFT JOIN v l ON l.a = v.a AND l.b = v.b - 1")
def edge_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.edge_strength(volume(spark, sf_dir), ["a", "b"]).select("a", "b", F.round("edge", 4).alias("edge"))


@query(f"WITH v AS {_VOL}, p AS (SELECT * FROM v WHERE value > (SELECT avg(value) FROM v)) SELECT a // 2 AS cell_a, b // 8 AS cell_b, count(*) AS n FROM p GROUP BY 1, 2")
def content_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    bright = v.crossJoin(F.broadcast(v.agg(F.avg("value").alias("__m")))).filter("value > __m")  # one row
    return raster.grid_histogram(bright, {"a": 2.0, "b": 8.0})


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming windows."""
    from ..streaming.progressive import windowed_counts

    out = windowed_counts(read(spark, sf_dir, "events"))
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("SELECT count(*) AS rows, count(DISTINCT vec_id) AS keys, (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS bad FROM embeddings")
def embedding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").agg(F.count("*").alias("rows"), F.count_distinct("vec_id").alias("keys"), F.sum(F.when(F.size("embedding") != 64, 1).otherwise(0)).alias("bad"))
