"""Rankings, noise, gains, counters of loaders and jobs, groups, prefetching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import View
from ..operators import chunks, graph, lod, metrics, raster
from .grid_queries import _VOL, volume
from .registry import query, read
from .relation_queries import _TREE, tree
from .slice_queries import _BOUNDS, ORDER_VIEW, _chunks
from .splat_queries import _MASS, AXES, SIGMAS, SPLATS, splats


@query(f"SELECT id, row_number() OVER (ORDER BY {_MASS} DESC, id) AS rank FROM {SPLATS}")
def rank_by_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod.ladder(splats(spark, sf_dir), "mass", 64, AXES, SIGMAS, "amp", "id").select("id", "rank")


@query(f"SELECT id, row_number() OVER (ORDER BY floor(log2(exp((ln(sx) + ln(sy) + ln(sz)) / 3))) DESC, amp * amp * power(pi(), 1.5) * (sx * sy * sz) DESC, id) AS rank FROM {SPLATS}")
def rank_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod.ladder(splats(spark, sf_dir), "spectral", 64, AXES, SIGMAS, "amp", "id").select("id", "rank")


@query()
def greedy_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod.ladder(splats(spark, sf_dir), "greedy", 64, AXES[:2], SIGMAS, "amp", "id").select("id", "rank", "lod")


@query(f"WITH n AS (SELECT count(*) AS n FROM {SPLATS}) SELECT level, greatest(1, n // CASE level WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 16 END)::BIGINT AS n FROM n, (SELECT unnest([0, 1, 2]) AS level)")
def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lod.pyramid(splats(spark, sf_dir), AXES, SIGMAS, "amp", "id", factor=4, levels=3, chunk=64)
    return lod.level_matrix(made, "amp").groupBy("level").agg(F.sum("n").alias("n"))


@query(
    f"""WITH v AS {_VOL}, p AS (SELECT abs(u.value - v.value) AS d, abs(u.value + w.value - 2 * v.value) AS l, CASE WHEN v.value <= (SELECT quantile_cont(value, 0.5) FROM v) THEN (SELECT quantile_cont(value, 0.5) FROM v) - v.value END AS b
      FROM v LEFT JOIN v u ON u.a = v.a AND u.b = v.b + 1 LEFT JOIN v w ON w.a = v.a AND w.b = v.b - 1)
    SELECT round(quantile_cont(d, 0.5) / (0.6744897501960817e0 * sqrt(2)), 3) AS difference, round(quantile_cont(l, 0.5) / (0.6744897501960817e0 * sqrt(6)), 3) AS laplacian, round(quantile_cont(b, 0.5) / 0.6744897501960817e0, 3) AS background FROM p"""
)
def noise_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.noise_floor(volume(spark, sf_dir), ["a", "b"])
    return spark.range(1).select(*[F.round(F.lit(found[n]), 3).alias(n) for n in ("difference", "laplacian", "background")])


@query(f"SELECT round(10 * log10(sum(value * value) / sum(power(value - (value * 1.01e0 + 5), 2))), 6) AS gain FROM {_VOL}")
def held_out_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    error = value - (value * 1.01 + 5)
    sums = volume(spark, sf_dir).agg(F.avg(error * error).alias("held"), raster.baseline_mse(value, F.lit(True)).alias("base"))
    return sums.select(F.round(raster.gain_db(F.col("held"), F.col("base")), 6).alias("gain"))


@query(f"SELECT round(quantile_cont((0.9e0 * value + a) / value, 0.5), 9) AS ratio FROM {_VOL} WHERE value > 300000")
def spot_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    spots = v.filter("value > 300000").withColumnRenamed("value", "peak")
    drawn = v.withColumn("value", 0.9 * F.col("value") + F.col("a"))
    return spark.range(1).select(F.round(F.lit(raster.spot_peak_ratio(drawn, spots, ["a", "b"])), 9).alias("ratio"))


@query("SELECT event_type, count(*) AS parts, round(sum(value), 4) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def loader_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.totals(read(spark, sf_dir, "events"), ["value"], ["event_id"], ["event_type"]).withColumn("value", F.round("value", 4))


@query("SELECT l_returnflag AS name, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'rows', count(*) FROM lineitem")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "lineitem").select(F.create_map(F.col("l_returnflag"), F.col("l_linenumber").cast("bigint"), F.lit("rows"), F.lit(1).cast("bigint")).alias("c"))
    return metrics.merged_counts(parts, "c")


@query("WITH j AS (SELECT o_custkey, min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 4 END) AS s FROM orders GROUP BY 1) SELECT ['failed', 'done', 'running', 'pending'][s] AS state, count(*) AS jobs FROM j GROUP BY 1")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    state = F.when(status == "P", "failed").when(status == "F", "done").when(status == "O", "running").otherwise("new")
    return metrics.job_states(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), state.alias("state")))


@query(f"SELECT path, CASE WHEN path <> 'w/empty' THEN 'points' END AS display_type FROM {_TREE} WHERE type IN ('group', 'scene')")
def display_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roll_up_types(tree(spark, sf_dir))


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that trade: an edge from each customer's nation to that of each supplier of its orders' lines, one for each pair of keys."""
    c, s = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    pairs = lines.join(o, "o_orderkey").select("c_custkey", "s_suppkey").distinct().join(c, "c_custkey").join(s, "s_suppkey")
    nodes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    return graph.louvain(nodes, pairs.select(F.col("c_nationkey").cast("bigint").alias("a"), F.col("s_nationkey").cast("bigint").alias("b")))


_NEAR = "hi_status >= 70 - 0.25 AND lo_status <= 70 + 0.25 AND hi_o_totalprice >= {at} - 20000 AND lo_o_totalprice <= {at} + 20000"


@query(f"SELECT chunk FROM {_BOUNDS} WHERE {_NEAR.format(at=170000)} AND NOT ({_NEAR.format(at=150000)})")
def prefetch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price goes up by 20,000 from view to view."""
    before = View(ORDER_VIEW.dims, ORDER_VIEW.position | {"o_totalprice": 130000.0}, ORDER_VIEW.tolerance)
    return chunks.prefetch(_chunks(spark, sf_dir), ORDER_VIEW, before, 20000.0).select("chunk")
