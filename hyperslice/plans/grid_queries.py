"""Codecs, meshes and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, covariance, curves
from ..operators import mesh, raster
from . import partition
from .registry import query, read
from .splat_queries import AXES, SIGMAS, SPLATS, splats


@query(
    """WITH c AS (SELECT event_id, event_id // 512 AS chunk, (value * 100)::BIGINT % 65536 AS code FROM events), d AS (SELECT *, ((code - lag(code, 1, 0) OVER (PARTITION BY chunk ORDER BY event_id) + 32768) % 65536 + 65536) % 65536 - 32768 AS x FROM c)
    SELECT event_id, code, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS delta FROM d"""
)
def delta_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: ``code`` comes from the deltas."""
    e = read(spark, sf_dir, "events")
    coded = e.select("event_id", F.floor(F.col("event_id") / 512).alias("chunk"), (F.rint(F.col("value") * 100).cast("bigint") % 65536).alias("raw"))
    there = codecs.delta_encode(coded, "raw", "chunk", "event_id")
    return codecs.delta_decode(there, "delta", "chunk", "event_id").select("event_id", "code", "delta")


@query(
    """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, ln(min(o_totalprice)) AS ll, ln(max(o_totalprice)) AS lh FROM orders)
    SELECT o_orderkey, round_even(least(greatest((o_totalprice - lo) / (hi - lo), 0), 1) * 255, 0)::INT AS linear8,
    round(lo + round_even((o_totalprice - lo) / (hi - lo) * 65535, 0) * ((hi - lo) / 65535), 4) AS linear16,
    (1 + round_even((ln(o_totalprice) - ll) / (lh - ll) * 254, 0))::INT AS geolog8 FROM orders, r"""
)
def quantise_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    ends = F.broadcast(o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.ln(F.min("o_totalprice")).alias("ll"), F.ln(F.max("o_totalprice")).alias("lh")))  # one row
    x, lo, hi = F.col("o_totalprice"), F.col("lo"), F.col("hi")
    wide = codecs.linear_decode(codecs.linear_encode(x, lo, hi, 16), lo, hi, 16)
    return o.crossJoin(ends).select("o_orderkey", codecs.linear_encode(x, lo, hi).alias("linear8"), F.round(wide, 4).alias("linear16"), codecs.geometric_encode(x, F.col("ll"), F.col("lh")).alias("geolog8"))


@query(
    """WITH y AS (SELECT c_custkey, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS y FROM customer), e AS (SELECT min(y) AS lo, max(y) AS hi FROM y),
    b AS (SELECT c_custkey, lo + round_even((y - lo) / (hi - lo) * 65535, 0) * ((hi - lo) / 65535) AS y FROM y, e) SELECT c_custkey, round(sign(y) * (exp(abs(y)) - 1), 3) AS back FROM b"""
)
def signed_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances by 16-bit codes of their signed log, and decoded again."""
    c = read(spark, sf_dir, "customer").withColumn("y", codecs.signed_log(F.col("c_acctbal")))
    ends = F.broadcast(c.agg(F.min("y").alias("lo"), F.max("y").alias("hi")))  # one row
    lo, hi = F.col("lo"), F.col("hi")
    coded = c.crossJoin(ends).withColumn("code", codecs.linear_encode(F.col("y"), lo, hi, 16))
    return coded.select("c_custkey", F.round(codecs.signed_log_decode(F.col("code"), lo, hi, 16), 3).alias("back"))


@query("SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def dictionary_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, lut = codecs.dictionary_encode(read(spark, sf_dir, "part"), "p_brand")
    return codecs.dictionary_decode(coded.select("p_partkey", "code"), lut).select("p_partkey", "p_brand", "code")


_V = "(SELECT p_partkey AS id, (p_partkey % 40)::DOUBLE AS x, ((p_partkey // 40) % 10)::DOUBLE AS y, (p_partkey % 3) / 7.0e0 AS z FROM part)"
_F = "(SELECT l_orderkey % n AS a, (l_partkey * 3) % n AS b, l_suppkey % n AS c, l_linenumber AS part FROM lineitem, (SELECT count(*) AS n FROM part))"


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every part is a vertex; every line is a face, its keys folded over the parts."""
    k, parts = F.col("p_partkey"), read(spark, sf_dir, "part")
    v = parts.select(k.alias("id"), (k % 40).cast("double").alias("x"), (F.floor(k / 40) % 10).cast("double").alias("y"), ((k % 3) / 7.0).alias("z"))
    lines = read(spark, sf_dir, "lineitem").crossJoin(F.broadcast(parts.agg(F.count("*").alias("__n"))))  # one row
    f = lines.select((F.col("l_orderkey") % F.col("__n")).alias("a"), ((F.col("l_partkey") * 3) % F.col("__n")).alias("b"), (F.col("l_suppkey") % F.col("__n")).alias("c"), F.col("l_linenumber").alias("part"))
    return v, f


@query(f"WITH v AS (SELECT *, min(id) OVER (PARTITION BY round(x, 6), round(y, 6), round(z, 6)) AS own FROM {_V}) SELECT va.own AS a, vb.own AS b, vc.own AS c FROM {_F} f JOIN v va ON f.a = va.id JOIN v vb ON f.b = vb.id JOIN v vc ON f.c = vc.id WHERE va.own <> vb.own AND vb.own <> vc.own AND va.own <> vc.own")
def weld_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _mesh(spark, sf_dir)
    return mesh.drop_degenerate(mesh.weld(v, f, "id", ["x", "y", "z"])[1]).select("a", "b", "c")


@query(f"WITH u AS (SELECT DISTINCT unnest([a, b, c]) AS v FROM {_F}) SELECT row_number() OVER (ORDER BY id) - 1 AS id, x, y FROM {_V} WHERE id IN (SELECT v FROM u)")
def prune_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _mesh(spark, sf_dir)
    return mesh.prune_vertices(v, f, "id")[0].select("id", "x", "y")


@query(f"WITH c AS (SELECT DISTINCT part, unnest([a, b, c]) AS v FROM {_F}), n AS (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY v) - 1 AS n FROM c) SELECT f.part, na.n AS a, nb.n AS b, nc.n AS c, f.a AS source_a FROM {_F} f JOIN n na ON na.part = f.part AND na.v = f.a JOIN n nb ON nb.part = f.part AND nb.v = f.b JOIN n nc ON nc.part = f.part AND nc.v = f.c")
def mesh_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.split_parts(_mesh(spark, sf_dir)[1], "part").select("part", "a", "b", "c", "source_a")


@query(f"WITH c AS (SELECT DISTINCT part, unnest([a, b, c]) AS v FROM {_F}) SELECT round(count(*) / count(DISTINCT v)::DOUBLE, 9) AS factor FROM c")
def duplication_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.duplication(_mesh(spark, sf_dir)[1], "part").withColumn("factor", F.round("factor", 9))


@query(f"SELECT f.a, f.b, f.c, round((va.x + vb.x + vc.x) / 3, 9) AS center_x FROM {_F} f JOIN {_V} va ON f.a = va.id JOIN {_V} vb ON f.b = vb.id JOIN {_V} vc ON f.c = vc.id")
def face_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _mesh(spark, sf_dir)
    return mesh.centroids(f, v, "id", ["x"]).select("a", "b", "c", F.round("center_x", 9).alias("center_x"))


@query(f"SELECT a, b, c FROM {_F} WHERE a IN (SELECT id FROM {_V} WHERE x < 20) AND b IN (SELECT id FROM {_V} WHERE x < 20) AND c IN (SELECT id FROM {_V} WHERE x < 20)")
def visible_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _mesh(spark, sf_dir)
    return mesh.visible_faces(f, v.filter("x < 20").select("id"), "id").select("a", "b", "c")


@query("SELECT o_orderkey, o_orderkey AS a, o_orderkey + i AS b, o_orderkey + i + 1 AS c FROM (SELECT o_orderkey, unnest(range(1, (o_orderkey % 6)::INT - 1)) AS i FROM orders WHERE o_orderkey % 6 >= 3)")
def fan_triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    polygons = read(spark, sf_dir, "orders").filter(k % 6 > 0).select("o_orderkey", F.sequence(k, k + k % 6 - 1).alias("corners"))
    return mesh.fan(polygons)


@query("SELECT floor(l_quantity / 5)::BIGINT AS cell_l_quantity, floor(l_discount / 0.02e0)::BIGINT AS cell_l_discount, count(*) AS n, round(sum(l_extendedprice), 2) AS weight FROM lineitem GROUP BY 1, 2")
def histogram_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.grid_histogram(read(spark, sf_dir, "lineitem"), {"l_quantity": 5.0, "l_discount": 0.02}, F.col("l_extendedprice"))
    return out.withColumn("weight", F.round("weight", 2))


_VOL = "(SELECT l_partkey // 10 AS a, l_quantity::INT AS b, sum(floor(l_extendedprice)) AS value FROM lineitem GROUP BY 1, 2)"


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane of voxels for every ten parts."""
    return read(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_partkey") / 10).alias("a"), F.col("l_quantity").cast("int").alias("b")).agg(F.sum(F.floor("l_extendedprice").cast("double")).alias("value"))


@query(f"SELECT a, b, round(sum(value) OVER (PARTITION BY b ORDER BY a), 1) AS along_a FROM (SELECT a, b, sum(value) OVER (PARTITION BY a ORDER BY b) AS value FROM {_VOL})")
def summed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.cumulative(volume(spark, sf_dir), ["b", "a"], "value").select("a", "b", F.round("cumulated", 1).alias("along_a"))


@query(f"SELECT round(sum(value), 2) AS total FROM {_VOL} WHERE a >= 2 AND a < 5 AND b >= 10 AND b < 20")
def box_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.box_sum(volume(spark, sf_dir), {"a": (2, 5), "b": (10, 20)}, "value").withColumn("total", F.round("total", 2))


@query(f"SELECT a, b, round(value, 2) AS value FROM {_VOL} ORDER BY value DESC, a, b LIMIT 1")
def densest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.densest(volume(spark, sf_dir), ["a", "b"], "value").withColumn("value", F.round("value", 2))


@query(f"SELECT a // 2 AS a, b // 10 AS b, round(avg(value), 3) AS value FROM {_VOL} GROUP BY 1, 2")
def downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.downscale(volume(spark, sf_dir), {"a": 2, "b": 10}).withColumn("value", F.round("value", 3))


@query(f"WITH v AS {_VOL} SELECT a, b FROM v p WHERE value > 300000 AND NOT EXISTS (SELECT 1 FROM v q, (VALUES (-1), (0), (1)) s(i), (VALUES (-1), (0), (1)) t(j) WHERE q.value > 300000 AND q.a = p.a + i AND q.b = p.b + j AND (q.value > p.value OR (q.value = p.value AND (q.a < p.a OR (q.a = p.a AND q.b < p.b)))))")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.local_maxima(volume(spark, sf_dir), ["a", "b"], 300000.0).select("a", "b")


@query(f"WITH v AS (SELECT *, (a * 7 + b) % 11 = 0 AS held FROM {_VOL}) SELECT h.a, h.b, round(quantile_cont(k.value, 0.5), 4) AS filled FROM (SELECT a, b, a + i AS na, b + j AS nb FROM v, (VALUES (-1), (0), (1)) s(i), (VALUES (-1), (0), (1)) t(j) WHERE held) h LEFT JOIN v k ON NOT k.held AND k.a = h.na AND k.b = h.nb GROUP BY 1, 2")
def donut_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir).withColumn("held", (F.col("a") * 7 + F.col("b")) % 11 == 0)
    return raster.donut_median(v, ["a", "b"], "held").withColumn("filled", F.round("filled", 4))


_HIST = f"""(WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM {_VOL}), c AS (SELECT least(floor((value - lo) / (hi - lo) * 64), 63)::INT AS bin, count(*) AS n FROM {_VOL}, e GROUP BY 1)
    SELECT b AS bin, coalesce(n, 0) AS n, lo + (b + 0.5e0) * (hi - lo) / 64 AS center FROM (SELECT unnest(range(0, 64)) AS b), e LEFT JOIN c ON c.bin = b)"""


@query(f"SELECT bin, n, round(center, 3) AS center FROM {_HIST}")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.histogram(volume(spark, sf_dir), 64).withColumn("center", F.round("center", 3))


@query(
    f"""WITH h AS (SELECT *, sum(n) OVER (ORDER BY bin) AS w, sum(n * bin) OVER (ORDER BY bin) AS m, sum(n) OVER () AS tw, sum(n * bin) OVER () AS tm FROM {_HIST}),
    v AS (SELECT center, (m * tw - tm * w)::DOUBLE AS gap, (w * (tw - w))::DOUBLE AS size FROM h WHERE w < tw)
    SELECT round(center, 3) AS threshold FROM v ORDER BY gap * gap / size DESC, center LIMIT 1"""
)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.otsu(volume(spark, sf_dir), 64).withColumn("threshold", F.round("threshold", 3))


@query(f"SELECT round(least((SELECT center FROM {_HIST} ORDER BY n DESC, center LIMIT 1), (SELECT quantile_cont(value, 0.5) FROM {_VOL})), 3) AS floor")
def background_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.background(volume(spark, sf_dir), bins=64).withColumn("floor", F.round("floor", 3))


@query(f"WITH v AS (SELECT value, value * 1.01e0 + 5 AS e, (a + b) % 5 = 0 AS held FROM {_VOL}) SELECT round(10 * log10(power(max(value) - min(value), 2) / avg(CASE WHEN held THEN (value - e) * (value - e) END)), 6) AS psnr FROM v")
def held_out_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir).withColumn("e", F.col("value") * 1.01 + 5)
    return v.agg(F.round(raster.psnr(F.col("value"), F.col("e"), (F.col("a") + F.col("b")) % 5 == 0), 6).alias("psnr"))


@query(
    f"""WITH v AS (SELECT (value - e) * (value - e) AS r, value, (a + b) % 5 = 0 AS held, a <= 3 AS fg FROM (SELECT *, value * 1.01e0 + 5 AS e FROM {_VOL})),
    s AS (SELECT count(*) FILTER (held AND fg) AS n1, count(*) FILTER (held AND NOT fg) AS n0, sum(r) FILTER (held AND fg) AS e1, sum(r) FILTER (held AND NOT fg) AS e0, max(value) - min(value) AS span FROM v)
    SELECT round(10 * log10(span * span / ((e1 + n1 / (2.0e0 * n0) * e0) / (n1 + n1 / (2.0e0 * n0) * n0))), 6) AS psnr FROM s"""
)
def weighted_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir)
    value, held = F.col("value"), (F.col("a") + F.col("b")) % 5 == 0
    return v.agg(F.round(raster.weighted_psnr(value, value * 1.01 + 5, held, F.col("a") <= 3, 2.0), 6).alias("psnr"))


@query(
    f"""WITH s AS (SELECT * FROM {SPLATS}), v AS (SELECT x0.i AS x, y0.i AS y, sum(amp * exp(-(power((x0.i - x) / sx, 2) + power((y0.i - y) / sy, 2)) / 2)) AS value FROM s, (SELECT unnest(range(0, 40)) AS i) x0, (SELECT unnest(range(0, 40)) AS i) y0
    WHERE power((x0.i - x) / sx, 2) + power((y0.i - y) / sy, 2) <= 9.0e0 GROUP BY 1, 2) SELECT x::INT AS x, y::INT AS y, round(value, 5) AS value FROM v WHERE abs(value) >= 1e-5"""
)
def render_splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.render(splats(spark, sf_dir), AXES[:2], SIGMAS[:2], "amp", (40, 40))
    return out.withColumn("value", F.round("value", 5))


@query("SELECT s_suppkey, round((1 - fx) * (1 - fy) * (10 * ix + iy) + fx * (1 - fy) * (10 * (ix + 1) + iy) + (1 - fx) * fy * (10 * ix + iy + 1) + fx * fy * (10 * (ix + 1) + iy + 1), 6) AS at_v FROM (SELECT s_suppkey, (s_suppkey % 8) AS ix, (s_suppkey % 7) AS iy, (s_suppkey % 4) / 4.0e0 AS fx, (s_suppkey % 5) / 5.0e0 AS fy FROM supplier)")
def trilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    points = read(spark, sf_dir, "supplier").select("s_suppkey", (k % 8 + (k % 4) / 4.0).alias("x"), (k % 7 + (k % 5) / 5.0).alias("y"))
    grid = spark.range(100).select(F.floor(F.col("id") / 10).alias("x"), (F.col("id") % 10).alias("y"), F.col("id").cast("double").alias("v"))
    return raster.trilinear(points, grid, ["x", "y"], ["v"]).select("s_suppkey", F.round("at_v", 6).alias("at_v"))


@query()
def streamline_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    points = read(spark, sf_dir, "supplier").select("s_suppkey", (k % 8 + 0.5).alias("x"), (k % 7 + 0.5).alias("y"))
    grid = spark.range(100).select(F.floor(F.col("id") / 10).alias("x"), (F.col("id") % 10).alias("y"), F.lit(1.0).alias("u"), (F.col("id") % 3).cast("double").alias("w"))
    return raster.rk4(points, grid, ["x", "y"], ["u", "w"], 0.25)


@query()
def hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = read(spark, sf_dir, "part")
    return k.select("p_partkey", curves.hilbert([F.col("p_size").cast("bigint"), F.col("p_partkey") % 64], 6).alias("code"))


@query(f"SELECT id, round(3 * greatest(sx, sy, sz), 6) AS radius, round(2 * sx, 6) AS chol0 FROM {SPLATS}")
def covariance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal factors, so that radius and scaled factor have a closed form to be compared with."""
    zero = F.lit(0.0)
    chol = F.array(F.col("sx"), zero, F.col("sy"), zero, zero, F.col("sz"))
    moved = covariance.transform_packed(chol, [[2.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]])
    return splats(spark, sf_dir).select("id", F.round(covariance.principal_radius(chol), 6).alias("radius"), F.round(moved[0], 6).alias("chol0"))


@query()
def bsp_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splats(spark, sf_dir)
    cells, weights, cell = partition.content_grid(s, ["x", "y"], 5.0)
    boxes = partition.plan(cells, weights, cell, target=200)
    return partition.assign(s, boxes, ["x", "y"]).groupBy("part").agg(F.count("*").alias("n"))


@query(f"SELECT a, b, round((value - (SELECT min(value) FROM {_VOL})) / ((SELECT max(value) FROM {_VOL}) - (SELECT min(value) FROM {_VOL})), 9) AS value FROM {_VOL}")
def normalise_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.normalise(volume(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query()
def equalise_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.equalise_tiles(raster.normalise(volume(spark, sf_dir)), ["a", "b"], 16, bins=32)


@query()
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.sample_by_intensity(volume(spark, sf_dir), 50, ["a", "b"])
