"""Slices, chunk index and projections over lineitem, taken as points of five dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import Affine, Dimension, Permutation, Transform, View, applied, inverted, on_bounds
from ..functions import scalar
from ..operators import affine, chunks, ordering, slicing
from .registry import query, read

LINE_DIMS = (
    Dimension("l_quantity", display=True),
    Dimension("l_extendedprice", display=True),
    Dimension("l_discount", display=True),
    Dimension("l_linenumber", discrete=True, low=1, high=7),
    Dimension("l_tax", spatial=True, low=0.0, high=0.08),
)
COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LISTED = ", ".join(COLUMNS)


def line_view(line: float = 3.0, tax: float = 0.04, reach: float = 0.011, extend: tuple[str, ...] = ()) -> View:
    return View(LINE_DIMS, {"l_linenumber": line, "l_tax": tax}, {"l_tax": reach}, extend)


@query(f"SELECT {LISTED} FROM lineitem WHERE abs(l_linenumber - 3.0) <= 0.5 AND abs(l_tax - 0.04e0) <= 0.011e0")
def slice_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.slice_points(read(spark, sf_dir, "lineitem").select(*COLUMNS), line_view())


@query(f"SELECT {LISTED} FROM lineitem WHERE abs(l_linenumber - 3.0) <= 0.5")
def slice_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.slice_points(read(spark, sf_dir, "lineitem").select(*COLUMNS), line_view(extend=("l_tax",)))


@query(
    f"""SELECT {LISTED}, round(sqrt(r * r - g), 9) AS radius FROM (
    SELECT *, 0.02e0 + 0.001e0 * l_quantity AS r, (l_tax - 0.04e0) * (l_tax - 0.04e0) AS g FROM lineitem)
    WHERE abs(l_linenumber - 3.0) <= 0.5 AND g < r * r"""
)
def slice_effective_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    radius = 0.02 + 0.001 * F.col("l_quantity")
    lines = read(spark, sf_dir, "lineitem").select(*COLUMNS)
    cut = slicing.slice_spheres(lines, line_view(), radius, max_radius=0.02 + 0.001 * 50)  # quantities go up to 50
    return cut.withColumn("radius", F.round("radius", 9))


@query(
    """SELECT l_orderkey, round(a, 6) AS sliced_amplitude FROM (
    SELECT l_orderkey, l_linenumber, l_extendedprice * exp(-power((l_tax - 0.04e0) / (0.005e0 + 0.0001e0 * l_quantity), 2) / 2) AS a FROM lineitem)
    WHERE abs(l_linenumber - 3.0) <= 0.5 AND a >= 1e-6"""
)
def slice_splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    sigma = 0.005 + 0.0001 * F.col("l_quantity")
    most = lines.agg(F.max("l_extendedprice").alias("amp"), F.max(sigma).alias("sigma")).first()
    out = slicing.slice_splats(lines, line_view(), "l_extendedprice", {"l_tax": sigma}, most["amp"], {"l_tax": most["sigma"] or 0.0})
    return out.select("l_orderkey", F.round("sliced_amplitude", 6).alias("sliced_amplitude"))


@query("SELECT l_orderkey, l_extendedprice AS x, l_quantity AS y, 0.0e0 AS z FROM lineitem")
def project_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.project(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], ["l_orderkey"])


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size BETWEEN 10 - 5 AND 10 + 5 AND isfinite(p_size::DOUBLE)")
def slab_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = View((Dimension("p_retailprice", display=True), Dimension("p_size", spatial=True, low=0, high=50)), {"p_size": 10.0}, {"p_size": 5.0})
    parts = read(spark, sf_dir, "part")
    return parts.filter(slicing.in_slab(view, {"p_size": F.col("p_size").cast("double")})).select("p_partkey", "p_retailprice")


@query(
    """SELECT o_orderkey, round(t0, 9) + 0.0e0 AS t0, round(t1, 9) + 0.0e0 AS t1, round(x0 + (x1 - x0) * t0, 2) AS a_x, round(x0 + (x1 - x0) * t1, 2) AS b_x FROM (
    SELECT *, greatest(0, least((40 - a) / nullif(b - a, 0), (60 - a) / nullif(b - a, 0))) AS t0, least(1, greatest((40 - a) / nullif(b - a, 0), (60 - a) / nullif(b - a, 0))) AS t1
    FROM (SELECT o_orderkey, (o_orderkey % 101)::DOUBLE AS a, (o_custkey % 97)::DOUBLE AS b, floor(o_totalprice) AS x0, floor(o_totalprice) + 96 * 100 AS x1 FROM orders))
    WHERE (b <> a OR abs(a - 50) <= 10) AND coalesce(t0, 0) <= coalesce(t1, 1)"""
)
def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    seg = o.select("o_orderkey", (F.col("o_orderkey") % 101).cast("double").alias("a_t"), (F.col("o_custkey") % 97).cast("double").alias("b_t"), F.floor("o_totalprice").cast("double").alias("a_x"), (F.floor("o_totalprice") + 9600.0).alias("b_x"))
    view = View((Dimension("x", display=True), Dimension("t", spatial=True, low=0, high=100)), {"t": 50.0}, {"t": 10.0})
    out = slicing.clip_segments(seg, view)
    return out.select("o_orderkey", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("t0", 9), ("t1", 9), ("a_x", 2), ("b_x", 2))])


_ORDER_GRID = """(SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus,
    (least(greatest((o_custkey - c0) / (c1 - c0)::DOUBLE, 0), 1) * 1023)::DOUBLE AS gx0, (least(greatest((o_totalprice - p0) / (p1 - p0), 0), 1) * 1023) AS gy0
    FROM orders, (SELECT min(o_custkey) AS c0, max(o_custkey) AS c1, min(o_totalprice) AS p0, max(o_totalprice) AS p1 FROM orders))"""
_MORTON = "(" + " + ".join(f"((trunc(gx0)::BIGINT >> {b}) & 1) * {1 << (2 * b)} + ((trunc(gy0)::BIGINT >> {b}) & 1) * {1 << (2 * b + 1)}" for b in range(10)) + ")"


@query(f"SELECT o_orderkey, {_MORTON}::BIGINT AS code FROM {_ORDER_GRID}")
def morton_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = ordering.grid_codes(read(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice"], 10)
    return coded.select("o_orderkey", "code")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("status", F.ascii("o_orderstatus").cast("double"))
    return ordering.spatial_order(o, ["status"], ["o_custkey", "o_totalprice"], ["o_orderkey"], 10)


_ORDERED = f"(SELECT *, ascii(o_orderstatus)::DOUBLE AS status, row_number() OVER (ORDER BY ascii(o_orderstatus), {_MORTON}, o_orderkey) - 1 AS ord FROM {_ORDER_GRID})"


@query(f"SELECT o_orderkey, ord FROM {_ORDERED}")
def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("o_orderkey", "ord")


_BOUNDS = f"""(SELECT ord // 256 AS chunk, count(*) AS n, min(o_custkey - 5.0e0) AS lo_o_custkey, max(o_custkey + 5.0e0) AS hi_o_custkey,
    min(o_totalprice - 5.0e0) AS lo_o_totalprice, max(o_totalprice + 5.0e0) AS hi_o_totalprice,
    min(status - 1e-6) AS lo_status, max(status + 1e-6) AS hi_status FROM {_ORDERED} GROUP BY 1)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_bounds(_ordered(spark, sf_dir), 256, ["o_custkey", "o_totalprice"], ["status"], F.lit(5.0))


@query(f"SELECT * FROM {_BOUNDS}")
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


ORDER_VIEW = View((Dimension("o_custkey", display=True), Dimension("status", discrete=True, low=0, high=127), Dimension("o_totalprice", spatial=True, low=0, high=600000)), {"status": float(ord("F")), "o_totalprice": 150000.0})


@query(f"SELECT chunk, n FROM {_BOUNDS} WHERE hi_status >= 70 - 0.25 AND lo_status <= 70 + 0.25 AND hi_o_totalprice >= 150000 - 20000 AND lo_o_totalprice <= 150000 + 20000")
def chunk_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.prune(_chunks(spark, sf_dir), ORDER_VIEW, 20000.0).select("chunk", "n")


@query(
    f"""WITH r AS (SELECT chunk * 256 AS start, least((chunk + 1) * 256, (SELECT count(*) FROM orders)) AS stop FROM {_BOUNDS} WHERE lo_o_totalprice <= 170000 AND hi_o_totalprice >= 130000 AND hi_status >= 69.75 AND lo_status <= 70.25),
    f AS (SELECT *, CASE WHEN start <= max(stop) OVER (ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
    g AS (SELECT *, sum(fresh) OVER (ORDER BY start, stop) AS island FROM f)
    SELECT min(start) AS start, max(stop) AS stop FROM g GROUP BY island"""
)
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "orders").count()
    return chunks.merge_ranges(chunks.row_ranges(chunks.prune(_chunks(spark, sf_dir), ORDER_VIEW, 20000.0), 256, n))


@query(
    """WITH d AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity = 7 AND l_discount = 0.05),
    g AS (SELECT id, id - row_number() OVER (ORDER BY id) AS run FROM d) SELECT min(id) AS start, max(id) + 1 AS stop FROM g GROUP BY run"""
)
def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").filter("l_quantity = 7 AND l_discount = 0.05")
    return chunks.id_ranges(lines, "l_suppkey", 16)


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE abs(l_linenumber - 2) <= 0.5 AND abs(l_tax - 0.02e0) <= 0.005e0")
def nd_affine_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World coordinates are 2n + 1 and tax * -100 + 3: the view is inverted, the data stay."""
    transform: Transform = {"l_linenumber": Affine(2, 1), "l_tax": Affine(-100, 3)}
    view = View(LINE_DIMS, {"l_linenumber": 5.0, "l_tax": 1.0}, {"l_tax": 0.5})
    local = inverted(view, transform)
    return slicing.slice_points(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), local)


@query("SELECT l_orderkey, [3.0e0, 1.0e0, 4.0e0, 0.0e0, 6.0e0, 2.0e0, 5.0e0][l_linenumber] AS world, l_quantity * 2 - 1 AS x FROM lineitem")
def permute_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Permutation((3, 1, 4, 0, 6, 2, 5))
    lines = read(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", applied(F.col("l_linenumber") - 1.0, order).alias("world"), applied(F.col("l_quantity"), Affine(2, -1)).alias("x"))


@query("SELECT o_orderstatus, least(lo * -0.5e0 + 10, hi * -0.5e0 + 10) AS low, greatest(lo * -0.5e0 + 10, hi * -0.5e0 + 10) AS high FROM (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)")
def bounds_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    low, high = on_bounds(F.col("lo"), F.col("hi"), Affine(-0.5, 10))
    return b.select("o_orderstatus", low.alias("low"), high.alias("high"))


_TURN = affine.composed(affine.scaling(2, 3, 4), affine.rotation((0, 0, 1), 90), affine.translation(1, -2, 3))


@query(
    """WITH b AS (SELECT min(l_quantity) x0, max(l_quantity) x1, min(l_discount) y0, max(l_discount) y1, min(l_tax) z0, max(l_tax) z1, l_returnflag FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, round(-3 * y1 + 1, 6) AS lo_x, round(-3 * y0 + 1, 6) AS hi_x, round(2 * x0 - 2, 6) AS lo_y, round(2 * x1 - 2, 6) AS hi_y, round(4 * z0 + 3, 6) AS lo_z, round(4 * z1 + 3, 6) AS hi_z FROM b"""
)
def bounds_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = ["l_quantity", "l_discount", "l_tax"]
    b = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[f(a).alias(f"{p}{i}") for i, a in enumerate(axes) for f, p in ((F.min, "a"), (F.max, "b"))])
    low, high = affine.moved_box([F.col(f"a{i}") for i in range(3)], [F.col(f"b{i}") for i in range(3)], _TURN)
    return b.select("l_returnflag", *[F.round(c, 6).alias(f"{p}_{a}") for p, cs in (("lo", low), ("hi", high)) for c, a in zip(cs, "xyz", strict=True)])


@query("SELECT l_orderkey, lo_day FROM (SELECT l_orderkey, min(l_linenumber) AS lo_day, max(l_linenumber) AS hi_day FROM lineitem GROUP BY 1) WHERE hi_day >= 6 - 0.750006e0 AND lo_day <= 6 + 0.750006e0")
def partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo_l_linenumber"), F.max("l_linenumber").alias("hi_l_linenumber"))
    view = View((Dimension("x", display=True), Dimension("l_linenumber", discrete=True, low=1, high=7)), {"l_linenumber": 6.0})
    return slicing.parts_on_slice(parts, view).select("l_orderkey", F.col("lo_l_linenumber").alias("lo_day"))


@query("SELECT s_suppkey, upper(printf('#%02X%02X%02X', s_suppkey % 256, (s_suppkey * 7) % 256, (s_suppkey * 13) % 256)) AS hex, round(CASE WHEN (s_suppkey % 256) / 255.0e0 <= 0.04045e0 THEN (s_suppkey % 256) / 255.0e0 / 12.92e0 ELSE pow(((s_suppkey % 256) / 255.0e0 + 0.055e0) / 1.055e0, 2.4e0) END, 9) AS linear FROM supplier")
def hex_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    channels = [((F.col("s_suppkey") * m) % 256) / 255.0 for m in (1, 7, 13)]
    linear = [scalar.srgb_to_linear(c) for c in channels]
    text = scalar.rgb_to_hex(*linear)
    return s.select("s_suppkey", text.alias("hex"), F.round(scalar.srgb_to_linear(scalar.hex_to_rgb(text)[0]), 9).alias("linear"))


_PAL = [f"#{(i * 2654435761) % 16777216:06X}" for i in range(256)]


@query(
    f"""SELECT c_custkey, {_PAL!r}[CASE WHEN hi > lo THEN round_even((c_acctbal - lo) / (hi - lo) * 255, 0)::INT ELSE 0 END + 1] AS color
    FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"""
)
def lut_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    ends = F.broadcast(c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")))  # one row
    return c.crossJoin(ends).select("c_custkey", scalar.palette_color(scalar.lut_index(F.col("c_acctbal"), F.col("lo"), F.col("hi")), _PAL).alias("color"))
