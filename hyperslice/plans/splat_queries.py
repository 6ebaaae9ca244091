"""Filters, culls, edits, unions and ladders over part, orders and events, taken as splats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import covariance, scalar
from ..operators import combine, edits, filters, infer, lod
from .registry import query, read

AXES, SIGMAS = ["x", "y", "z"], ["sx", "sy", "sz"]
SPLATS = """(SELECT p_partkey AS id, p_size::DOUBLE AS x, (p_partkey % 100)::DOUBLE AS y, p_retailprice / 100 AS z, p_retailprice AS amp,
    0.5e0 + 0.1e0 * (p_partkey % 7) AS sx, 0.5e0 + 0.2e0 * (p_partkey % 5) AS sy, 1.0e0 + 0.05e0 * p_size AS sz, p_brand AS brand FROM part)"""


def splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_size").cast("double").alias("x"),
        (key % 100).cast("double").alias("y"),
        (F.col("p_retailprice") / 100).alias("z"),
        F.col("p_retailprice").alias("amp"),
        (0.5 + 0.1 * (key % 7)).alias("sx"),
        (0.5 + 0.2 * (key % 5)).alias("sy"),
        (1.0 + 0.05 * F.col("p_size")).alias("sz"),
        F.col("p_brand").alias("brand"),
    )


def sig() -> list:
    return [F.col(s) for s in SIGMAS]


_SCALE = "exp((ln(sx) + ln(sy) + ln(sz)) / 3)"
_MASS = "(amp * (sx * sy * sz))"


@query(f"SELECT id, amp FROM {SPLATS} WHERE x >= 10 AND x <= 30 AND y >= 20 AND z <= 15")
def filter_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splats(spark, sf_dir).filter(filters.in_box({"x": (10, 30), "y": (20, None), "z": (None, 15)})).select("id", "amp")


@query(f"SELECT id FROM {SPLATS} WHERE x >= 10 AND x < 30")
def crop_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splats(spark, sf_dir).filter(filters.in_box({"x": (10, 30)}, half_open=True)).select("id")


@query(f"WITH s AS (SELECT *, {_MASS} AS m FROM {SPLATS}) SELECT id FROM s WHERE amp >= (SELECT quantile_cont(amp, 0.4) FROM s) AND m <= (SELECT quantile_cont(m, 0.9) FROM s)")
def filter_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = [(F.col("amp"), "min", "percentile", 40.0), (covariance.mass(F.col("amp"), sig()), "max", "percentile", 90.0)]
    return filters.filter_by(splats(spark, sf_dir), limits).select("id")


@query(f"SELECT id, amp FROM {SPLATS} WHERE amp >= (SELECT max(amp) * 0.7e0 FROM {SPLATS}) AND sz <= 3.0e0")
def filter_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by(splats(spark, sf_dir), [(F.col("amp"), "min", "normalized", 0.7), (F.col("sz"), "max", "absolute", 3.0)]).select("id", "amp")


@query(f"SELECT id, round({_SCALE}, 9) AS scale, round({_MASS}, 6) AS mass, round(power((sx * sx) * (sy * sy) * (sz * sz), 1.0e0 / 3), 9) AS volume, round(greatest(sx, sy, sz) / least(sx, sy, sz), 9) AS eccentricity, round(amp * amp * power(pi(), 1.5) * (sx * sy * sz), 3) AS energy FROM {SPLATS}")
def splat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    amp = F.col("amp")
    made = {"scale": (covariance.geometric_mean(sig()), 9), "mass": (covariance.mass(amp, sig()), 6), "volume": (covariance.volume(sig()), 9), "eccentricity": (covariance.eccentricity(sig()), 9), "energy": (covariance.self_energy(amp, sig()), 3)}
    return splats(spark, sf_dir).select("id", *[F.round(c, d).alias(n) for n, (c, d) in made.items()])


@query(f"SELECT id, round(amp * t * t * (3 - 2 * t), 6) AS amp FROM (SELECT id, amp, greatest(0, least(1, (log2({_SCALE}) - log2(1.2e0)) / 1.0e0 + 0.5e0)) AS t FROM {SPLATS})")
def soft_highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filters.soft_filter(splats(spark, sf_dir), "amp", covariance.geometric_mean(sig()), highpass=1.2)
    return out.select("id", F.round("amp", 6).alias("amp"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_totalprice DESC, o_orderkey) - o_totalprice AS before, sum(o_totalprice) OVER () AS total FROM orders) WHERE before < 0.6e0 * total")
def cull_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.cull(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"], retention=0.6).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.05) FROM orders)")
def cull_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.cull(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"], method="percentile").select("o_orderkey")


@query(f"WITH s AS (SELECT *, power((sx * sx) * (sy * sy) * (sz * sz), 1.0e0 / 3) AS v FROM {SPLATS}) SELECT id FROM s WHERE amp >= (SELECT quantile_cont(amp, 0.05) FROM s) AND v <= (SELECT quantile_cont(v, 0.95) FROM s)")
def cull_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.cull(splats(spark, sf_dir), "amp", ["id"], method="combined", volume=covariance.volume(sig())).select("id")


@query(f"SELECT id FROM {SPLATS} WHERE {_SCALE} >= 1.1e0")
def min_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_faint(splats(spark, sf_dir), covariance.geometric_mean(sig()), 1.1).select("id")


@query(f"SELECT (SELECT count(*) FROM {SPLATS} WHERE NOT (amp >= 1000)) AS removed, round((SELECT sum(amp) FROM {SPLATS} WHERE NOT (amp >= 1000)), 4) AS removed_amplitude")
def removal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splats(spark, sf_dir)
    report = filters.removal_report(s, s.filter("amp >= 1000"), "amp", covariance.mass(F.col("amp"), sig()))
    return report.select("removed", F.round("removed_amplitude", 4).alias("removed_amplitude"))


@query(f"WITH s AS (SELECT id, least(1500, greatest(1000, amp * 1.1e0 + 5)) AS a FROM {SPLATS}) SELECT id, round(a / (SELECT max(a) FROM s), 9) AS amp FROM s")
def amplitude_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = edits.clamp_amplitude(edits.scale_offset(splats(spark, sf_dir), "amp", 1.1, 5.0), "amp", 1000.0, 1500.0)
    s = edits.normalise_amplitude(s, "amp")
    return s.select("id", F.round("amp", 9).alias("amp"))


@query(f"SELECT id, round(amp / (SELECT quantile_cont(amp, 0.999) FROM {SPLATS}), 9) AS amp FROM {SPLATS}")
def normalise_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.normalise_brightness(splats(spark, sf_dir), "amp").select("id", F.round("amp", 9).alias("amp"))


@query(f"SELECT round(sum(x * amp) / sum(amp), 6) AS x, round(sum(y * amp) / sum(amp), 6) AS y, round(sum(z * amp) / sum(amp), 6) AS z FROM {SPLATS}")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.weighted_centroid(splats(spark, sf_dir), AXES, "amp").select(*[F.round(a, 6).alias(a) for a in AXES])


@query(f"SELECT id, round(x - (SELECT sum(x * amp) / sum(amp) FROM {SPLATS}), 6) AS x, z FROM {SPLATS}")
def center_at_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.center(splats(spark, sf_dir), ["x", "y"], "amp").select("id", (F.round("x", 6) + 0.0).alias("x"), "z")


@query(f"SELECT id, round(2 * x - y + 1, 6) AS x, round(x + 3 * z - 4, 6) AS y, round(0.5e0 * z, 6) AS z FROM {SPLATS}")
def linear_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = [[2.0, -1.0, 0.0, 1.0], [1.0, 0.0, 3.0, -4.0], [0.0, 0.0, 0.5, 0.0], [0.0, 0.0, 0.0, 1.0]]
    return edits.linear_map(splats(spark, sf_dir), AXES, m).select("id", *[F.round(a, 6).alias(a) for a in AXES])


@query(f"SELECT id, list_position(['Brand#1', 'Brand#2', 'Brand#3'], brand) - 1 AS label_id FROM {SPLATS}")
def categorical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edits.with_labels(splats(spark, sf_dir), ["Brand#1", "Brand#2", "Brand#3"], "brand")
    return out.select("id", "label_id")


@query("SELECT s_suppkey AS id, s_acctbal AS v, 1.0e0 AS r, 1.0e0 AS a FROM supplier UNION ALL SELECT c_custkey, c_acctbal, (c_nationkey / 25.0e0), 0.5e0 FROM customer")
def concat_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    color = F.array(F.col("c_nationkey") / 25.0, F.lit(0.0), F.lit(0.0), F.lit(0.5))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), color.alias("color"))
    return combine.concatenate([a, b]).select("id", "v", F.col("color")[0].alias("r"), F.col("color")[3].alias("a"))


@query("SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 0.0e0 WHEN 'O' THEN 1.0e0 ELSE 2.0e0 END AS t, 1e-7 AS sigma_t FROM orders")
def stack_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    parts = [o.filter(F.col("o_orderstatus") == s).select("o_orderkey", "o_totalprice") for s in "FOP"]
    return combine.as_new_dimension(parts, "t", [0, 1, 2])


@query("SELECT s_suppkey AS id, 0.0e0 AS g FROM supplier UNION ALL SELECT c_custkey, 0.25e0 FROM customer")
def channel_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return combine.with_channel_colors([a, b], [(1, 0, 0), (0, 0.25, 1)]).select("id", F.col("color")[1].alias("g"))


@query("SELECT s_suppkey, t, u FROM supplier, (SELECT unnest([0.0e0, 0.5e0, 1.0e0]) AS t), (SELECT unnest([3.0e0, 7.0e0]) AS u)")
def broadcast_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey")
    return combine.to_all_slices(s, {"t": (0.0, 1.0, 0.5), "u": [7, 3, 7]})


@query("SELECT c_custkey, 0 AS coloring, c_mktsegment AS color FROM customer UNION ALL SELECT c_custkey, 1, c_nationkey::VARCHAR FROM customer")
def stack_colorings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return combine.stack_colorings(c, [F.col("c_mktsegment"), F.col("c_nationkey").cast("string")]).select("c_custkey", "coloring", "color")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text, lang")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.distinct_content(read(spark, sf_dir, "documents"), ["text", "lang"], "doc_id").select("doc_id", "copies")


@query("SELECT event_id, hour // 3 AS hour FROM (SELECT event_id, extract(hour FROM ts) AS hour FROM events) WHERE hour % 3 = 0")
def restride_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.hour("ts").cast("double").alias("hour"))
    return combine.restride(e, "hour", 3)


@query("WITH c AS (SELECT (1000 * power(2, i))::BIGINT AS c FROM (SELECT unnest(range(0, 40)) AS i), (SELECT count(*) AS n FROM orders) WHERE 1000 * power(2, i) < n AND n - 1000 * power(2, i) >= 500), r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), l AS (SELECT (SELECT count(*) FROM c WHERE c < r)::INT AS lod, count(*) AS n, sum(o_totalprice) AS e FROM r GROUP BY 1) SELECT lod, n, round(sum(e) OVER (ORDER BY lod) / sum(e) OVER (), 9) AS energy FROM l")
def lod_prefix_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    levels = lod.with_levels(o, [F.desc("o_totalprice"), F.col("o_orderkey")], lod.stream_cuts(o.count(), 1000))
    return lod.level_energy(levels, "lod", F.col("o_totalprice")).withColumn("energy", F.round("energy", 9))


_G = "least(floor((x - (SELECT min(x) FROM {t})) / ((SELECT max(x) FROM {t}) - (SELECT min(x) FROM {t})) * {n}), {m}), least(floor((y - (SELECT min(y) FROM {t})) / ((SELECT max(y) FROM {t}) - (SELECT min(y) FROM {t})) * {n}), {m})"


@query(
    f"""WITH s AS (SELECT id, x, y FROM {SPLATS}),
    a AS (SELECT *, row_number() OVER (PARTITION BY {_G.format(t="s", n=2, m=1)} ORDER BY id) AS k FROM s),
    b AS (SELECT *, row_number() OVER (PARTITION BY {_G.format(t="s", n=4, m=3)} ORDER BY id) AS k2 FROM a WHERE k > 1)
    SELECT id, 0 AS lod FROM a WHERE k = 1 UNION ALL SELECT id, CASE WHEN k2 = 1 THEN 1 ELSE 2 END FROM b"""
)
def stratified_grid_lod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod.stratified_levels(splats(spark, sf_dir).select("id", "x", "y"), ["x", "y"], "id", 3).select("id", "lod")


@query(f"SELECT id FROM {SPLATS} ORDER BY amp * amp * power(pi(), 1.5) * (sx * sy * sz) DESC, id LIMIT 200")
def decimate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod.decimate(splats(spark, sf_dir), 200, AXES, SIGMAS, "amp", "id", method="prefix").select("id")


@query(
    f"""WITH s AS (SELECT *, {_MASS} AS m FROM {SPLATS}), g AS (SELECT brand, count(*) AS n, sum(m) AS mass, sum(m * x) / sum(m) AS x, sum(m * (sx * sx + x * x)) / sum(m) AS q FROM s GROUP BY brand)
    SELECT brand, n, round(mass, 3) AS mass, round(x, 6) AS x, round(sqrt(q - x * x), 6) AS sx FROM g"""
)
def moment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lod.merge_bins(splats(spark, sf_dir), "brand", AXES, SIGMAS, "amp")
    return out.select("brand", "n", F.round("mass", 3).alias("mass"), F.round("x", 6).alias("x"), F.round("sx", 6).alias("sx"))


@query()
def morton_partition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splats(spark, sf_dir)
    return lod.merge_bins(lod.equal_bins(s, AXES, ["id"], 100), "bin", AXES, SIGMAS, "amp")


@query()
def lloyd_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lod.equal_bins(splats(spark, sf_dir), AXES, ["id"], 50)
    return lod.merge_bins(lod.refine_bins(s, "bin", AXES, SIGMAS, "amp", "id", 10.0, 2), "bin", AXES, SIGMAS, "amp")


@query("SELECT l_orderkey AS id, round(CASE WHEN e0 = e1 THEN 0 ELSE t * t * (3 - 2 * t) END, 9) AS s FROM (SELECT l_orderkey, 5.0e0 AS e0, 40.0e0 AS e1, greatest(0, least(1, (l_quantity - 5) / 35.0e0)) AS t FROM lineitem)")
def smoothstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.round(scalar.smoothstep(5.0, 40.0, F.col("l_quantity")), 9).alias("s"))


@query("SELECT l_orderkey AS id, round(-ln(1 - least(l_discount * 10, 1 - 1 / 512.0e0)), 9) + 0.0e0 AS depth, round(least(l_discount * 10, 1 - 1 / 512.0e0), 9) + 0.0e0 AS opacity FROM lineitem")
def optical_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = scalar.optical_depth(F.col("l_discount") * 10)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.round(depth, 9) + 0.0).alias("depth"), (F.round(scalar.opacity(depth), 9) + 0.0).alias("opacity"))


@query("SELECT 'l_linenumber' AS axis, 7 AS distinct, true AS barrier UNION ALL SELECT 'l_tax', (SELECT count(DISTINCT round_even(l_tax, 0)) FROM lineitem), false UNION ALL SELECT 'l_quantity', (SELECT count(DISTINCT l_quantity) FROM lineitem), true UNION ALL SELECT 'l_orderkey', (SELECT count(DISTINCT l_orderkey) FROM lineitem), false")
def barrier_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.barrier_axes(read(spark, sf_dir, "lineitem"), ["l_linenumber", "l_tax", "l_quantity", "l_orderkey"])


@query("WITH d AS (SELECT DISTINCT p_brand, 6 * p_size + 3 AS v FROM part), g AS (SELECT p_brand, v - lag(v) OVER (PARTITION BY p_brand ORDER BY v) AS gap FROM d) SELECT p_brand, coalesce(list_reduce(list(gap) FILTER (gap IS NOT NULL), lambda x, y: gcd(x, y)), 1)::DOUBLE AS step FROM g GROUP BY p_brand")
def discrete_step_gcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.discrete_step(read(spark, sf_dir, "part").withColumn("at", 6 * F.col("p_size") + 3), "at", ["p_brand"])


@query("WITH s AS (SELECT DISTINCT c_mktsegment, floor(c_acctbal / 10)::BIGINT AS balance FROM customer), z AS (SELECT c_mktsegment AS m FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT a.c_mktsegment, b.balance FROM (SELECT DISTINCT c_mktsegment FROM s) a, (SELECT balance FROM s, z WHERE c_mktsegment = m) b EXCEPT SELECT c_mktsegment, balance FROM s")
def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.missing_values(read(spark, sf_dir, "customer").withColumn("balance", F.floor(F.col("c_acctbal") / 10)), "c_mktsegment", "balance")


@query("SELECT 'x' AS axis, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem UNION ALL SELECT 'y', min(l_tax) + 0.0e0, max(l_tax) FROM lineitem UNION ALL SELECT 'one', 1.0e0, 2.0e0")
def inferred_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = infer.aligned(read(spark, sf_dir, "lineitem"), {"x": "l_quantity", "y": "l_tax", "one": 1.0})
    return infer.inferred_ranges(lines, ["x", "y", "one"]).withColumn("low", F.col("low") + 0.0)


@query("SELECT 'price' AS rule, (SELECT count(*) FROM orders WHERE NOT (o_totalprice > 1000)) AS violations, (SELECT count(*) FROM orders) AS rows UNION ALL SELECT 'status', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P'), (SELECT count(*) FROM orders)")
def quality_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.scan_rules(read(spark, sf_dir, "orders"), {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")})


@query("SELECT l_linenumber, coalesce(min(l_quantity), 0) AS lo_l_quantity, coalesce(max(l_quantity), 0) AS hi_l_quantity, min(l_tax) + 0.0e0 AS lo_l_tax, max(l_tax) AS hi_l_tax FROM lineitem GROUP BY 1")
def position_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.bounds(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], ["l_linenumber"]).withColumn("lo_l_tax", F.col("lo_l_tax") + 0.0)
