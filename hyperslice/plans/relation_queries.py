"""Neighbours, graphs and trees over embeddings, orders, lineitem and the geography tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, neighbors
from .registry import query, read

PLACES = "(SELECT p_partkey AS id, (p_partkey * 37 % 101) / 10.0e0 AS x, (p_partkey * 53 % 97) / 10.0e0 AS y, p_size % 5 AS g FROM part)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("id"), ((k * 37 % 101) / 10.0).alias("x"), ((k * 53 % 97) / 10.0).alias("y"), (F.col("p_size") % 5).alias("g"))


_D2 = "(0.0e0 + (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"WITH p AS {PLACES} SELECT a.id, count(b.id) AS neighbors FROM p a LEFT JOIN p b ON a.g = b.g AND a.id <> b.id AND {_D2} < 0.5e0 * 0.5e0 GROUP BY a.id")
def neighbor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.neighbor_counts(places(spark, sf_dir), ["x", "y"], 0.5, "id", ["g"])


@query(f"WITH p AS {PLACES}, d AS (SELECT a.id, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS n FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id) SELECT id, round(d, 9) AS distance FROM d WHERE n = 3")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbors.kth_distance(places(spark, sf_dir), ["x", "y"], 3, "id", 0.4, ["g"])
    return out.select("id", F.round("distance", 9).alias("distance"))


@query(f"WITH p AS {PLACES} SELECT DISTINCT a.id FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id AND {_D2} <= 0.09e0")
def isolation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.isolation_filter(places(spark, sf_dir), ["x", "y"], "id", 0.3, 0.3, ["g"]).select("id")


@query(f"WITH p AS {PLACES}, q AS (SELECT s_suppkey AS sid, (s_suppkey * 29 % 103) / 10.0e0 AS x, (s_suppkey * 41 % 89) / 10.0e0 AS y FROM supplier) SELECT sid AS query, b.id, round({_D2}, 9) AS d2 FROM q a JOIN p b ON {_D2} < 0.7e0 * 0.7e0")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    q = read(spark, sf_dir, "supplier").select(s.alias("sid"), ((s * 29 % 103) / 10.0).alias("x"), ((s * 41 % 89) / 10.0).alias("y"))
    return neighbors.radius_join(places(spark, sf_dir), q, ["x", "y"], 0.7, "id", "sid", digits=9)


@query()
def poisson_disk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.min_distance_order(places(spark, sf_dir), ["x", "y"], "id", 4).select("id", "lod")


EDGES = "(SELECT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS dst FROM orders)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for every order, its key folded over all customers."""
    customers = read(spark, sf_dir, "customer").agg(F.count("*").alias("__n"))
    joined = read(spark, sf_dir, "orders").crossJoin(F.broadcast(customers))  # one row
    return joined.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % F.col("__n")).alias("dst"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


@query(f"WITH n AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) SELECT src, dst, a.p AS src_at, b.p AS dst_at FROM {EDGES} e JOIN n a ON src = a.id JOIN n b ON dst = b.id")
def edge_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.remap(edges(spark, sf_dir), nodes(spark, sf_dir)).select("src", "dst", "src_at", "dst_at")


@query(f"WITH e AS (SELECT * FROM {EDGES}), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS n FROM e GROUP BY 1) SELECT c_custkey AS id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM customer LEFT JOIN o ON src = c_custkey LEFT JOIN i ON dst = c_custkey")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"SELECT src, count(*) AS children FROM {EDGES} GROUP BY src HAVING count(*) >= 2")
def division_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.divisions(edges(spark, sf_dir))


@query(f"SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {EDGES} WHERE src <> dst")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected(edges(spark, sf_dir), "src", "dst")


_COMPONENTS = f"""RECURSIVE e AS (SELECT src AS a, dst AS b FROM {EDGES} WHERE dst IN (SELECT c_custkey FROM customer) UNION SELECT dst, src FROM {EDGES} WHERE dst IN (SELECT c_custkey FROM customer)),
    r AS (SELECT c_custkey AS id, c_custkey AS root FROM customer UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
    m AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""


@query(f"WITH {_COMPONENTS} SELECT id, root, dense_rank() OVER (ORDER BY root) - 1 AS lineage FROM m")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(nodes(spark, sf_dir), graph.present(edges(spark, sf_dir), nodes(spark, sf_dir)))


@query(f"WITH {_COMPONENTS}, t AS (SELECT root FROM m GROUP BY root ORDER BY count(*) DESC, root LIMIT 1) SELECT src, dst FROM {EDGES} WHERE src IN (SELECT id FROM m, t WHERE m.root = t.root) AND dst IN (SELECT id FROM m, t WHERE m.root = t.root)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_component(nodes(spark, sf_dir), graph.present(edges(spark, sf_dir), nodes(spark, sf_dir)))[1]


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(nodes(spark, sf_dir), graph.present(edges(spark, sf_dir), nodes(spark, sf_dir)), a="src", b="dst")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_groups(read(spark, sf_dir, "customer"), "c_mktsegment", 3)


_TREE = """(SELECT 'w' AS path, NULL AS parent, 'w' AS name, 'scene' AS type, NULL AS unit UNION ALL SELECT 'w/' || r_regionkey, 'w', r_name, 'group', CASE WHEN r_regionkey % 2 = 0 THEN 'um' END FROM region
    UNION ALL SELECT 'w/' || n_regionkey || '/' || n_nationkey, 'w/' || n_regionkey, n_name, 'points', CASE WHEN n_nationkey % 7 = 0 THEN 'nm' END FROM nation UNION ALL SELECT 'w/empty', 'w', 'EMPTY', 'group', NULL)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    top = spark.range(1).select(F.lit("w").alias("path"), null.alias("parent"), F.lit("w").alias("name"), F.lit("scene").alias("type"), null.alias("unit"))
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("w/"), "r_regionkey").alias("path"), F.lit("w").alias("parent"), F.col("r_name").alias("name"), F.lit("group").alias("type"), F.when(F.col("r_regionkey") % 2 == 0, "um").alias("unit"))
    empty = spark.range(1).select(F.lit("w/empty").alias("path"), F.lit("w").alias("parent"), F.lit("EMPTY").alias("name"), F.lit("group").alias("type"), null.alias("unit"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("w/"), "n_regionkey", F.lit("/"), "n_nationkey").alias("path"), F.concat(F.lit("w/"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit("points").alias("type"), F.when(F.col("n_nationkey") % 7 == 0, "nm").alias("unit"))
    return top.unionByName(r).unionByName(n).unionByName(empty)


_UP = f"RECURSIVE up AS (SELECT path, path AS ancestor, 0 AS distance FROM {_TREE} UNION ALL SELECT up.path, t.parent, distance + 1 FROM up JOIN {_TREE} t ON up.ancestor = t.path WHERE t.parent IS NOT NULL)"


@query(f"WITH {_UP} SELECT path, ancestor, distance FROM up")
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(tree(spark, sf_dir))


@query(f"WITH {_UP} SELECT path, (SELECT arg_min(unit, distance) FROM up JOIN {_TREE} u ON up.ancestor = u.path WHERE up.path = t.path AND unit IS NOT NULL) AS unit FROM {_TREE} t")
def inherited_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inherited(tree(spark, sf_dir), "unit")


@query(f"SELECT path FROM {_TREE} t WHERE type <> 'group' OR EXISTS (SELECT 1 FROM {_TREE} c WHERE c.parent = t.path)")
def prune_empty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.prune_empty_groups(tree(spark, sf_dir)).select("path")


@query(
    f"""WITH {_UP}, b AS (SELECT 'w/' || n_regionkey || '/' || n_nationkey AS path, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT ancestor AS path, min(lo) AS lo_bal, max(hi) AS hi_bal FROM b JOIN up USING (path) GROUP BY 1"""
)
def bounds_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    b = c.groupBy(F.concat(F.lit("w/"), "n_regionkey", F.lit("/"), "n_nationkey").alias("path")).agg(F.min("c_acctbal").alias("lo_bal"), F.max("c_acctbal").alias("hi_bal"))
    return graph.roll_up_bounds(tree(spark, sf_dir), b, ["bal"])


@query(
    f"""WITH t AS (SELECT * FROM {_TREE}),
    l AS (SELECT path, parent, name, sha256(coalesce(unit, '') || '|') AS hash FROM t WHERE path NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)),
    g AS (SELECT path, parent, name, sha256(coalesce(unit, '') || '|' || (SELECT string_agg(l.name || ':' || l.hash, ',' ORDER BY l.name, l.hash) FROM l WHERE l.parent = t.path)) AS hash FROM t WHERE path IN (SELECT parent FROM l) AND path <> 'w'),
    a AS (SELECT * FROM l UNION ALL SELECT * FROM g)
    SELECT path, hash FROM a UNION ALL SELECT 'w', sha256('|' || (SELECT string_agg(name || ':' || hash, ',' ORDER BY name, hash) FROM a WHERE parent = 'w'))"""
)
def merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merkle(tree(spark, sf_dir), "unit")


@query("SELECT type, count(*) AS n FROM (SELECT 'scene' AS type UNION ALL SELECT 'group' FROM region UNION ALL SELECT 'group' UNION ALL SELECT 'points' FROM nation) GROUP BY 1")
def node_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.latest(read(spark, sf_dir, "events"), "user_id", "ts", ["event_id"]).select("user_id", "event_id")
