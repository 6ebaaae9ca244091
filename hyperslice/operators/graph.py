"""Graphs as node and edge DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import held, join_hot, ranked, unsent


def remap(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "id") -> DataFrame:
    """Edges with the dense positions of their ends; edges that name an absent node go. Of nodes with one id the last position counts."""
    at = ranked(nodes.select(node).distinct(), [F.col(node)], "__p").select(F.col(node), (F.col("__p") - 1).alias("__p"))
    a = at.select(F.col(node).alias(src), F.col("__p").alias(f"{src}_at"))
    b = at.select(F.col(node).alias(dst), F.col("__p").alias(f"{dst}_at"))
    return edges.join(unsent(a), src).join(unsent(b), dst)


def present(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node: str = "id") -> DataFrame:
    """Edges whose ends both exist."""
    ids = unsent(nodes.select(node).distinct())
    return edges.join(ids, edges[src] == ids[node], "left_semi").join(ids, edges[dst] == ids[node], "left_semi")


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs without loops, the lesser end first."""
    return edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, out_degree, in_degree), 0 without edges; one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(src).alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy(F.col("e.n").alias("__n")).agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"))
    return nodes.select(node).join(unsent(counts), nodes[node] == counts["__n"], "left").select(node, F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def divisions(edges: DataFrame, src: str = "src") -> DataFrame:
    """Nodes with two or more successors."""
    return edges.groupBy(src).agg(F.count("*").alias("children")).filter("children >= 2")


def adjacency(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every edge once, weight 1."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b")))
    return both.groupBy("a", "b").agg(F.least(F.count("*"), F.lit(1)).alias("weight"))


#: Edges up to which one task finishes the components: 16 MB.
ONE_TASK = 1 << 20


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of the edges that isn't its component's least, and the least; all edges in one task."""
    pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    if not pairs:
        return
    ids, ends = np.unique(np.concatenate(pairs), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"])


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root, lineage): least node of the component, and components numbered from 0 by it. Star contractions, a checkpoint a round; hubs are joined apart, so they are no hot keys. Integer nodes of up to ``ONE_TASK`` edges are finished by one task, with the same result."""
    now = held(edges.filter(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    one_task = dict(nodes.dtypes)[node] in ("smallint", "int", "bigint") and now.count() <= ONE_TASK
    if one_task:
        now = held(now.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).repartition(1).mapInArrow(_rooted, "u bigint, v bigint"))
    state = None
    while not one_task and (found := now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != state and found[0]:
        state = found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = held(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")).select("u", F.least("u", "m").alias("m"), "__n"))
        large = held(join_hot(both.filter("v > u"), least, "u", 2 * found[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = held(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")))
        small = join_hot(large, least, "u", found[0]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = held(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
    rooted = nodes.select(node).distinct().join(unsent(now), nodes[node] == now["u"], "left").select(node, F.coalesce("v", node).alias("root"))
    numbers = ranked(rooted.select("root").distinct(), [F.col("root")], "__l").select("root", (F.col("__l") - 1).alias("lineage"))
    return rooted.join(unsent(numbers), "root").select(node, "root", "lineage")


def largest_component(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the component with the most nodes, ties by the least node."""
    found = held(components(nodes, edges, node, src, dst))
    top = found.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)
    inside = unsent(found.join(F.broadcast(top), "root", "left_semi").select(node))  # top is one row
    return nodes.join(inside, node, "left_semi"), edges.join(inside, edges[src] == inside[node], "left_semi").join(inside, edges[dst] == inside[node], "left_semi")


def communities(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b", rounds: int = 5) -> DataFrame:
    """(node, community) by label propagation: in each round a node takes the commonest label among its neighbours and itself, ties by the least.

    A distributed substitute for modularity optimisation, which is sequential: results
    are deterministic but not those of another algorithm. Communities are numbered by falling size.
    """
    links = held(adjacency(edges, a, b))
    labels = nodes.select(F.col(node).alias("n"), F.col(node).alias("label")).distinct()
    for _ in range(rounds):
        votes = links.join(unsent(labels), links["b"] == labels["n"]).select(F.col("a").alias("n"), "label").unionByName(labels)
        counted = votes.groupBy("n", "label").agg(F.count("*").alias("c"))
        labels = held(counted.groupBy("n").agg(F.min(F.struct((-F.col("c")).alias("c"), "label")).alias("best")).select("n", F.col("best.label").alias("label")))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    number = ranked(sizes, [F.desc("size"), F.col("label")], "__r").select("label", (F.col("__r") - 1).alias("community"), "size")
    return labels.join(unsent(number), "label").select(F.col("n").alias(node), "community", "size")


def top_groups(df: DataFrame, group: str, n: int = 20) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(n)


def node_list_hash(nodes: DataFrame, node: str) -> DataFrame:
    """One row: the first 16 hex digits of the SHA-256 of the sorted names, a line each.

    One digest over all names is sequential by definition: sorted partitions stream through
    it one after another, so only one is in memory at a time.
    """
    digest, first = hashlib.sha256(), True
    for r in nodes.select(F.col(node).cast("string").alias("n")).orderBy("n").toLocalIterator():
        digest.update(("" if first else "\n").encode() + (r["n"] or "").encode())
        first = False
    return nodes.sparkSession.range(1).select(F.lit(digest.hexdigest()[:16]).alias("hash"))


def ancestors(tree: DataFrame, node: str = "path", parent: str = "parent") -> DataFrame:
    """(node, ancestor, distance), each node its own at distance 0; joins double the reach until they add nothing, so log(depth) rounds. A cycle raises."""
    found, reach = held(tree.filter(F.col(parent).isNotNull()).select(F.col(node).alias("n"), F.col(parent).alias("a"), F.lit(1).alias("d"))), 1
    while True:
        if not found.filter("n = a").isEmpty():
            raise ValueError("a node is its own ancestor")
        far = found.filter(F.col("d") == reach).select(F.col("n").alias("xn"), F.col("a").alias("xa"), F.col("d").alias("xd"))
        more = found.select(F.col("n").alias("yn"), F.col("a").alias("ya"), F.col("d").alias("yd"))
        step = held(far.join(more, F.col("xa") == F.col("yn")).select(F.col("xn").alias("n"), F.col("ya").alias("a"), (F.col("xd") + F.col("yd")).alias("d")))
        if step.isEmpty():
            break
        found = held(found.unionByName(step))
        reach *= 2
    own = tree.select(F.col(node).alias("n"), F.col(node).alias("a"), F.lit(0).alias("d"))
    return own.unionByName(found).select(F.col("n").alias(node), F.col("a").alias("ancestor"), F.col("d").alias("distance"))


def inherited(tree: DataFrame, attribute: str, node: str = "path", parent: str = "parent") -> DataFrame:
    """(node, attribute): the value of the nearest ancestor (itself first) that has one."""
    up = ancestors(tree, node, parent)
    values = tree.filter(F.col(attribute).isNotNull()).select(F.col(node).alias("ancestor"), F.col(attribute).alias("v"))
    near = up.join(values, "ancestor").groupBy(node).agg(F.min_by("v", "distance").alias(attribute))
    return tree.select(node).join(near, node, "left")


def prune_empty_groups(tree: DataFrame, kind: str = "type", node: str = "path", parent: str = "parent") -> DataFrame:
    """Nodes without the groups that hold no leaf."""
    up = ancestors(tree, node, parent)
    leaves = tree.filter(~F.col(kind).isin("group", "scene")).select(node)
    used = up.join(leaves, node, "left_semi").select(F.col("ancestor").alias(node)).distinct()
    return tree.join(used, node, "left_semi").unionByName(tree.filter(F.col(kind) == "scene").join(used, node, "left_anti"))


def roll_up_bounds(tree: DataFrame, bounds: DataFrame, axes: list[str], node: str = "path", parent: str = "parent") -> DataFrame:
    """(node, lo_*, hi_*) of every node from the bounds of the leaves below it."""
    up = ancestors(tree, node, parent)
    joined = bounds.join(up, node)
    return joined.groupBy(F.col("ancestor").alias(node)).agg(*[f(f"{p}_{a}").alias(f"{p}_{a}") for a in axes for f, p in ((F.min, "lo"), (F.max, "hi"))])


def merkle(tree: DataFrame, content: str, node: str = "path", parent: str = "parent", name: str = "name") -> DataFrame:
    """(node, hash): digest of a node's content and of its children's names and hashes, level by level from the deepest."""
    depth = ancestors(tree, node, parent).groupBy(node).agg(F.max("distance").alias("depth"))
    levelled = held(tree.join(depth, node))
    deepest = levelled.agg(F.max("depth")).first()[0]
    done = None
    for d in range(deepest if deepest is not None else -1, -1, -1):
        here = levelled.filter(F.col("depth") == d)
        if done is None:
            made = here.withColumn("kids", F.lit(""))
        else:
            pair = F.struct(F.col(name).alias("n"), F.col("hash").alias("h"))
            kids = done.filter(F.col("depth") == d + 1).groupBy(F.col(parent).alias("__p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda k: F.concat_ws(":", k["n"], k["h"])), ",").alias("kids"))
            made = here.join(kids, here[node] == kids["__p"], "left").drop("__p").withColumn("kids", F.coalesce("kids", F.lit("")))
        made = made.withColumn("hash", F.sha2(F.concat_ws("|", F.coalesce(F.col(content).cast("string"), F.lit("")), "kids"), 256)).select(node, parent, name, "depth", "hash")
        done = held(made if done is None else done.unionByName(made))
    return done.select(node, "hash") if done is not None else tree.select(node, F.lit("").alias("hash"))


def latest(requests: DataFrame, by: str, at: str, ties: Sequence[str] = ()) -> DataFrame:
    """The newest row for each key; of equally new ones that of the greatest ``ties``. Combines before the shuffle."""
    whole = F.struct(*[F.col(c) for c in requests.columns])
    return requests.groupBy(F.col(by).alias("__by")).agg(F.max_by(whole, F.struct(at, *ties)).alias("r")).select("r.*")


#: Kinds of nodes that a group of levels or of parts can hold.
LEVELLED = ("points", "splats", "lines", "mesh")


def require_levelled(kind: str) -> None:
    if kind not in LEVELLED:
        raise ValueError(f"{kind!r} has no levels of detail: one of {LEVELLED} does")


def lod_group(spark: SparkSession, path: str, parent: str | None, kind: str, levels: int, default_level: int = 0, selector: str = "screen_size") -> DataFrame:
    """Node rows (path, parent, name, type, kind, attributes) of a group of levels: the wrapper and a child for each level."""
    require_levelled(kind)
    if not 0 <= default_level < levels:
        raise ValueError(f"default level {default_level} of {levels}")
    return _group(spark, path, parent, "lod", kind, [f"level{i}" for i in range(levels)], {"selector": selector, "default_level": str(default_level)})


def partition_group(spark: SparkSession, path: str, parent: str | None, kind: str, parts: int, max_elements: int) -> DataFrame:
    """Node rows of a group of parts of at most ``max_elements``: the wrapper and a child for each part."""
    require_levelled(kind)
    if parts < 1 or max_elements < 1:
        raise ValueError("a partition has a part and a limit")
    return _group(spark, path, parent, "partition", kind, [f"part{i}" for i in range(parts)], {"display_type": kind, "max_elements": str(max_elements)})


def _group(spark: SparkSession, path: str, parent: str | None, group: str, kind: str, children: list[str], attributes: dict[str, str]) -> DataFrame:
    rows = [(path, parent, path.rsplit("/", 1)[-1], "group", group, attributes)] + [(f"{path}/{c}", path, c, kind, None, {}) for c in children]
    return spark.createDataFrame(rows, "path string, parent string, name string, type string, kind string, attributes map<string,string>")


def roll_up_types(tree: DataFrame, node: str = "path", parent: str = "parent", type_: str = "type") -> DataFrame:
    """(node, display_type): the one type of the leaves below each group, null where they differ or there are none."""
    up = ancestors(tree, node, parent).filter("distance > 0")
    leaves = tree.filter(~F.col(type_).isin("group", "scene")).select(node, type_)
    below = up.join(leaves, node).groupBy(F.col("ancestor").alias(node)).agg(F.min(type_).alias("a"), F.max(type_).alias("z"))
    groups = tree.filter(F.col(type_).isin("group", "scene")).select(node)
    return groups.join(below, node, "left").select(node, F.when(F.col("a") == F.col("z"), F.col("a")).alias("display_type"))


def modularity(labels: DataFrame, links: DataFrame) -> float:
    """Of communities (n, c) on symmetric links (a, b, w), each direction a row; 0 without links."""
    ends = links.join(labels.select(F.col("n").alias("a"), F.col("c").alias("ca")), "a").join(labels.select(F.col("n").alias("b"), F.col("c").alias("cb")), "b")
    sums = ends.groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    row = sums.agg(F.sum("tot").alias("m2"), F.sum("inside").alias("i"), F.sum(F.col("tot") * F.col("tot")).alias("t2")).first()
    return row["i"] / row["m2"] - row["t2"] / row["m2"] ** 2 if row["m2"] else 0.0


def louvain(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b", least: float = 1e-6) -> DataFrame:
    """(node, community, size) by modularity: nodes move to the neighbouring community of the greatest gain until no round gains, then communities become nodes, and so on.

    In a round all nodes look at the same communities, but only half of them (by hash and
    round) move, which keeps pairs from changing places; a round that doesn't gain
    ``least`` is undone and the other half tried, and two such rounds end a level. The number of rounds follows from the
    gains, which are at least that large, so it ends. Ties go to the least community;
    communities are numbered by falling size. Parallel edges weigh more, loops stay inside.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b")))
    links = held(both.groupBy("a", "b").agg(F.count("*").cast("double").alias("w")))
    own = held(nodes.select(F.col(node).alias("n")).distinct().withColumn("c", F.col("n")))
    total = links.agg(F.sum("w")).first()[0]
    while total:
        level = held(links.select(F.col("a").alias("n")).unionByName(links.select(F.col("b").alias("n"))).distinct().withColumn("c", F.col("n")))
        degree = held(links.groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("k")))
        best, poor, turn, moved = modularity(level, links), 0, 0, False
        while poor < 2:
            sums = level.join(degree, "n").groupBy("c").agg(F.sum("k").alias("tot"))
            to = links.filter("a <> b").join(level.select(F.col("n").alias("b"), "c"), "b").groupBy(F.col("a").alias("n"), "c").agg(F.sum("w").alias("w"))
            at = level.join(degree, "n").withColumnRenamed("c", "c0")
            options = to.join(at, "n").join(sums, "c")
            gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("c0"), F.col("k")).otherwise(0.0)) / total
            chosen = options.withColumn("g", gain).groupBy("n", "c0").agg(F.min(F.struct((-F.col("g")).alias("g"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("c0"), F.col("g"))).alias("stay"))
            alone = sums.withColumnRenamed("c", "c0")
            stay = F.coalesce("stay", -F.col("k") * (F.col("tot") - F.col("k")) / total)
            better = chosen.join(degree, "n").join(alone, "c0").filter(-F.col("best.g") > stay + 1e-12).filter(F.pmod(F.xxhash64("n"), F.lit(2)) == turn % 2)
            tried = held(level.join(better.select("n", F.col("best.c").alias("to")), "n", "left").select("n", F.coalesce("to", "c").alias("c")))
            now = modularity(tried, links)
            turn += 1
            if now > best + least:
                level, best, poor, moved = tried, now, 0, True
            else:
                poor += 1
        if not moved:
            break
        own = held(own.join(level.select(F.col("n").alias("c"), F.col("c").alias("to")), "c", "left").select("n", F.coalesce("to", "c").alias("c")))
        renamed = links.join(level.select(F.col("n").alias("a"), F.col("c").alias("ca")), "a").join(level.select(F.col("n").alias("b"), F.col("c").alias("cb")), "b")
        links = held(renamed.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    sizes = own.groupBy("c").agg(F.count("*").alias("size"))
    number = ranked(sizes, [F.desc("size"), F.col("c")], "__r").select("c", (F.col("__r") - 1).alias("community"), "size")
    return own.join(number, "c").select(F.col("n").alias(node), "community", "size")
