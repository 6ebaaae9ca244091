"""Steps that grew faster than their input: many rows at one place, many equal splats, wide tables sent around."""

import math
import random
import statistics
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from hyperslice.operators import full, graph, mixture, neighbors, ordering, raster


def exact_merge(rows, target):
    """(x, y), var, mass of rows merged two by two in fractions, from the definition."""
    rows = [[[Fraction(v) for v in r[:2]], [Fraction(v) ** 2 for v in r[2:4]], Fraction(r[2]) * Fraction(r[3]) * Fraction(r[4])] for r in sorted(rows)]
    while len(rows) > target:
        pairs = ((sum((x - y) ** 2 for x, y in zip(a[0], b[0], strict=True)) * (a[2] * b[2] / (a[2] + b[2]) if a[2] + b[2] else 0), i, j) for i, a in enumerate(rows) for j, b in enumerate(rows[:0] + rows[i + 1 :], i + 1))
        _, i, j = min(pairs)
        (m, v, a), (n, u, b) = rows[i], rows[j]
        w = a / (a + b) if a + b else Fraction(1, 2)
        mean = [w * x + (1 - w) * y for x, y in zip(m, n, strict=True)]
        rows[i] = [mean, [w * (s + x * x) + (1 - w) * (t + y * y) - z * z for s, x, t, y, z in zip(v, m, u, n, mean, strict=True)], a + b]
        del rows[j]
    return rows


@pytest.mark.parametrize("share", [0.7, 0.25, 0.1])
def test_rows_of_one_center_merge_first_and_exactly(spark, share):
    """One tile merges centers in part, one needs further merges, one has a row without mass."""
    rng = random.Random(3)
    tiles = {0: [(rng.choice([1.1, 2.3, 3.7]), rng.choice([0.1, 5.3])) for _ in range(26)], 1: [(20 + rng.random() * 9, 3.3) for _ in range(12)] + [(25.7, 7.7)] * 4, 2: [(41.3, 1.7)] * 5 + [(44.1, 2.9)] * 3}
    rows = {t: [(x, y, rng.uniform(0.5, 1.5), rng.uniform(0.5, 1.5), 0.0 if t == 2 and i == 4 else rng.uniform(1, 90)) for i, (x, y) in enumerate(at)] for t, at in tiles.items()}
    names = ["x", "y", "sx", "sy", "amp"]
    df = spark.createDataFrame([r for of in rows.values() for r in of], names)
    found = defaultdict(list)
    for r in mixture.greedy_merge(df, names[:2], names[2:4], "amp", 20.0, share).collect():
        found[int(r.x // 20)].append(tuple(r))
    for t, of in rows.items():
        expected = sorted((*map(float, m), *(math.sqrt(s) for s in v), float(w / 1) / math.sqrt(v[0] * v[1])) for m, v, w in exact_merge(of, max(1, round(share * len(of)))))
        assert len(found[t]) == len(expected)
        for a, b in zip(sorted(found[t]), expected, strict=True):
            assert a == pytest.approx(b, rel=1e-9)


def most_rows(df, kind=""):
    """The most rows that a node of the executed plan (of a ``kind``) has put out."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            metric = node.metrics().get("numOutputRows")
            if name.startswith(kind) and metric.isDefined():
                most = max(most, metric.get().value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return most


def test_equal_splats_are_one(spark):
    """8,000 rows of eight splats: 64 pairs, not 64 million."""
    k = F.col("id")
    df = spark.range(8000).select((k % 4).cast("double").alias("x"), (k % 2).cast("double").alias("y"), (0.5 + (k % 8) / 8).alias("sx"), F.lit(0.75).alias("sy"), (1.0 + k % 3).alias("amp"))
    rows = df.groupBy("x", "y", "sx", "sy").agg(F.sum("amp").alias("amp")).collect()

    def kernel(a, b):
        out = a.amp * b.amp
        for g, s, t in ((a.x - b.x, a.sx, b.sx), (a.y - b.y, a.sy, b.sy)):
            out *= math.sqrt(2 * math.pi * s * s * t * t / (s * s + t * t)) * math.exp(-g * g / (s * s + t * t) / 2)
        return out

    whole = sum(kernel(a, b) for a in rows for b in rows)
    diagonal = df.select("amp", F.array("x", "y").alias("center"), F.array("sx", F.lit(0.0), "sy").alias("chol"))
    for one in (mixture.inner_product(df, df, ["x", "y"], ["sx", "sy"], "amp"), full.inner_product(diagonal, diagonal, 2)):
        assert one.first()[0] == pytest.approx(whole, rel=1e-12)
        assert 64 <= most_rows(one) <= 8000
    assert mixture.similarity(df, df, ["x", "y"], ["sx", "sy"], "amp").first()[0] == pytest.approx(1.0)


@pytest.fixture
def made(spark, monkeypatch):
    """The most rows that nodes of the tables held by ``neighbors`` have put out."""
    most, hold = [0], neighbors.held

    def held(df):
        most[0] = max(most[0], most_rows(df))
        return hold(df)

    monkeypatch.setattr(neighbors, "held", held)
    return most


def crowded(spark, n):
    """(id, x, y, g): n rows at 24 places of two groups, and four without a coordinate or group."""
    rows = [(i, i * 7 % 12 / 4.0, i % 2 / 8.0, i % 24 // 12) for i in range(n)] + [(n, None, 0.0, 0), (n + 1, 0.0, float("nan"), 0), (n + 2, 0.0, 0.0, None), (n + 3, 90.0, 0.0, 1)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, g int")


def squared(a, b):
    return (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 if None not in (*a, *b) and a[3] == b[3] else math.nan


def test_crowded_places_poisson(spark, made):
    rows, df = crowded(spark, 2400)
    found = {r.id: r.lod for r in neighbors.min_distance_order(df, ["x", "y"], "id", 4).collect()}
    order = [r.id for r in df.select("id", F.xxhash64(F.lit(42), "id").alias("h")).orderBy("h", "id").collect()]
    sound = {r[0]: r[1:3] for r in rows if r[1] is not None and r[2] == r[2]}
    diagonal = math.dist((0.0, 0.0), (90.0, 0.125))
    level, kept = {}, []
    for k in range(3):
        for i in order:
            if i in sound and i not in level and all(math.dist(sound[i], sound[j]) >= diagonal / 2 * 0.5**k for j in kept):
                level[i] = k
                kept.append(i)
    assert found == {r[0]: level.get(r[0], 3) if r[0] in sound else 0 for r in rows}
    assert made[0] <= 4 * len(rows)


def test_spread_places_poisson(spark):
    """Each row its own place, all three axes, far from the origin."""
    rng = random.Random(8)
    rows = [(i, 1e6 + rng.random(), rng.random() - 3, rng.random() * 0.5) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    found = {r.id: r.lod for r in neighbors.min_distance_order(df, ["x", "y", "z"], "id", 3).collect()}
    order = [r.id for r in df.select("id", F.xxhash64(F.lit(42), "id").alias("h")).orderBy("h", "id").collect()]
    at = {r[0]: r[1:] for r in rows}
    diagonal = math.dist([min(c) for c in zip(*at.values(), strict=True)], [max(c) for c in zip(*at.values(), strict=True)])
    level, kept = {}, []
    for k in range(2):
        for i in order:
            if i not in level and all(math.dist(at[i], at[j]) >= diagonal / 2 * 0.5**k for j in kept):
                level[i] = k
                kept.append(i)
    assert found == {i: level.get(i, 2) for i in at}


def test_crowded_places_isolation(spark, made):
    rows, df = crowded(spark, 1200)
    found = {r.id for r in neighbors.isolation_filter(df, ["x", "y"], "id", 0.3, 0.3, ["g"]).collect()}
    assert found == set(range(1200))
    assert made[0] <= 4 * len(rows)


def test_crowded_places_counts(spark):
    rows, df = crowded(spark, 4800)
    seen = df.filter("id % 97 = 0 OR id >= 4800").select("id").collect()
    out = neighbors.neighbor_counts(df, ["x", "y"], 0.3, "id", ["g"])
    found = {r.id: r.neighbors for r in out.collect()}
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in rows}
    for r in seen:
        assert found[r.id] == sum(1 for b in rows if b[0] != r.id and squared(by_id[r.id], b) < 0.09)
    assert most_rows(out) <= len(rows)


def test_crowded_places_nearest(spark, made):
    rows, df = crowded(spark, 1200)
    queries = df.filter("id % 101 = 0 OR id >= 1200")
    wanted = {r.id for r in queries.collect()}
    for alone in (True, False):
        found = defaultdict(list)
        for r in neighbors.nearest(df, queries, ["x", "y"], 3, "id", "id", 0.1, ["g"], exclude_self=alone).collect():
            found[r.query].append((r.rank, r.d2, r.id))
        for a in rows:
            if a[0] in wanted:
                others = sorted((squared(a, b), b[0]) for b in rows if squared(a, b) >= 0 and not (alone and a[0] == b[0]))[:3]
                assert sorted(found[a[0]]) == [(i + 1, *o) for i, o in enumerate(others)]
    far = {r.id: r.distance for r in neighbors.kth_distance(df, ["x", "y"], 3, "id", 0.4, ["g"]).collect()}
    assert len(far) == len(rows) and far[0] == 0.0 and far[1200] == math.inf and far[1203] > 80
    assert made[0] <= 4 * len(rows)


def test_crowded_places_radius(spark):
    """Pairs of places stand for all rows at them, also where a place is dealt to several tasks; d2 is rounded before they are written out."""
    rows, df = crowded(spark, 240)
    queries = df.filter("id % 5 = 0")
    expected = {(a[0], b[0]): round(squared(a, b), 3) for a in rows if a[0] % 5 == 0 for b in rows if squared(a, b) < 0.09}
    for split in (3, None, 50_000):
        found = neighbors.radius_join(df, queries, ["x", "y"], 0.3, "id", "id", ["g"], split, digits=3).collect()
        assert len(found) == len(expected) and {(r.query, r.id): r.d2 for r in found} == pytest.approx(expected)
    at = neighbors.places(df, ["x", "y"], ["g"])
    assert at.count() == 26 and most_rows(neighbors.near_places(at, at, ["x", "y"], 0.3, ["g"])) <= 26 * 9


@pytest.fixture
def sent(monkeypatch):
    """The most rows broadcast by the tables that ``graph`` holds."""
    most, hold = [0], graph.held

    def held(df):
        most[0] = max(most[0], most_rows(df, "BroadcastExchange"))
        return hold(df)

    monkeypatch.setattr(graph, "held", held)
    return most


@pytest.mark.parametrize("one_task", [1 << 20, -1])
def test_components_broadcast_no_table(spark, sent, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    nodes = spark.range(6000)
    edges = spark.range(9000).select((F.col("id") % 5000).alias("src"), (F.col("id") * 7 % 5000).alias("dst"))
    kept = graph.present(edges, nodes)
    found = graph.components(nodes, kept)
    parent = list(range(6000))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in edges.collect():
        a, b = sorted((root(r.src), root(r.dst)))
        parent[b] = a
    assert {r.id: r.root for r in found.collect()} == {i: root(i) for i in range(6000)}
    assert max(most_rows(df, "BroadcastExchange") for df in (kept, found)) <= 100 and sent[0] <= 1000


def test_largest_component_broadcasts_no_table(spark, sent):
    nodes = spark.range(6000)
    edges = spark.range(5000).select("id", (F.col("id") + 1).alias("dst")).withColumnRenamed("id", "src")
    inside, links = graph.largest_component(nodes, graph.present(edges, nodes))
    assert inside.count() == 5001 and links.count() == 5000
    assert max(most_rows(df, "BroadcastExchange") for df in (inside, links)) <= 100 and sent[0] <= 1000


def test_degrees_and_communities_broadcast_no_table(spark, sent):
    nodes = spark.range(3000)
    edges = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") - F.col("id") % 3).alias("dst"))
    for df in (graph.degrees(nodes, edges), graph.remap(edges, nodes), graph.communities(nodes, edges, a="src", b="dst")):
        assert df.count() == 3000 and most_rows(df, "BroadcastExchange") <= 100
    assert sent[0] <= 1000


def test_percentiles_evaluate_their_values_once(spark):
    """Three percentiles take several scans: of the values as held, not of what they come from."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rng = random.Random(6)
    cells = [(a, b, rng.gauss(100, 5)) for a in range(20) for b in range(30)]
    volume = spark.createDataFrame(cells, "a int, b int, value double").mapInArrow(count, "a int, b int, value double")
    found = raster.noise_floor(volume, ["a", "b"])
    assert seen.value == len(cells)
    at = {(a, b): v for a, b, v in cells}
    gaps = [abs(at[a, b + 1] - v) for (a, b), v in at.items() if (a, b + 1) in at]
    assert found["difference"] == pytest.approx(statistics.median(gaps) / (0.6744897501960817 * 2**0.5))
    seen.value = 0
    assert ordering.quantiles(volume, [(F.col("value"), 0.5), (-F.col("value"), 0.0)]) == pytest.approx([statistics.median(at.values()), -max(at.values())])
    assert seen.value == len(cells)
