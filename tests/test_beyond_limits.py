"""Operators beyond what was once a limit, and against plain Python."""

import hashlib
import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperslice.functions import codecs, curves
from hyperslice.operators import chunks, graph, infer, lod, mixture, neighbors, ordering, raster
from hyperslice.plans import partition
from hyperslice.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=3000), rng.integers(0, 5, 1000).astype(float), np.append(rng.lognormal(0, 8, 500), [-1e300, 1e300, 0, -0.0]), np.array([7.0]), np.repeat(2.5, 40)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 3, "v double")
        shares = [0.0, 0.1, 0.5, 0.999, 1.0]
        found = ordering.quantiles(df, [(F.col("v"), q) for q in shares])
        ordered = np.sort(values)
        for q, got in zip(shares, found, strict=True):
            at = (len(values) - 1) * q
            a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert got == (a if math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    nothing = df.filter("false")
    assert ordering.quantiles(nothing, [(F.col("v"), 0.5)]) == [None] and ordering.quantiles(df, []) == []
    odd = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    assert ordering.quantiles(odd, [(F.col("v"), 0.0)]) == [1.0] and math.isnan(ordering.quantiles(odd, [(F.col("v"), 1.0)])[0])


def test_few_bins_find_the_same_rank(spark):
    values = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert ordering.order_statistics(df, [(F.col("v"), r) for r in (0, 77, 499)], bins=4) == np.sort(values)[[0, 77, 499]].tolist()


def test_ranges_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    starts = rng.integers(0, 3000, 300)
    ranges = [(int(a), int(a + n)) for a, n in zip(starts, rng.integers(1, 12, 300), strict=True)] + [(0, 500), (10, 20)]
    merged: list = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    df = spark.createDataFrame(ranges, "start long, stop long").repartition(7)
    assert sorted((r.start, r.stop) for r in chunks.merge_ranges(df).collect()) == [tuple(m) for m in merged]
    by = df.withColumn("g", F.lit(1))
    assert sorted((r.start, r.stop) for r in chunks.merge_ranges(by, "g").collect()) == [tuple(m) for m in merged]


def test_deep_trees_and_cycles(spark):
    chain = spark.range(150).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    found = graph.ancestors(chain)
    assert found.count() == 150 * 151 // 2 and found.agg(F.max("distance")).first()[0] == 149
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "path string, parent string"))


def test_node_list_hash(spark):
    names = ["b", "a", "é", "Z", "a1"]
    found = graph.node_list_hash(spark.createDataFrame([(n,) for n in names], "n string").repartition(3), "n").first().hash
    assert found == hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:16]


def test_newest_of_equal_times(spark):
    rows = spark.createDataFrame([(1, 5, 1), (1, 5, 3), (1, 4, 9), (2, None, 7)], "k int, at int, id int")
    assert {(r.k, r.id) for r in graph.latest(rows, "k", "at", ["id"]).collect()} == {(1, 3), (2, 7)}


def test_components_of_hubs_in_both_ways(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 400)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    nodes = spark.range(600).select("id")
    df = spark.createDataFrame(edges, "src long, dst long")
    expected = {i: 0 if i < 400 else 500 if 500 <= i <= 540 else i for i in range(600)}
    for most in (1 << 20, -1):
        monkeypatch.setattr(graph, "ONE_TASK", most)
        assert {r.id: r.root for r in graph.components(nodes, df).collect()} == expected


def test_nearest_is_found_however_far(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 1e6), (3, -4e5)], "id long, x double")
    queries = spark.createDataFrame([(10, 9e5), (11, 0.3), (12, float("nan")), (13, None)], "q long, x double")
    found = {(r.query, r.rank): r.id for r in neighbors.nearest(points, queries, ["x"], 2, "id", "q", 1e-3).collect()}
    assert found == {(10, 1): 2, (10, 2): 1, (11, 1): 1, (11, 2): 3}


def test_dense_cells_are_split(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(x), i % 2) for i, x in enumerate(np.append(rng.random(300) * 0.01, rng.random(40) * 10))]
    df = spark.createDataFrame(rows, "id long, x double, g int")
    expected = {(a, b) for a, x, g in rows for b, y, h in rows if g == h and (x - y) ** 2 < 0.25}
    for split in (20, None, 50_000):
        found = neighbors.radius_join(df, df, ["x"], 0.5, "id", "id", ["g"], split).collect()
        assert {(r.query, r.id) for r in found} == expected and len(found) == len(expected)


def test_dictionaries_of_both_sizes(spark, monkeypatch):
    rows = [("often",)] * 500 + [(f"w{i:03d}",) for i in range(300)] + [(None,)] * 20
    df = spark.createDataFrame(rows, "v string")
    order = [None, *sorted({v for (v,) in rows if v})]
    for most in (200_000, -1):
        monkeypatch.setattr(ordering, "BROADCAST_ROWS", most)
        coded, lut = codecs.dictionary_encode(df, "v")
        found = coded.collect()
        assert len(found) == len(rows) and all(order[r.code] == r.v for r in found) and lut.count() == len(order)


def test_poisson_levels_equal_one_greedy_pass(spark):
    rng = np.random.default_rng(4)
    points = [(i, *map(float, p)) for i, p in enumerate(rng.random((60, 2)))]
    df = spark.createDataFrame(points, "id long, x double, y double")
    found = {r.id: r.lod for r in neighbors.min_distance_order(df, ["x", "y"], "id", 4).collect()}
    order = [r.id for r in df.select("id", F.xxhash64(F.lit(42), "id").alias("h")).orderBy("h", "id").collect()]
    at = {i: np.array([x, y]) for i, x, y in points}
    box = np.array(list(at.values()))
    diagonal = np.linalg.norm(box.max(0) - box.min(0))
    level, kept = {}, []
    for k in range(3):
        for i in order:
            if i not in level and all(np.linalg.norm(at[i] - at[j]) >= diagonal / 2 * 0.5**k for j in kept):
                level[i] = k
                kept.append(i)
    assert found == {i: level.get(i, 3) for i, _, _ in points}


def test_steps_equal_brute_force(spark):
    rows = [("a", 3.0 + 6 * v) for v in (0, 4, 10, 7)] + [("b", 5.0)] + [("c", 1.5), ("c", 2.0)] + [("d", float(v)) for v in (10, 4, 4, 22)] + [("e", float(1 << 25)), ("e", 1.0)]
    found = {r.g: r.step for r in infer.discrete_step(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    assert found == {"a": 6.0, "b": 1.0, "c": 1.0, "d": 6.0, "e": 1.0}
    assert infer.discrete_step(spark.createDataFrame([(float(v),) for v in (9, 3, 21)], "x double"), "x").first().step == 6.0


def test_grid_is_coarsened_not_refused(spark):
    df = spark.range(4000).select((F.col("id") % 64).cast("double").alias("x"), F.floor(F.col("id") / 64).cast("double").alias("y"))
    cells, weights, cell = partition.content_grid(df, ["x", "y"], 1.0, most=100)
    assert len(cells) <= 100 and cell == 8.0 and weights.sum() == 4000
    boxes = partition.plan(cells, weights, cell, target=500)
    found = partition.assign(df, boxes, ["x", "y"]).groupBy("part").agg(F.count("*").alias("n")).collect()
    assert {r.part: float(r.n) for r in found} == {i: b.weight for i, b in enumerate(boxes)} and all(b.weight <= 500 for b in boxes)


def test_narrow_cells_are_refused(spark):
    s = spark.createDataFrame([(1.0, 0.0, 0.5), (2.0, 3.0, 1.0)], "amp double, x double, sx double")
    with pytest.raises(ValueError):
        mixture.inner_product(s, s, ["x"], ["sx"], "amp", 1.0)
    found = mixture.inner_product(s, s, ["x"], ["sx"], "amp").first().inner
    rows = [(1.0, 0.0, 0.5), (2.0, 3.0, 1.0)]
    whole = sum(a * b * math.sqrt(2 * math.pi * s * s * t * t / (s * s + t * t)) * math.exp(-((x - y) ** 2) / (s * s + t * t) / 2) for a, x, s in rows for b, y, t in rows)
    assert found == pytest.approx(whole, rel=1e-12)


def naive_merge(mu, var, mass, target):
    rows = [(m.copy(), v.copy(), w) for m, v, w in zip(mu, var, mass, strict=True)]
    while len(rows) > target:
        cost = [(((rows[i][0] - rows[j][0]) ** 2).sum() * rows[i][2] * rows[j][2] / (rows[i][2] + rows[j][2]), i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))]
        _, i, j = min(cost)
        (m, v, a), (n, u, b) = rows[i], rows[j]
        mean = (a * m + b * n) / (a + b)
        rows[i] = (mean, (a * (v + m**2) + b * (u + n**2)) / (a + b) - mean**2, a + b)
        del rows[j]
    return rows


def test_greedy_merging_equals_the_plain_one():
    rng = np.random.default_rng(5)
    for n, target in ((2, 1), (25, 6), (40, 39), (30, 1)):
        mu, var, mass = rng.random((n, 2)), rng.random((n, 2)) + 0.1, rng.random(n) + 0.1
        got = mixture.agglomerated(mu, var, mass, target)
        expected = naive_merge(mu, var, mass, target)
        for a, b in zip(zip(*got, strict=True), expected, strict=True):
            assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) and a[2] == pytest.approx(b[2])


def hilbert(x, y, bits):
    """The index along the plane's curve by quadrants, from the definition."""
    d, s = 0, 1 << (bits - 1)
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = (1 << bits) - 1 - x, (1 << bits) - 1 - y
            x, y = y, x
        s >>= 1
    return d


def test_hilbert_codes_fill_the_square_step_by_step(spark):
    cells = spark.range(4096).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    rows = cells.select("x", "y", curves.hilbert([F.col("x"), F.col("y")], 6).alias("code")).collect()
    order = sorted((r.code, r.x, r.y) for r in rows)
    assert [c for c, _, _ in order] == list(range(4096))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(order, order[1:], strict=False))
    plain = {(r.x, r.y): hilbert(r.x, r.y, 6) for r in rows}
    assert all(plain[r.x, r.y] == r.code for r in rows) or all(plain[r.y, r.x] == r.code for r in rows)


def test_streamlines_equal_numpy(spark):
    rows = {r.s_suppkey: (r.x, r.y) for r in QUERIES["streamline_step"](spark, SF).collect()}

    def flow(p):
        u = w = 0.0
        fx, fy = math.floor(p[0]), math.floor(p[1])
        for dx in (0, 1):
            for dy in (0, 1):
                x, y = fx + dx, fy + dy
                share = (p[0] - fx if dx else 1 - p[0] + fx) * (p[1] - fy if dy else 1 - p[1] + fy)
                if 0 <= x < 10 and 0 <= y < 10:
                    u, w = u + share, w + share * ((10 * x + y) % 3)
        n = math.hypot(u, w)
        return np.array([u, w]) / n if n else np.zeros(2)

    for k, found in rows.items():
        p = np.array([k % 8 + 0.5, k % 7 + 0.5])
        a = flow(p)
        b = flow(p + 0.125 * a)
        c = flow(p + 0.125 * b)
        d = flow(p + 0.25 * c)
        assert found == pytest.approx(tuple(p + 0.25 / 6 * (a + 2 * b + 2 * c + d)))


def test_weighted_sample_takes_the_greatest_keys(spark):
    volume = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("value"))
    found = {r.id for r in raster.sample_by_intensity(volume, 40, ["id"]).collect()}
    u = {r.id: r.u for r in volume.select("id", ((F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).collect()}
    assert found == set(heapq.nlargest(40, (i for i in u if i % 7), key=lambda i: (math.log(u[i]) / (i % 7), -i)))


def bins_of(spark, df, n):
    rows = ordering.grid_codes(df, ["x", "y"]).select("id", "code").collect()
    ranked = sorted((r.code, r.id) for r in rows)
    return {i: at * n // len(ranked) for at, (_, i) in enumerate(ranked)}


def merged(rows, of):
    out = {}
    for b in set(of.values()):
        part = [r for r in rows if of[r[0]] == b]
        m = np.array([a * sx * sy for _, _, _, sx, sy, a in part])
        mean = [sum(w * r[1 + k] for w, r in zip(m, part, strict=True)) / m.sum() for k in (0, 1)]
        var = [sum(w * (r[3 + k] ** 2 + r[1 + k] ** 2) for w, r in zip(m, part, strict=True)) / m.sum() - mean[k] ** 2 for k in (0, 1)]
        out[b] = (len(part), *mean, *np.sqrt(var))
    return out


def test_bins_and_lloyd_rounds_equal_plain_python(spark):
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.random(2) * 10), *map(float, rng.random(2) + 0.2), float(rng.random() + 0.1)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x double, y double, sx double, sy double, amp double")
    of = bins_of(spark, df, 8)
    binned = ordering.held(lod.equal_bins(df, ["x", "y"], ["id"], 8))
    assert {r.id: r.bin for r in binned.collect()} == of

    def same(found, expected):
        got = {r.bin: (r.n, r.x, r.y, r.sx, r.sy) for r in found.collect()}
        assert got.keys() == expected.keys() and all(got[b] == pytest.approx(expected[b]) for b in expected)

    same(lod.merge_bins(binned, "bin", ["x", "y"], ["sx", "sy"], "amp"), merged(rows, of))
    for _ in range(2):
        means = {b: m[1:3] for b, m in merged(rows, of).items()}
        for i, x, y, *_ in rows:
            near = [((x - a) ** 2 + (y - c) ** 2, b) for b, (a, c) in means.items() if abs(math.floor(a / 4) - math.floor(x / 4)) <= 1 and abs(math.floor(c / 4) - math.floor(y / 4)) <= 1]
            of[i] = min(near)[1] if near else of[i]
    refined = lod.refine_bins(binned, "bin", ["x", "y"], ["sx", "sy"], "amp", "id", 4.0, 2)
    same(lod.merge_bins(refined, "bin", ["x", "y"], ["sx", "sy"], "amp"), merged(rows, of))


def test_intermediate_tables_are_released(spark):
    ordering.held(spark.range(3)).count()
    assert ordering.release(spark) > 0 and ordering.release(spark) == 0
