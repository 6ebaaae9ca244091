import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperslice.dims import Affine, Dimension, Permutation, View, advance, check_version, compose, discrete_preimage, inverted, parse_bbox, parse_ranges, parse_threshold, partition_margin, resolve_extend
from hyperslice.functions import covariance, curves
from hyperslice.operators import affine, combine, filters, graph, lod, mesh, neighbors, raster
from hyperslice.plans import partition


def test_dimension_rules():
    d = Dimension("kind", categories=("a", "b", "c"))
    assert (d.discrete, d.low, d.high, d.stepping()) == (True, 0.0, 2.0, 1.0)
    assert Dimension("t", spatial=False).discrete
    assert Dimension("x", display=True, low=0, high=50).stepping() == 0.5
    with pytest.raises(ValueError):
        Dimension("z", discrete=True, spatial=True)
    with pytest.raises(ValueError):
        Dimension("k", categories=("a", "a"))
    with pytest.raises(ValueError):
        Dimension("x", display=True, low=1, high=1)


def test_view_and_margins():
    dims = (Dimension("x", display=True), Dimension("t", discrete=True), Dimension("w", spatial=True, low=0, high=10))
    view = View(dims, {"t": 3}, extend=("w",))
    assert [d.name for d in view.sliced()] == ["t"] and view.load_all()
    assert view.fetch_tolerance(dims[1]) == 0.25
    assert partition_margin(1.0, 0.0) == 0.75 and partition_margin(None, 0.0) == 0.5
    assert resolve_extend(dims, "all") == ["t", "w"] and resolve_extend(dims, None) == []
    with pytest.raises(ValueError):
        View(dims, extend=("nothing",))


def test_transforms():
    c = compose({"t": Affine(2, 1)}, {"t": Affine(3, 4)})
    assert c["t"] == Affine(6, 9)
    assert compose({"k": Permutation((2, 0, 1))}, {"k": Permutation((1, 2, 0))})["k"] == Permutation((0, 1, 2))
    assert discrete_preimage(5, Affine(2, 1)) == 2
    assert discrete_preimage(4, Affine(2, 1)) is None
    dims = (Dimension("x", display=True), Dimension("t", discrete=True))
    assert inverted(View(dims, {"t": 4}), {"t": Affine(2, 1)}) is None
    with pytest.raises(ValueError):
        Affine(0, 1)
    with pytest.raises(ValueError):
        Permutation((0, 0))


def test_playback():
    assert advance(8, 0, 9, 2) == (9, 1, True)
    assert advance(9, 0, 9, 2, "loop") == (0, 1, True)
    assert advance(9, 0, 9, 2, "once") == (9, 1, False)
    assert advance(9, 0, 9, 2, "bounce") == (7, -1, True)


def test_parsers():
    assert parse_threshold("p90") == ("percentile", 90.0) and parse_threshold("5%") == ("percentile", 5.0) and parse_threshold("0.5") == ("absolute", 0.5)
    assert parse_bbox("0 1 2 3", 2) == [(0, 1), (2, 3)]
    assert parse_ranges(":3,1:", 2) == [(None, 3.0), (1.0, None)]
    assert check_version((1, 2), [(1, 1)]) == "newer"
    for bad in (lambda: parse_threshold("p101"), lambda: parse_bbox("1 0", 1), lambda: parse_ranges("1", 1), lambda: check_version((2, 0), [(1, 1)])):
        with pytest.raises(ValueError):
            bad()


def test_level_cuts():
    assert lod.stream_cuts(100, 8) == [8, 16, 32, 64, 100]
    assert lod.stream_cuts(66, 8) == [8, 16, 32, 66]
    assert lod.stream_cuts(64, 8) == [8, 16, 32, 64]
    assert lod.stream_cuts(5, 8) == [5] and lod.stream_cuts(0, 1) == [0]
    assert lod.resolve_target(0.5, 10) == 5 and lod.resolve_target(99, 10) == 10
    with pytest.raises(TypeError):
        lod.resolve_target(True, 10)


def test_matrices():
    m = affine.composed(affine.scaling(2), affine.translation(1, 0, 0))
    assert np.allclose(np.array(m) @ [1, 0, 0, 1], [3, 0, 0, 1])
    assert np.allclose(np.array(affine.inverse(m)) @ np.array(m), np.eye(4))
    assert np.allclose(np.array(affine.rotation((0, 0, 1), 90)) @ [1, 0, 0, 1], [0, 1, 0, 1])
    assert np.allclose(np.array(affine.look_at((0, 0, 5), (0, 0, 0))) @ [0, 0, 0, 1], [0, 0, -5, 1])
    assert affine.permutation_parity([1, 0, 2]) == 1


def test_hilbert_is_continuous():
    bits = 4
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 2, indexing="ij"), -1).reshape(-1, 2)
    code = curves.hilbert_index(grid, bits)
    assert sorted(code) == list(range(len(grid)))
    path = grid[np.argsort(code)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packed_factors(spark):
    packed = [1.0, 0.5, 2.0, 0.3, 0.1, 3.0]
    df = spark.createDataFrame([(packed,)], "chol array<double>")
    chol = F.col("chol")
    row = df.select(covariance.packed_volume(chol, 3).alias("v"), covariance.permute_packed(chol, [2, 0, 1]).alias("p"), covariance.embed_packed(chol, [0, 1, 3], 4, 0.5).alias("e"), covariance.packed_sigma(chol, 1).alias("s")).first()
    lower = covariance.unpack(np.array([packed]))[0]
    sigma = lower @ lower.T
    assert math.isclose(row.v, np.linalg.det(sigma) ** (1 / 3))
    back = covariance.unpack(np.array([row.p]))[0]
    assert np.allclose(back @ back.T, sigma[np.ix_([2, 0, 1], [2, 0, 1])])
    wide = covariance.unpack(np.array([row.e]))[0]
    assert np.isclose((wide @ wide.T)[2, 2], 0.25) and np.allclose((wide @ wide.T)[2, [0, 1, 3]], 0)
    assert np.isclose(row.s, math.sqrt(sigma[1, 1]))


def test_cull_properties(spark):
    df = spark.range(100).select("id", ((F.col("id") + 1) / 100).alias("amp"))
    assert filters.cull_percentile(df, "amp", 90.0).count() == 10
    assert filters.cull_cumulative(df.withColumn("amp", F.lit(0.0)), "amp", ["id"], 0.5).count() == 100
    assert filters.cull_cumulative(df, "amp", ["id"], 1e-9).count() == 1


def test_tracking_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in (10, 11, 12, 13, 14, 15, 90, 91)], "id long")
    edges = spark.createDataFrame([(10, 11), (11, 12), (12, 13), (12, 14), (14, 15), (90, 91), (1, 777)], "src long, dst long")
    kept = graph.present(edges, nodes)
    assert kept.count() == 6
    found = {r.id: r.lineage for r in graph.components(nodes, kept).collect()}
    assert {found[i] for i in (10, 15)} == {0} and found[90] == found[91] == 1
    assert [r.src for r in graph.divisions(kept).collect()] == [12]


def test_neighbors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.random((200, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    d = np.sqrt(((p[:, None] - p) ** 2).sum(-1))
    got = {r.id: r.neighbors for r in neighbors.neighbor_counts(df, ["x", "y"], 0.1, "id").collect()}
    assert got == {i: int((d[i] < 0.1).sum()) - 1 for i in range(200)}
    kth = {r.id: r.distance for r in neighbors.kth_distance(df, ["x", "y"], 5, "id", 0.02).collect()}
    assert all(math.isclose(kth[i], np.sort(d[i])[5]) for i in range(200))
    assert all(math.isinf(r.distance) for r in neighbors.kth_distance(df.limit(3), ["x", "y"], 3, "id", 0.5).collect())


def test_poisson_levels_keep_distance(spark):
    rng = np.random.default_rng(4)
    p = rng.random((120, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    out = neighbors.min_distance_order(df, ["x", "y"], "id", 3).collect()
    assert len(out) == 120
    first = np.array([(r.x, r.y) for r in out if r.lod == 0])
    diagonal = np.linalg.norm(p.max(0) - p.min(0))
    d = np.sqrt(((first[:, None] - first) ** 2).sum(-1)) + np.eye(len(first)) * 9
    assert d.min() >= diagonal / 2


def test_mesh(spark):
    v, f = mesh.icosphere(spark, 1)
    assert (v.count(), f.count()) == (42, 80)
    faces = spark.createDataFrame([(0, 10, 11, 12), (1, 12, 13, 14)], "part int, a long, b long, c long")
    assert sorted((r.part, r.a, r.b, r.c) for r in mesh.split_parts(faces, "part").collect()) == [(0, 0, 1, 2), (1, 0, 1, 2)]
    assert mesh.duplication(faces, "part").first().factor == pytest.approx(6 / 5)


def test_partition(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 100).cast("double").alias("x"), ((F.col("id") * 53) % 90).cast("double").alias("y"))
    cells, weights, cell = partition.content_grid(df, ["x", "y"], 5.0)
    boxes = partition.plan(cells, weights, cell, target=150)
    counts = partition.assign(df, boxes, ["x", "y"]).groupBy("part").count().collect()
    assert sum(r["count"] for r in counts) == 1000 and all(r.part is not None and r["count"] <= 150 for r in counts)
    assert partition.overlap_fraction([], 2) == (0.0, 0.0)


def test_unions(spark):
    a = spark.createDataFrame([(1, [0.1, 0.2, 0.3])], "id long, color array<double>")
    b = spark.createDataFrame([(2,)], "id long")
    c = spark.createDataFrame([(3, [0.1, 0.2, 0.3, 0.4])], "id long, color array<double>")
    assert {r.id: r.color for r in combine.concatenate([a, b]).collect()}[2] == [1.0, 1.0, 1.0]
    assert {r.id: r.color for r in combine.concatenate([a, c]).collect()}[1] == [0.1, 0.2, 0.3, 1.0]
    assert "color" not in combine.with_optional([a, b], "color").columns
    assert "color" in combine.with_optional([a, b.filter("false")], "color").columns
    with pytest.raises(ValueError):
        combine.restride(spark.createDataFrame([(0.3,)], "t double"), "t", 2)


def test_psnr_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")
    row = df.agg(raster.psnr(F.col("a"), F.col("b")).alias("same"), raster.psnr(F.col("a"), F.col("b"), F.lit(False)).alias("none")).first()
    assert math.isinf(row.same) and math.isnan(row.none)
