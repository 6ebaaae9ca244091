import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperslice.dims import Dimension, View
from hyperslice.operators import chunks, lod, mesh
from hyperslice.sources import files, tables
from hyperslice.streaming import progressive


def scanned(df):
    """Rows that the scan of a plan without shuffles gives to the filter behind it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_points_round_trip(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 4).cast("double").alias("t"), (F.col("id") * 7 % 101).cast("double").alias("x"), (F.col("id") * 3 % 97).cast("double").alias("y"), F.lit(None).cast("string").alias("label"))
    path = str(tmp_path / "points")
    tables.write_points(df, path, ["t"], ["x", "y"], ["id"], chunk_size=50, radius=F.lit(1.0), labels=["label"])
    assert tables.summary(spark, path)["rows"] == 1000
    view = View((Dimension("x", display=True), Dimension("y", display=True), Dimension("t", discrete=True)), {"t": 2.0})
    part = tables.read_points(spark, path, view)
    assert part.filter("t = 2").count() == 250 and part.count() < 400
    assert tables.read_points(spark, path).filter("label = ''").count() == 1000
    assert scanned(part) == part.count()  # the scan itself read no other chunk
    wanted = spark.createDataFrame([(c,) for c in range(0, 20, 2)], "chunk long")
    rows = tables.read_points(spark, path)
    for most in (512, 3):  # all runs as bounds, or parts with gaps and a semi join
        found = chunks.within_chunks(rows, wanted, "chunk", most=most)
        assert {r.chunk for r in found.collect()} == set(range(0, 20, 2)) and found.count() == 500
        assert {r.ord for r in chunks.within_chunks(rows, wanted, "ord", 50, most).collect()} == {i for i in range(1000) if i // 50 % 2 == 0}
    assert chunks.within_chunks(rows, wanted.filter("false"), "chunk").count() == 0
    assert tables.row_range(tables.read_points(spark, path), 10, 20).count() == 10
    tables.compact(spark, f"{path}/rows", str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == 1000


def test_ranges(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 15, 16, 17)], "id long")
    assert sorted((r.start, r.stop) for r in chunks.id_ranges(ids, "id", 4).collect()) == [(1, 4), (7, 9), (15, 18)]


def test_text_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("symbol\tStatus\tLocation\nA\tApproved\t1p2\nB\tWithdrawn\t2\nA\tApproved\tXq\n\tApproved\t3\nC\tApproved\treserved\n")
    found = tables.dimension_table(spark, str(tmp_path / "t.tsv"), "symbol", location="Location").collect()
    assert {(r.symbol, r.chromosome) for r in found} == {("A", "1"), ("C", "?")}
    edges = spark.createDataFrame([("9.a", "9.b"), ("9.b", "9.a"), ("8.a", "9.b"), ("9.a", "9.a"), ("9.a", "9.z")], "p string, q string")
    names = spark.createDataFrame([("9.a", "A"), ("9.b", "B")], "id string, name string")
    assert [(r.a, r.b) for r in tables.edge_table(edges, names, "p", "q", "id", "name", "9.").collect()] == [("A", "B")]


def test_mesh_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 -1\n")
    tri = struct.pack("<12fH", *([0.0] * 3 + [0, 0, 0, 1, 0, 0, 0, 1, 0]), 0)
    (tmp_path / "m/b.stl").write_bytes(b"solid".ljust(80, b" ") + struct.pack("<I", 1) + tri)
    (tmp_path / "m/c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    found = files.read_meshes(spark, str(tmp_path / "m"))
    counts = {(r.file[-5:], r.kind): r["count"] for r in found.groupBy("file", "kind").count().collect()}
    assert counts == {("a.obj", "vertex"): 4, ("a.obj", "face"): 1, ("b.stl", "vertex"): 3, ("b.stl", "face"): 1, ("c.ply", "vertex"): 3, ("c.ply", "face"): 1}
    assert mesh.fan(found.filter("kind = 'face' and file like '%a.obj'").select("corners")).count() == 2


def test_splat_files(spark, tmp_path):
    row = {"x": 1.0, "y": 2.0, "z": 3.0, "scale_0": 0.0, "scale_1": float(np.log(2)), "scale_2": 0.0, "opacity": 0.0, "rot_0": 1.0, "rot_1": 0.0, "rot_2": 0.0, "rot_3": 0.0}
    (tmp_path / "s.ply").write_bytes(files.write_splat_ply([row, row]))
    r = files.read_splat_ply(spark, str(tmp_path / "s.ply")).first()
    assert r.center == [1, 2, 3] and r.opacity == 0.5 and np.allclose(r.chol, [1, 0, 2, 0, 0, 1])


def test_volume_files(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(24).reshape(2, 3, 4))
    v = files.read_volumes(spark, str(tmp_path / "v.npy"), skip_zero=True)
    assert v.count() == 23 and v.filter("z = 1 and y = 2 and x = 3").first().value == 23


def test_progressive_ladder(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    ladder = lod.with_levels(df, [F.desc("v"), F.col("id")], [10, 30, 100]).select("id", "v", "lod").repartition(4)
    progressive.write_ladder(ladder, str(tmp_path / "ladder"))
    schema = spark.read.parquet(str(tmp_path / "ladder")).drop("lod").schema
    seen = []

    def on_level(d, n):
        seen.append((n, d.count(), {r.lod for r in d.select("lod").distinct().collect()}))

    run = lambda: progressive.refine(spark, str(tmp_path / "ladder"), schema, on_level, str(tmp_path / "state"))
    assert len(list((tmp_path / "ladder" / "lod=2").glob("*.parquet"))) > 1  # a level of several files is one batch all the same
    assert run() == [0, 1, 2] and seen == [(0, 10, {0}), (1, 20, {1}), (2, 70, {2})]
    assert run() == [] and len(seen) == 3
    assert progressive.admitted_levels([10, 20, 70], 10, 3) == 2 and progressive.admitted_levels([99], 1, 1) == 1
    assert progressive.stop_after(0, 3, 10, 5) and not progressive.stop_after(0, 3, 1, None)


def test_latest_views(spark):
    r = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "node int, at int, view string")
    assert {(x.node, x.view) for x in progressive.latest_views(r, "node", "at").collect()} == {(1, "b"), (2, "c")}


def test_unknown_mesh_kind():
    with pytest.raises(ValueError):
        files.mesh_of("x.txt", b"")
