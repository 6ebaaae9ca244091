"""Rankings, pyramids, noise, codecs, groups, modularity, metrics, batches, volume and mesh files."""

import base64
import json
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperslice.dims import Dimension, View, extrapolated, is_plain_3d
from hyperslice.functions import codecs, covariance
from hyperslice.operators import chunks, combine, edits, full, graph, lod, metrics, ordering, raster
from hyperslice.plans import batch, partition
from hyperslice.sources import files

AXES, SIGMAS = ["x", "y"], ["sx", "sy"]


@pytest.fixture(scope="module")
def splats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.random(2) * 10), *map(float, rng.random(2) + 0.2), float(rng.random() + 0.1)) for i in range(120)]
    return ordering.held(spark.createDataFrame(rows, "id long, x double, y double, sx double, sy double, amp double"))


def test_every_ranking_orders_all_rows(splats):
    rows = {r.id: r for r in splats.collect()}
    ranks = {}
    for method in lod.METHODS:
        found = lod.ladder(splats, method, 10, AXES, SIGMAS, "amp", "id").collect()
        ranks[method] = [r.id for r in sorted(found, key=lambda r: r["rank"])]
        assert sorted(ranks[method]) == sorted(rows) and found[0].asDict().keys() == {*rows[0].asDict(), "rank", "lod"}
    assert ranks["amplitude"] == sorted(rows, key=lambda i: -rows[i].amp)
    assert ranks["mass"] == sorted(rows, key=lambda i: -rows[i].amp * rows[i].sx * rows[i].sy)
    mass = np.array([rows[i].amp * rows[i].sx * rows[i].sy for i in rows])
    mid = [np.average([getattr(rows[i], a) for i in rows], weights=mass) for a in AXES]
    assert ranks["radial"] == sorted(rows, key=lambda i: (rows[i].x - mid[0]) ** 2 + (rows[i].y - mid[1]) ** 2)
    energy = {i: r.amp**2 * r.sx * r.sy for i, r in rows.items()}
    assert ranks["spectral"] == sorted(rows, key=lambda i: (-math.floor(math.log2(math.sqrt(rows[i].sx * rows[i].sy))), -energy[i]))
    quarter = {i: (int(rows[i].x > (min(r.x for r in rows.values()) + max(r.x for r in rows.values())) / 2), int(rows[i].y > (min(r.y for r in rows.values()) + max(r.y for r in rows.values())) / 2)) for i in rows}
    best = {q: max((i for i in rows if quarter[i] == q), key=energy.get) for q in set(quarter.values())}
    assert set(ranks["greedy"][:4]) == set(best.values())
    with pytest.raises(ValueError):
        lod.ranking(splats, "none", AXES, SIGMAS, "amp", "id")


def test_pyramid(splats):
    made = lod.pyramid(splats, AXES, SIGMAS, "amp", "id", factor=4, levels=5, chunk=10)
    counts = {r.level: r.n for r in made.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 120, 1: 30, 2: 7, 3: 1}
    matrix = lod.level_matrix(made, "amp").collect()
    assert {(r.level, r.lod): r.n for r in matrix if r.level == 1} == {(1, 0): 10, (1, 1): 10, (1, 2): 10}
    whole, one = (made.filter(f"level = {k}").agg(F.sum(F.col("amp") * F.col("sx") * F.col("sy"))).first()[0] for k in (0, 3))
    assert one == pytest.approx(whole)


def test_noise_of_white_noise(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0.5, 0.05, (40, 60))
    df = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(40) for j in range(60)], "a long, b long, value double")
    found = raster.noise_floor(df, ["a", "b"])
    assert all(found[k] == pytest.approx(0.05, rel=0.1) for k in found)
    assert all(math.isnan(x) for x in raster.noise_floor(df.filter("false"), ["a", "b"]).values())
    spots = spark.createDataFrame([(0, 0, 2.0), (0, 1, 4.0), (99, 99, 1.0), (1, 1, 0.0)], "a long, b long, peak double")
    drawn = spark.createDataFrame([(0, 0, 1.0), (0, 1, 4.0)], "a long, b long, value double")
    assert raster.spot_peak_ratio(drawn, spots, ["a", "b"]) == 0.5 and math.isnan(raster.spot_peak_ratio(drawn, spots.filter("false"), ["a", "b"]))
    gains = spark.createDataFrame([(0.1, 1.0), (0.0, 1.0), (1.0, 0.0)], "h double, b double").select(raster.gain_db(F.col("h"), F.col("b")).alias("g")).collect()
    assert gains[0].g == pytest.approx(10) and gains[1].g == math.inf and math.isnan(gains[2].g)
    assert [r.value for r in raster.on_basis(drawn, 2.0).orderBy("b").collect()] == [0.0, 2.0] and raster.on_basis(drawn, None) is drawn
    curve = spark.createDataFrame([(k, g) for k, g in enumerate([0.0, 5.0, 7.0, 7.05, 7.06, 9.0])], "k int, g double")
    assert raster.plateau(curve, "k", "g").first().stop == 4 and raster.plateau(curve, "k", "g", patience=3).first().stop is None


def test_equalised_tiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    n, tile, bins, clip = 12, 4, 8, 2.0
    v = rng.random((n, n))
    df = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(n) for j in range(n)], "a long, b long, value double")
    found = {(r.a, r.b): r.value for r in raster.equalise_tiles(df, ["a", "b"], tile, clip, bins).collect()}
    at = np.minimum((v * bins).astype(int), bins - 1)
    curves = {}
    for s in range(n // tile):
        for t in range(n // tile):
            h = np.bincount(at[s * tile : (s + 1) * tile, t * tile : (t + 1) * tile].ravel(), minlength=bins).astype(float)
            kept = np.minimum(h, max(1.0, clip * tile * tile / bins))
            curves[s, t] = (np.cumsum(kept) + (tile * tile - kept.sum()) / bins * np.arange(1, bins + 1)) / (tile * tile)
    for i in range(n):
        for j in range(n):
            y, x = (i + 0.5) / tile - 0.5, (j + 0.5) / tile - 0.5
            total = weight = 0.0
            for s in (math.floor(y), math.floor(y) + 1):
                for t in (math.floor(x), math.floor(x) + 1):
                    w = (1 - abs(y - s)) * (1 - abs(x - t))
                    if (s, t) in curves:
                        total, weight = total + w * curves[s, t][at[i, j]], weight + w
            assert found[i, j] == pytest.approx(total / weight)


def test_codecs_are_chosen_by_their_error(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, 0.25, float(u), float(10 ** (6 * u)), float(u - 0.5), i // 100, "ab"[i % 2]) for i, u in enumerate(rng.random(500))], "id long, same double, unit double, wide double, signed double, slow long, name string")
    assert codecs.choose_codec(df, "same", "color", 0.0)["codec"] == "constant"
    assert codecs.choose_codec(df, "unit", "bounded_scalar", 0.01)["codec"] == "linear8"
    assert codecs.choose_codec(df, "unit", "bounded_scalar", 1e-4)["codec"] == "linear16"
    assert codecs.choose_codec(df, "unit", "bounded_scalar", 1e-9)["codec"] == "plain"
    assert codecs.choose_codec(df, "wide", "positive_scalar", 0.05)["codec"] == "geometric8"
    assert codecs.choose_codec(df, "signed", "signed_scalar", 1e-3)["codec"] == "signed_log16"
    assert codecs.choose_codec(df, "name", "label", 0.0)["codec"] == "dictionary"
    with pytest.raises(ValueError):
        codecs.choose_codec(df, "signed", "positive_scalar", 0.1)
    chunked = df.withColumn("chunk", F.floor(F.col("id") / 250)).withColumn("code", F.col("id") * 3 % 65536)
    assert codecs.delta_pays(chunked, "code", "chunk", "id")
    assert not codecs.delta_pays(chunked.withColumn("code", F.pmod(F.xxhash64("id"), F.lit(4))), "code", "chunk", "id")
    values = codecs.constant_encode(df, ["same"])
    assert values == {"same": 0.25} and codecs.constant_encode(df, ["same", "unit"]) is None
    assert codecs.constant_decode(df.select("id"), values).filter("same = 0.25").count() == 500
    chol = df.select(F.array(F.col("unit") + 1, F.col("signed") * 0.01, F.col("unit") + 1).alias("chol"))
    assert codecs.cholesky_tiers(chol, "chol", 2, 0.01) == {"diagonal": 8, "rest": 8}
    assert codecs.cholesky_tiers(chol, "chol", 2, 1e-4)["diagonal"] == 16


def test_groups_and_types(spark):
    tree = graph.lod_group(spark, "w/a", "w", "splats", 2).unionByName(graph.partition_group(spark, "w/b", "w", "points", 3, 100))
    scene = spark.createDataFrame([("w", None, "w", "scene", None, {})], tree.schema)
    found = {r.path: r.display_type for r in graph.roll_up_types(scene.unionByName(tree)).collect()}
    assert found == {"w": None, "w/a": "splats", "w/b": "points"}
    for call in (lambda: graph.lod_group(spark, "a", None, "image", 2), lambda: graph.lod_group(spark, "a", None, "mesh", 2, 2), lambda: graph.partition_group(spark, "a", None, "mesh", 0, 5)):
        with pytest.raises(ValueError):
            call()


def test_louvain_finds_planted_communities(spark):
    rng = np.random.default_rng(5)
    edges = [(i, j) for i in range(40) for j in range(i + 1, 40) if rng.random() < (0.7 if i // 10 == j // 10 else 0.02)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.id: (r.community, r["size"]) for r in graph.louvain(spark.range(42).select("id"), df).collect()}
    groups = {}
    for i, (c, size) in found.items():
        groups.setdefault(c, set()).add(i)
        assert size == sum(x == c for x, _ in found.values())
    assert sorted(map(sorted, groups.values())) == [[*range(10)], [*range(10, 20)], [*range(20, 30)], [*range(30, 40)], [40], [41]]
    links = df.selectExpr("a", "b", "1.0D AS w").unionByName(df.selectExpr("b AS a", "a AS b", "1.0D AS w"))
    labels = spark.createDataFrame([(i, i // 10) for i in range(40)], "n long, c long")
    m = len(edges)
    degree = np.bincount(np.array(edges).ravel(), minlength=40)
    plain = sum(i // 10 == j // 10 for i, j in edges) / m - sum((degree[10 * c : 10 * c + 10].sum() / (2 * m)) ** 2 for c in range(4))
    assert graph.modularity(labels, links) == pytest.approx(plain)
    assert graph.louvain(spark.range(2).select("id"), df.filter("false")).count() == 2


def test_metrics(spark):
    stats = spark.createDataFrame([("n", 10, 5, 3, True), ("n", 20, 7, 9, False), ("m", 1, 1, 1, True)], "node string, rows long, bytes long, millis long, ready boolean")
    assert metrics.totals(stats, ["rows", "bytes"], ["millis"]).first().asDict() == {"parts": 3, "rows": 31, "bytes": 13, "millis": 9}
    assert {(r.node, r.loaders, r.rows, r.millis, r.ready) for r in metrics.merged_metrics(stats, "node").collect()} == {("n", 2, 30, 9, False), ("m", 1, 1, 1, True)}
    parts = spark.createDataFrame([({"a": 1, "b": 2},), ({"a": 3},), ({},)], "c map<string,int>")
    assert {r.name: r.n for r in metrics.merged_counts(parts, "c").collect()} == {"a": 4, "b": 2}
    reports = spark.createDataFrame([(1, "pending"), (1, "running"), (2, "done"), (2, "running"), (3, "failed"), (3, "done"), (4, "odd"), (5, None)], "job int, state string")
    assert {r.state: r.jobs for r in metrics.job_states(reports).collect()} == {"running": 1, "done": 1, "failed": 1, "pending": 2}


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("part"))
    boxes = [partition.Box((0.0,), (1.0,), 3.0)]
    mark = batch.plan_fingerprint(boxes, {"k": 1}, "s")
    assert mark != batch.plan_fingerprint(boxes, {"k": 2}, "s") and len(mark) == 16
    seen = []

    def work(df):
        seen.append(sorted(r.part for r in df.select("part").distinct().collect()))
        if len(seen) == 2:
            raise RuntimeError("lost")
        return df.withColumn("twice", F.col("id") * 2)

    with pytest.raises(RuntimeError):
        batch.run_parts(rows, "part", str(tmp_path), mark, work, range(5), wave=2)
    assert batch.done_parts(spark, str(tmp_path), mark) == {0, 1}
    assert batch.run_parts(rows, "part", str(tmp_path), mark, work, range(5), wave=2) == [2, 3, 4] and seen[2:] == [[2, 3], [4]]
    assert batch.run_parts(rows, "part", str(tmp_path), mark, work, range(5)) == []
    out = spark.read.parquet(f"{tmp_path}/{mark}/rows")
    assert out.count() == 100 and out.agg(F.sum("twice")).first()[0] == 9900


def test_views_go_on_and_chunks_are_fetched_ahead(spark):
    dims = (Dimension("x", display=True), Dimension("t", discrete=True, low=0, high=9))
    a, b = View(dims, {"t": 3.0}), View(dims, {"t": 5.0})
    assert extrapolated(a, b).at(dims[1]) == 7.0 and extrapolated(a, View(dims, {"t": 8.0})).at(dims[1]) == 9.0
    index = spark.range(10).select(F.col("id").alias("chunk"), F.col("id").cast("double").alias("lo_t"), F.col("id").cast("double").alias("hi_t"))
    assert [r.chunk for r in chunks.prefetch(index, b, a).collect()] == [7] and chunks.prefetch(index, b, None).count() == 0
    assert is_plain_3d(3, [0, 1, 2]) and not is_plain_3d(4, [0, 1, 2]) and not is_plain_3d(3, [0, 2, 1])


def test_channels(spark):
    with_, without = spark.createDataFrame([(1, 2), (2, 3)], "id int, label_id int"), spark.createDataFrame([(1,)], "id int")
    combine.require_channel([with_, with_], "label_id", "id")
    combine.require_channel([without], "label_id", "id")
    for levels in ([with_, without], [with_.withColumn("label_id", F.when(F.col("id") > 1, 1))]):
        with pytest.raises(ValueError):
            combine.require_channel(levels, "label_id", "id")
    assert edits.without_labels(with_).columns == ["id"]


def test_lines_are_ordered_with_their_vertices(spark):
    v = spark.createDataFrame([(10, 9.0, 9.0), (11, 0.0, 0.0), (12, 1.0, 1.0), (13, 8.0, 8.0)], "id long, x double, y double")
    s = spark.createDataFrame([(10, 13, "far"), (11, 12, "near"), (11, 99, "lost")], "a long, b long, w string")
    vertices, segments = ordering.order_lines(v, s, ["x", "y"], "id")
    at = {r.id: r.ord for r in vertices.collect()}
    assert [at[i] for i in (11, 12, 13, 10)] == [0, 1, 2, 3]
    assert [(r.ord, r.a, r.b, r.w) for r in segments.orderBy("ord").collect()] == [(0, 0, 1, "near"), (1, 3, 2, "far")]


def test_full_covariances_against_numpy(spark):
    rng = np.random.default_rng(6)
    lower = np.tril(rng.normal(size=(30, 3, 3)))
    lower[:, range(3), range(3)] = np.abs(lower[:, range(3), range(3)]) + 0.3
    mu, amp = rng.normal(size=(30, 3)) * 2, rng.random(30) + 0.5
    rows = [(i, mu[i].tolist(), covariance.pack(lower[i : i + 1])[0].tolist(), float(amp[i]), i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, center array<double>, chol array<double>, amp double, bin int")
    sigma = lower @ lower.transpose(0, 2, 1)
    view = View((Dimension("x", display=True), Dimension("y", display=True), Dimension("z", spatial=True)), {"z": 0.5})
    for r in full.conditional_slice(df, view).collect():
        s, gap = sigma[r.id], 0.5 - mu[r.id][2]
        assert r.center == pytest.approx(mu[r.id][:2] + s[:2, 2] / s[2, 2] * gap)
        made = covariance.unpack(np.array([r.chol]))[0]
        assert made @ made.T == pytest.approx(s[:2, :2] - np.outer(s[:2, 2], s[:2, 2]) / s[2, 2])
        assert r.amp == pytest.approx(amp[r.id] * math.exp(-(gap**2) / s[2, 2] / 2))
    mass = amp * lower[:, range(3), range(3)].prod(1)
    for r in full.merge_bins(df, "bin", 3).collect():
        at = np.arange(30) % 3 == r.bin
        w = mass[at] / mass[at].sum()
        mean = w @ mu[at]
        total = np.einsum("n,nij->ij", w, sigma[at] + mu[at][:, :, None] * mu[at][:, None]) - np.outer(mean, mean)
        made = covariance.unpack(np.array([r.chol]))[0]
        assert r.center == pytest.approx(mean) and made @ made.T == pytest.approx(total) and r.mass == pytest.approx(mass[at].sum())
    inner = 0.0
    for i in range(30):
        for j in range(30):
            t, g = sigma[i] + sigma[j], mu[i] - mu[j]
            root = lower[i].diagonal().prod() * lower[j].diagonal().prod()
            inner += amp[i] * amp[j] * (2 * np.pi) ** 1.5 * root / np.sqrt(np.linalg.det(t)) * np.exp(-g @ np.linalg.solve(t, g) / 2)
    assert full.inner_product(df, df, 3).first().inner == pytest.approx(inner)


def tiff(pages, packed, order="<"):
    """A TIFF of 16-bit pages with a resolution and a description."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        raw = page.astype(order + "u2").tobytes()
        raw = zlib.compress(raw) if packed else raw
        data, text = len(out), b"ImageJ=1\nspacing=2.5\nunit=um\n\0"
        out += raw
        said, res = len(out), len(out) + len(text)
        out += text + struct.pack(order + "II", 4, 1) + b"\0" * (len(out) + len(text) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        tags = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 3, 1, 16), (259, 3, 1, 8 if packed else 1), (270, 2, len(text), said), (273, 4, 1, data), (279, 4, 1, len(raw)), (282, 5, 1, res), (283, 5, 1, res)]
        out += struct.pack(order + "H", len(tags))
        for tag, kind, n, value in tags:
            out += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def test_volume_files_of_all_kinds(spark, tmp_path):
    v = np.arange(2 * 3 * 5).reshape(2, 3, 5)
    expected = {(z, y, x): float(v[z, y, x]) for z in range(2) for y in range(3) for x in range(5)}
    np.savez(tmp_path / "v.npz", first=v)
    for name, data in (("a.tif", tiff(v, False)), ("b.tiff", tiff(v, True)), ("c.tif", tiff(v, True, ">"))):
        (tmp_path / name).write_bytes(data)
        assert files.tiff_spacing(data) == {"x": 0.25, "y": 0.25, "z": 2.5, "unit": "um"}
    meta = {"shape": [2, 3, 5], "chunks": [1, 2, 3], "dtype": "<i4", "compressor": {"id": "zlib"}, "order": "C", "fill_value": 0, "filters": None}
    folder = tmp_path / "v.zarr"
    folder.mkdir()
    (folder / ".zarray").write_text(json.dumps(meta))
    with zipfile.ZipFile(tmp_path / "v.zarr.zip", "w") as z:
        z.writestr(".zarray", json.dumps(meta))
        for i in range(2):
            for j in range(2):
                for k in range(2):
                    block = np.zeros((1, 2, 3), "<i4")
                    part = v[i : i + 1, 2 * j : 2 * j + 2, 3 * k : 3 * k + 3]
                    block[: part.shape[0], : part.shape[1], : part.shape[2]] = part
                    raw = zlib.compress(block.tobytes())
                    z.writestr(f"{i}.{j}.{k}", raw)
                    (folder / f"{i}.{j}.{k}").write_bytes(raw)
    for name in ("v.npz", "a.tif", "b.tiff", "c.tif", "v.zarr.zip"):
        found = files.read_volumes(spark, str(tmp_path / name)).collect()
        assert {(r.z, r.y, r.x): r.value for r in found} == expected and len(found) == 30, name
    found = files.read_zarr(spark, str(folder)).collect()
    assert {(r.z, r.y, r.x): r.value for r in found} == expected and len(found) == 30
    assert files.read_zarr(spark, str(folder), skip_zero=True).count() == 29
    with pytest.raises(ValueError):
        files.zarr_chunk({"compressor": {"id": "blosc"}, "chunks": [1], "dtype": "<i4"}, b"")


def test_gltf_and_vtp_meshes():
    points, corners = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]], "<f4"), np.array([0, 1, 2, 2, 1, 3], "<u2")
    raw = points.tobytes() + corners.tobytes()
    tree = {"buffers": [{"byteLength": len(raw)}], "bufferViews": [{"buffer": 0, "byteLength": 48}, {"buffer": 0, "byteOffset": 48, "byteLength": 12}], "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 4}, {"bufferView": 1, "componentType": 5123, "type": "SCALAR", "count": 6}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 0}, "mode": 1}]}]}
    head = json.dumps(tree).encode()
    head += b" " * (-len(head) % 4)
    glb = b"glTF" + struct.pack("<II", 2, 28 + len(head) + len(raw)) + struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(raw), b"BIN\0") + raw
    tree["buffers"][0]["uri"] = "data:application/octet-stream;base64," + base64.b64encode(raw).decode()
    inline = base64.b64encode(struct.pack("<I", 48) + points.tobytes()).decode()
    vtp = f"""<VTKFile type="PolyData" byte_order="LittleEndian"><PolyData><Piece><Points><DataArray type="Float32" format="binary">{inline}</DataArray></Points>
    <Polys><DataArray type="Int32" Name="connectivity" format="ascii">0 1 2 2 1 3</DataArray><DataArray type="Int32" Name="offsets" format="ascii">3 6</DataArray></Polys></Piece></PolyData></VTKFile>"""
    for name, data in (("a.glb", glb), ("a.gltf", json.dumps(tree).encode()), ("a.vtp", vtp.encode())):
        vertices, faces = files.mesh_of(name, data)
        assert vertices.tolist() == points.tolist() and faces == [[0, 1, 2], [2, 1, 3]], name
