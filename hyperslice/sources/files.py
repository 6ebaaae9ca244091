"""Mesh, splat and volume files: parsed on executors from ``binaryFile`` rows, one task for each file."""

from __future__ import annotations

import base64
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESH_SCHEMA = "file string, kind string, id bigint, x double, y double, z double, corners array<bigint>"
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse_obj(data: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Vertices and polygons (indices from 0; negative ones count from the end)."""
    vertices, polygons = [], []
    for line in data.decode(errors="replace").splitlines():
        parts = line.split()
        if parts[:1] == ["v"]:
            vertices.append([float(x) for x in parts[1:4]])
        elif parts[:1] == ["f"]:
            at = [int(p.split("/")[0]) for p in parts[1:]]
            polygons.append([i - 1 if i > 0 else len(vertices) + i for i in at])
    return np.array(vertices, float).reshape(-1, 3), polygons


def parse_stl(data: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Triangle soup. A file whose size fits its count of triangles is binary, whatever it begins with."""
    n = struct.unpack_from("<I", data, 80)[0] if len(data) >= 84 else -1
    if len(data) == 84 + 50 * n:
        body = np.frombuffer(data, np.dtype([("f", "<f4", 12), ("a", "<u2")]), offset=84)
        vertices = body["f"][:, 3:].reshape(-1, 3).astype(float)
    else:
        words = data.decode(errors="replace").split()
        at = [i for i, w in enumerate(words) if w == "vertex"]
        vertices = np.array([[float(words[i + k]) for k in (1, 2, 3)] for i in at]).reshape(-1, 3)
    return vertices, [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(len(vertices) // 3)]


def ply_header(data: bytes) -> tuple[str, list[tuple[str, int, list[tuple[str, str, str | None]]]], int]:
    """(format, elements of (name, count, properties of (name, type, type of a list's length)), size of the header)."""
    end = data.index(b"end_header")
    size = data.index(b"\n", end) + 1
    kind, elements = "", []
    for line in data[:end].decode("ascii", errors="replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:2] == ["property", "list"]:
            elements[-1][2].append((w[4], PLY_TYPES[w[3]], PLY_TYPES[w[2]]))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[2], PLY_TYPES[w[1]], None))
    return kind, elements, size


def parse_ply(data: bytes) -> dict[str, dict[str, list]]:
    """Columns of each element; list properties are lists."""
    kind, elements, at = ply_header(data)
    out: dict[str, dict[str, list]] = {}
    words = iter(data[at:].split()) if kind == "ascii" else None
    order = ">" if kind == "binary_big_endian" else "<"
    for name, count, properties in elements:
        if words is None and all(n is None for _, _, n in properties):
            kinds = np.dtype([(p, order + t) for p, t, _ in properties])
            body = np.frombuffer(data, kinds, count, at)
            at += count * kinds.itemsize
            out[name] = {p: body[p].tolist() for p, _, _ in properties}
            continue
        columns: dict[str, list] = {p: [] for p, _, _ in properties}
        for _ in range(count):
            for p, t, n in properties:
                if words is not None:
                    number = float if t[0] == "f" else int
                    columns[p].append([number(next(words)) for _ in range(int(next(words)))] if n else number(next(words)))
                else:
                    length = 1
                    if n:
                        length = int(np.frombuffer(data, order + n, 1, at)[0])
                        at += np.dtype(n).itemsize
                    values = np.frombuffer(data, order + t, length, at).tolist()
                    at += length * np.dtype(t).itemsize
                    columns[p].append(values if n else values[0])
        out[name] = columns
    return out


def parse_glb(data: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Triangles of a binary or embedded glTF: all primitives of mode 4, without the nodes' transforms."""
    if data[:4] == b"glTF":
        size = struct.unpack_from("<I", data, 12)[0]
        tree = json.loads(data[20 : 20 + size])
        blobs = [data[20 + size + 8 :]]
    else:
        tree, blobs = json.loads(data), []
    for i, b in enumerate(tree.get("buffers", [])):
        if "uri" in b:
            if not b["uri"].startswith("data:"):
                raise ValueError("a buffer outside the file")
            blobs[i:i] = [base64.b64decode(b["uri"].split(",", 1)[1])]
    types = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
    wide = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}

    def values(at: int) -> np.ndarray:
        a = tree["accessors"][at]
        view = tree["bufferViews"][a["bufferView"]]
        kind, n = np.dtype(types[a["componentType"]]), wide[a["type"]]
        start, step = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride") or kind.itemsize * n
        return np.ndarray((a["count"], n), kind, blobs[view.get("buffer", 0)], start, (step, kind.itemsize))

    vertices, faces, first = [], [], 0
    for mesh in tree.get("meshes", []):
        for part in mesh["primitives"]:
            if part.get("mode", 4) != 4:
                continue
            own = values(part["attributes"]["POSITION"]).astype(float)
            at = values(part["indices"])[:, 0].astype(int) if "indices" in part else np.arange(len(own))
            vertices.append(own)
            faces += (at.reshape(-1, 3) + first).tolist()
            first += len(own)
    return np.concatenate(vertices) if vertices else np.zeros((0, 3)), faces


def parse_vtp(data: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Points and polygons of an XML PolyData file whose arrays are ascii or inline base64 without compression."""
    root = ElementTree.fromstring(data)
    if root.get("compressor"):
        raise ValueError("compressed arrays aren't read")
    order = ">" if root.get("byte_order") == "BigEndian" else "<"
    head = np.dtype(order + ("u8" if root.get("header_type") == "UInt64" else "u4"))
    kinds = {"Float32": "f4", "Float64": "f8", "Int32": "i4", "Int64": "i8", "UInt8": "u1", "UInt32": "u4", "UInt64": "u8"}

    def values(array: ElementTree.Element | None) -> np.ndarray:
        if array is None:
            return np.zeros(0)
        kind = np.dtype(order + kinds[array.get("type", "Float32")])
        text = (array.text or "").strip()
        if array.get("format", "ascii") == "ascii":
            return np.array(text.split(), kind)
        if array.get("format") != "binary":
            raise ValueError("appended arrays aren't read")
        raw = base64.b64decode(text)
        return np.frombuffer(raw, kind, offset=head.itemsize)

    vertices, faces, first = [], [], 0
    for piece in root.iter("Piece"):
        points = values(piece.find("Points/DataArray")).astype(float).reshape(-1, 3)
        corners, ends = (values(piece.find(f"Polys/DataArray[@Name='{n}']")).astype(int) for n in ("connectivity", "offsets"))
        faces += [(corners[a:b] + first).tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
        vertices.append(points)
        first += len(points)
    return np.concatenate(vertices) if vertices else np.zeros((0, 3)), faces


def mesh_of(file: str, data: bytes) -> tuple[np.ndarray, list[list[int]]]:
    name = file.lower()
    if name.endswith(".obj"):
        return parse_obj(data)
    if name.endswith(".stl"):
        return parse_stl(data)
    if name.endswith(".ply"):
        ply = parse_ply(data)
        v, f = ply["vertex"], ply.get("face", {})
        polygons = f.get("vertex_indices", f.get("vertex_index", []))
        return np.array([v["x"], v["y"], v["z"]], float).T.reshape(-1, 3), polygons
    if name.endswith((".glb", ".gltf")):
        return parse_glb(data)
    if name.endswith(".vtp"):
        return parse_vtp(data)
    raise ValueError(f"unknown kind of mesh file: {file}")


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """Rows of kind ``vertex`` (id, x, y, z) and ``face`` (id, corners) of the OBJ, STL, PLY, glTF and VTP files under ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                vertices, polygons = mesh_of(file, bytes(data))
                yield pd.DataFrame({"file": file, "kind": "vertex", "id": np.arange(len(vertices)), "x": vertices[:, 0], "y": vertices[:, 1], "z": vertices[:, 2], "corners": None})
                yield pd.DataFrame({"file": file, "kind": "face", "id": np.arange(len(polygons)), "x": np.nan, "y": np.nan, "z": np.nan, "corners": polygons})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, MESH_SCHEMA)


def tiff_pages(data: bytes) -> Iterator[tuple[dict[int, list], np.ndarray]]:
    """(tags, samples (height, width)) of each page of a TIFF: strips or tiles, plain or deflated, one sample a pixel."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF")
    kinds = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
    at = struct.unpack_from(order + "I", data, 4)[0]
    while at:
        tags: dict[int, list] = {}
        count = struct.unpack_from(order + "H", data, at)[0]
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in kinds:
                continue
            form = f"{order}{n}s" if kind == 2 else order + kinds[kind] * n
            where = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            tags[tag] = list(struct.unpack_from(form, data, where))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
        width, height, packed = tags[256][0], tags[257][0], tags.get(259, [1])[0]
        if packed not in (1, 8, 32946) or tags.get(277, [1])[0] != 1 or tags.get(317, [1])[0] != 1:
            raise ValueError("only plain or deflated samples, one a pixel, are read")
        kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[tags.get(339, [1])[0]] + str(tags[258][0] // 8))
        blocks = [data[o : o + n] for o, n in zip(tags.get(324, tags.get(273)), tags.get(325, tags.get(279)), strict=True)]
        blocks = [zlib.decompress(b) for b in blocks] if packed != 1 else blocks
        if 324 in tags:
            w, h = tags[322][0], tags[323][0]
            across = -(-width // w)
            page = np.zeros((-(-height // h) * h, across * w), kind)
            for i, b in enumerate(blocks):
                y, x = i // across * h, i % across * w
                page[y : y + h, x : x + w] = np.frombuffer(b, kind, w * h).reshape(h, w)
            page = page[:height, :width]
        else:
            page = np.frombuffer(b"".join(blocks), kind, width * height).reshape(height, width)
        yield tags, page


def tiff_spacing(data: bytes) -> dict[str, float | str] | None:
    """Voxel spacing (z, y, x) and unit from a TIFF's first page: resolution tags, and the description's ``spacing`` and ``unit``; None where nothing is recorded."""
    tags, _ = next(tiff_pages(data))
    text = tags.get(270, [b""])[0].decode("latin-1", "replace")
    said = dict(line.split("=", 1) for line in text.replace("\0", "").splitlines() if "=" in line)
    out: dict[str, float | str] = {}
    for axis, tag in (("x", 282), ("y", 283)):
        if tag in tags and tags[tag][0]:
            out[axis] = tags[tag][1] / tags[tag][0]
    if "spacing" in said:
        out["z"] = float(said["spacing"])
    if out:
        out["unit"] = said.get("unit", {2: "inch", 3: "cm"}.get(tags.get(296, [1])[0], ""))
    return out or None


def zarr_chunk(meta: dict, data: bytes) -> np.ndarray:
    """One chunk of a version 2 array: plain, zlib, gzip or zstd."""
    packed = (meta.get("compressor") or {}).get("id")
    if meta.get("filters"):
        raise ValueError("filters aren't read")
    if packed in ("zlib", "gzip"):
        data = zlib.decompress(data, 47)
    elif packed == "zstd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    elif packed is not None:
        raise ValueError(f"the compressor {packed} isn't read")
    return np.frombuffer(data, np.dtype(meta["dtype"])).reshape(meta["chunks"], order=meta.get("order", "C"))


def chunk_place(name: str, meta: dict) -> tuple[int, ...] | None:
    """The chunk's place in the grid from its key, None for other files."""
    parts = name.replace("/", ".").split(".")
    n = len(meta["shape"])
    return tuple(map(int, parts)) if len(parts) == n and all(p.isdigit() for p in parts) else None


def voxel_rows(file: str, block: np.ndarray, first: tuple[int, ...], axes: tuple[str, ...], skip_zero: bool) -> Iterator[pd.DataFrame]:
    """Rows of a block plane by plane, its corner at ``first``."""
    if block.ndim != len(axes):
        raise ValueError(f"{file}: {block.ndim} axes, not {len(axes)}")
    at = np.indices(block.shape[1:]).reshape(block.ndim - 1, -1) + np.array(first[1:])[:, None]
    for plane in range(block.shape[0]):
        out = pd.DataFrame({"file": file, axes[0]: plane + first[0], **dict(zip(axes[1:], at, strict=True)), "value": block[plane].ravel().astype(float)})
        yield out[out["value"] != 0] if skip_zero else out


def blocks_of(file: str, data: bytes) -> Iterator[tuple[str, np.ndarray, tuple[int, ...]]]:
    """(name, block, corner) of a volume file: .npy, .npz, .tif, .tiff, .zarr.zip."""
    name = file.lower()
    if name.endswith(".npy"):
        v = np.load(io.BytesIO(data), allow_pickle=False)
        yield file, v, (0,) * v.ndim
    elif name.endswith(".npz"):
        with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
            for key in arrays.files:
                yield f"{file}#{key}", arrays[key], (0,) * arrays[key].ndim
    elif name.endswith((".tif", ".tiff")):
        for z, (_, page) in enumerate(tiff_pages(data)):
            yield file, page[None], (z, 0, 0)
    elif name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as members:
            names = members.namelist()
            for own in (n for n in names if n.rsplit("/", 1)[-1] == ".zarray"):
                folder, meta = own[: -len(".zarray")], json.loads(members.read(own))
                for n in names:
                    place = chunk_place(n[len(folder) :], meta) if n.startswith(folder) else None
                    if place is not None:
                        yield (f"{file}#{folder.rstrip('/')}".rstrip("#"), *placed_chunk(meta, members.read(n), place))
    else:
        raise ValueError(f"unknown kind of volume file: {file}")


def placed_chunk(meta: dict, data: bytes, place: tuple[int, ...]) -> tuple[np.ndarray, tuple[int, ...]]:
    """A chunk without what reaches over the array's end, and its corner."""
    corner = tuple(p * c for p, c in zip(place, meta["chunks"], strict=True))
    inside = tuple(slice(0, max(0, s - a)) for s, a in zip(meta["shape"], corner, strict=True))
    return zarr_chunk(meta, data)[inside], corner


def read_volumes(spark: SparkSession, path: str, axes: tuple[str, ...] = ("z", "y", "x"), skip_zero: bool = False) -> DataFrame:
    """Voxel rows (file, axes, value) of .npy, .npz, .tif, .tiff and .zarr.zip volumes: a task reads a file as one value, of 2 GB at most. Larger volumes are .zarr folders (``read_zarr``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                for name, block, corner in blocks_of(file, bytes(data)):
                    yield from voxel_rows(name, block, corner, axes, skip_zero)

    schema = f"file string, {', '.join(f'{a} int' for a in axes)}, value double"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_zarr(spark: SparkSession, path: str, axes: tuple[str, ...] = ("z", "y", "x"), skip_zero: bool = False) -> DataFrame:
    """Voxel rows (file, axes, value) of a version 2 .zarr folder, a row of work for each chunk file, so tasks share a volume of any size. Absent chunks have no rows: they hold the fill value."""
    head = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.zarray")  # a hidden file, which Spark's readers pass over
    stream = head.getFileSystem(spark._jsc.hadoopConfiguration()).open(head)
    meta = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                place = chunk_place(file.rsplit(".zarr/", 1)[-1], meta)
                if place is not None:
                    yield from voxel_rows(file, *placed_chunk(meta, bytes(data), place), axes, skip_zero)

    schema = f"file string, {', '.join(f'{a} int' for a in axes)}, value double"
    chunks = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*").load(path)
    return chunks.select("path", "content").mapInPandas(run, schema)


def read_splat_ply(spark: SparkSession, path: str) -> DataFrame:
    """Splats of point-cloud PLY files: center, scales (exp), opacity (logistic), quaternion, packed factor."""
    from ..functions import covariance

    names = ["x", "y", "z", "scale_0", "scale_1", "scale_2", "opacity", "rot_0", "rot_1", "rot_2", "rot_3"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                v = parse_ply(bytes(data))["vertex"]
                yield pd.DataFrame({"file": file, **{n: np.array(v[n], float) for n in names}})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, {', '.join(f'{n} double' for n in names)}")
    length = F.sqrt(sum((F.col(f"rot_{i}") * F.col(f"rot_{i}") for i in range(4)), F.lit(0.0)))
    q = [F.coalesce(F.col(f"rot_{i}") / F.nullif(length, F.lit(0.0)), F.lit(1.0 if i == 0 else 0.0)) for i in range(4)]
    chol = covariance.from_quaternion(*q, [F.exp(F.col(f"scale_{i}")) for i in range(3)])
    return raw.select("file", F.array("x", "y", "z").alias("center"), (1 / (1 + F.exp(-F.col("opacity")))).alias("opacity"), chol.alias("chol"))


def write_splat_ply(rows: list[dict]) -> bytes:
    """A binary PLY of few rows (dicts of equal float fields), for exchange."""
    names = list(rows[0]) if rows else ["x", "y", "z"]
    head = "ply\nformat binary_little_endian 1.0\nelement vertex %d\n%send_header\n" % (len(rows), "".join(f"property float {n}\n" for n in names))
    return head.encode() + np.array([[r[n] for n in names] for r in rows], "<f4").tobytes()


def tracking_graph(nodes: DataFrame, edges: DataFrame, scale: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes in world units (voxel size by axis), and the edges whose ends exist."""
    from ..operators import graph

    scaled = nodes.withColumns({a: F.col(a) * s for a, s in (scale or {}).items()})
    return scaled, graph.present(edges, nodes)
