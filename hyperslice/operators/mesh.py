"""Triangle meshes as vertex and face DataFrames; faces are (a, b, c) of vertex ids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import ranked


def weld(vertices: DataFrame, faces: DataFrame, key: str, attributes: Sequence[str], digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Vertices equal in all attributes to so many digits become one, the least id with its full precision; faces follow."""
    rounded = [F.round(F.col(a), digits) + 0.0 for a in attributes]  # + 0.0: no negative zero
    marked = vertices.withColumn("__own", F.min(key).over(Window.partitionBy(*rounded)))
    survivors = marked.filter(F.col(key) == F.col("__own")).drop("__own")
    to = marked.select(F.col(key).alias("__v"), "__own")
    for c in ("a", "b", "c"):
        faces = faces.join(to, faces[c] == to["__v"]).withColumn(c, F.col("__own")).drop("__v", "__own")
    return survivors, faces


def drop_degenerate(faces: DataFrame) -> DataFrame:
    return faces.filter("a <> b AND b <> c AND a <> c")


def referenced(faces: DataFrame) -> DataFrame:
    """Distinct vertex ids that faces name."""
    return faces.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct()


def prune_vertices(vertices: DataFrame, faces: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Vertices that faces name, renumbered from 0 in their order, and faces with the new numbers."""
    used = vertices.join(referenced(faces), vertices[key] == F.col("v"), "left_semi")
    numbered = ranked(used, [F.col(key)], "__n").withColumn("__n", F.col("__n") - 1)
    to = numbered.select(F.col(key).alias("__v"), "__n")
    for c in ("a", "b", "c"):
        faces = faces.join(to, faces[c] == to["__v"]).withColumn(c, F.col("__n")).drop("__v", "__n")
    return numbered.withColumn(key, F.col("__n")).drop("__n"), faces


def split_parts(faces: DataFrame, part: str) -> DataFrame:
    """(part, a, b, c, source_*): faces renumbered densely within their part."""
    corners = faces.select(part, F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    local = corners.withColumn("n", F.row_number().over(Window.partitionBy(part).orderBy("v")) - 1)
    for c in ("a", "b", "c"):
        faces = faces.withColumn(f"source_{c}", F.col(c))
        at = local.select(F.col(part).alias("__p"), F.col("v").alias("__v"), F.col("n").alias("__n"))
        faces = faces.join(at, (faces[part] == at["__p"]) & (faces[c] == at["__v"])).withColumn(c, F.col("__n")).drop("__p", "__v", "__n")
    return faces


def duplication(faces: DataFrame, part: str) -> DataFrame:
    """One row: gathered over distinct referenced vertices; 1 where nothing is gathered."""
    corners = faces.select(part, F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    return corners.agg(F.coalesce(F.count("*") / F.nullif(F.count_distinct("v"), F.lit(0)), F.lit(1.0)).alias("factor"))


def with_corners(faces: DataFrame, vertices: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Faces with the columns of their three vertices, prefixed a_, b_, c_; faces that name an absent vertex go."""
    for c in ("a", "b", "c"):
        v = vertices.select(F.col(key).alias("__v"), *[F.col(x).alias(f"{c}_{x}") for x in columns])
        faces = faces.join(v, faces[c] == v["__v"]).drop("__v")
    return faces


def centroids(faces: DataFrame, vertices: DataFrame, key: str, axes: Sequence[str]) -> DataFrame:
    joined = with_corners(faces, vertices, key, axes)
    return joined.withColumns({f"center_{x}": (F.col(f"a_{x}") + F.col(f"b_{x}") + F.col(f"c_{x}")) / 3 for x in axes}).drop(*[f"{p}_{x}" for p in "abc" for x in axes])


def visible_faces(faces: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """Faces all of whose vertices are visible; nothing is clipped."""
    for c in ("a", "b", "c"):
        faces = faces.join(visible, faces[c] == visible[key], "left_semi")
    return faces


def fan(polygons: DataFrame, corners: str = "corners") -> DataFrame:
    """Polygons (arrays of vertex ids) to triangles around their first vertex; fewer than three corners give none."""
    p = F.col(corners)
    step = F.when(F.size(p) >= 3, F.sequence(F.lit(1), F.size(p) - 2)).otherwise(F.array().cast("array<int>"))
    return polygons.withColumn("__i", F.explode(step)).select(*[c for c in polygons.columns if c != corners], p[0].alias("a"), p[F.col("__i")].alias("b"), p[F.col("__i") + 1].alias("c"))


def icosphere(spark: SparkSession, subdivisions: int = 1) -> tuple[DataFrame, DataFrame]:
    """A closed sphere: (id, x, y, z) and faces. 20 * 4^n faces, generated on the driver for small n."""
    t = (1 + math.sqrt(5)) / 2
    raw = [(-1, t, 0), (1, t, 0), (-1, -t, 0), (1, -t, 0), (0, -1, t), (0, 1, t), (0, -1, -t), (0, 1, -t), (t, 0, -1), (t, 0, 1), (-t, 0, -1), (-t, 0, 1)]
    points = [tuple(c / math.sqrt(1 + t * t) for c in p) for p in raw]
    near = [[j for j in range(12) if i != j and sum((a - b) ** 2 for a, b in zip(points[i], points[j], strict=True)) < 1.2] for i in range(12)]
    tris = []
    for i in range(12):
        for j in near[i]:
            for k in near[i]:
                if i < j < k and k in near[j]:
                    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = points[i], points[j], points[k]
                    det = ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)
                    tris.append((i, j, k) if det > 0 else (i, k, j))
    for _ in range(subdivisions):
        middle: dict[tuple[int, int], int] = {}

        def mid(i: int, j: int, middle: dict = middle) -> int:
            edge = (min(i, j), max(i, j))
            if edge not in middle:
                m = [(a + b) / 2 for a, b in zip(points[i], points[j], strict=True)]
                length = math.sqrt(sum(c * c for c in m))
                middle[edge] = len(points)
                points.append(tuple(c / length for c in m))
            return middle[edge]

        tris = [f for a, b, c in tris for ab, bc, ca in [(mid(a, b), mid(b, c), mid(c, a))] for f in ((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca))]
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")
    return vertices, spark.createDataFrame(tris, "a long, b long, c long")
