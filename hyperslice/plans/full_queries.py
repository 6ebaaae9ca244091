"""Splats of full covariance over part: three axes whose factor has all six elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import Dimension, View
from ..operators import full
from .registry import query
from .splat_queries import SPLATS, splats

#: The factor: sx; 0.3, sy; -0.2, 0.4, sz. Sigma follows in closed form.
_S = f"""(SELECT *, sx * sx AS s00, 0.3e0 * sx AS s10, 0.09e0 + sy * sy AS s11, -0.2e0 * sx AS s20, -0.06e0 + 0.4e0 * sy AS s21, 0.04e0 + 0.16e0 + sz * sz AS s22 FROM {SPLATS})"""


def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.array("sx", F.lit(0.3), "sy", F.lit(-0.2), F.lit(0.4), "sz")
    return splats(spark, sf_dir).select("id", "brand", "amp", F.array("x", "y", "z").alias("center"), factor.alias("chol"))


@query(
    f"""SELECT id, round(amp * w, 6) AS amp, round(x + s20 / s22 * g, 6) AS x, round(y + s21 / s22 * g, 6) AS y, round(sqrt(s00 - s20 * s20 / s22), 6) AS l00
    FROM (SELECT *, 13.0e0 - z AS g, exp(-(13.0e0 - z) * (13.0e0 - z) / s22 / 2) AS w FROM {_S}) WHERE amp * w >= 1e-6"""
)
def conditional_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = View((Dimension("x", display=True), Dimension("y", display=True), Dimension("z", spatial=True)), {"z": 13.0})
    out = full.conditional_slice(correlated(spark, sf_dir), view)
    c, l = F.col("center"), F.col("chol")
    return out.select("id", F.round("amp", 6).alias("amp"), F.round(c[0], 6).alias("x"), F.round(c[1], 6).alias("y"), F.round(l[0], 6).alias("l00"))


@query(
    f"""WITH s AS (SELECT *, amp * sx * sy * sz AS m FROM {_S}), g AS (SELECT brand, count(*) AS n, sum(m) AS mass, sum(m * x) / sum(m) AS x, sum(m * y) / sum(m) AS y, sum(m * (s00 + x * x)) / sum(m) AS q00, sum(m * (s10 + x * y)) / sum(m) AS q10 FROM s GROUP BY brand)
    SELECT brand, n, round(mass / 1e3, 6) AS mass, round(x, 6) AS x, round(sqrt(q00 - x * x), 6) AS l00, round((q10 - x * y) / sqrt(q00 - x * x), 6) AS l10 FROM g"""
)
def moment_match_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = full.merge_bins(correlated(spark, sf_dir), "brand", 3)
    return out.select("brand", "n", F.round(F.col("mass") / 1e3, 6).alias("mass"), F.round(F.col("center")[0], 6).alias("x"), F.round(F.col("chol")[0], 6).alias("l00"), F.round(F.col("chol")[1], 6).alias("l10"))


_T = "(a.s00 + b.s00) * (a.s11 + b.s11) - (a.s10 + b.s10) * (a.s10 + b.s10)"


@query(
    f"""WITH s AS {_S}, p AS (SELECT a.amp * b.amp * 2 * pi() * a.sx * a.sy * b.sx * b.sy / sqrt({_T}) AS k,
    ((a.x - b.x) * (a.x - b.x) * (a.s11 + b.s11) - 2 * (a.x - b.x) * (a.y - b.y) * (a.s10 + b.s10) + (a.y - b.y) * (a.y - b.y) * (a.s00 + b.s00)) / ({_T}) AS d2 FROM s a, s b)
    SELECT round(sum(k * exp(-d2 / 2)) / 1e9, 6) AS inner_product FROM p"""
)
def inner_product_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair in the SQL, over the first two axes; here those that can add anything."""
    s = correlated(spark, sf_dir)
    plane = s.select("amp", F.slice("center", 1, 2).alias("center"), F.slice("chol", 1, 3).alias("chol"))
    return full.inner_product(plane, plane, 2).select(F.round(F.col("inner") / 1e9, 6).alias("inner_product"))


@query(
    f"""WITH v AS (SELECT i AS v0, j AS v1, sum(amp * exp(-d2 / 2)) AS value FROM (
      SELECT i, j, amp, ((i - x) * (i - x) * s11 - 2 * (i - x) * (j - y) * s10 + (j - y) * (j - y) * s00) / (s00 * s11 - s10 * s10) AS d2
      FROM {_S}, (SELECT unnest(range(0, 40)) AS i), (SELECT unnest(range(0, 40)) AS j)) WHERE d2 <= 9.0e0 GROUP BY 1, 2)
    SELECT v0::INT AS v0, v1::INT AS v1, round(value, 4) AS value FROM v WHERE abs(value) >= 1e-5"""
)
def render_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = correlated(spark, sf_dir).select("amp", F.slice("center", 1, 2).alias("center"), F.slice("chol", 1, 3).alias("chol"))
    return full.render(s, (40, 40)).select("v0", "v1", F.round("value", 4).alias("value"))
