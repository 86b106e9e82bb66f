"""One-pass quality figures of a mesh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.operators.mesh import corner_rows, corners, with_area_normal

MIN_VERTICES = MIN_TRIANGLES = 100_000


def finite(name: str):
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def mesh_quality(vertices: DataFrame, triangles: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    v = vertices.groupBy(*keys).agg(F.count("*").alias("n_vertices"), F.every(finite("x") & finite("y") & finite("z")).alias("finite"))
    proper = (F.col("v0") != F.col("v1")) & (F.col("v1") != F.col("v2")) & (F.col("v0") != F.col("v2"))
    t = with_area_normal(corners(triangles, vertices, keys)).groupBy(*keys).agg(
        F.count("*").alias("n_triangles"), F.sum("area").alias("area"), F.every(proper).alias("proper"))
    known = vertices.select(*keys, "vertex_id", F.lit(1).alias("_known"))
    m = corner_rows(triangles, keys).join(known, [*keys, "vertex_id"], "left").groupBy(*keys).agg(
        F.count_if(F.col("_known").isNull()).alias("missing"))
    out = v.join(t, list(keys), "left").join(m, list(keys), "left")
    return out.withColumn("large_enough", (F.col("n_vertices") >= MIN_VERTICES) & (F.col("n_triangles") >= MIN_TRIANGLES))
