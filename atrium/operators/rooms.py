"""Polygon heights, level summaries, walls, windows and openings of a scene graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions.labels import LAYOUT_LABELS
from atrium.operators.mesh import corner_rows

# Metres and degrees used when rooms are derived.
LEVEL_HEIGHT = 2.5
MIN_CLEARANCE = 1.0
MAX_TILT = 10.0
WALL_BAND = 0.35


def polygon_elevation(triangles: DataFrame, vertices: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Mean height over the distinct vertices of each polygon."""
    used = corner_rows(triangles, keys, ["polygon_id"]).select(*keys, "polygon_id", "vertex_id").distinct()
    return used.join(vertices.select(*keys, "vertex_id", "z"), [*keys, "vertex_id"]).groupBy(*keys, "polygon_id").agg(
        F.avg("z").alias("elevation"), F.count("*").alias("n_vertices"))


def polygon_height_interval(triangles: DataFrame, vertices: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    used = corner_rows(triangles, keys, ["polygon_id"])
    return used.join(vertices.select(*keys, "vertex_id", "z"), [*keys, "vertex_id"]).groupBy(*keys, "polygon_id").agg(
        F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def overlaps(z_min: Column, z_max: Column, low, high) -> Column:
    return (z_min <= high) & (z_max >= low)


def select_walls(wall_cells: DataFrame, footprint: DataFrame, floor_z: float, ceiling_z: float, keys: Sequence[str]) -> DataFrame:
    """Walls whose height interval meets the level and which stand on a footprint cell."""
    tall = wall_cells.filter(overlaps(F.col("z_min"), F.col("z_max"), floor_z, ceiling_z))
    return tall.join(footprint, [*keys, "r", "c"], "left_semi").select(*keys, "wall_id").distinct()


def ceiling_clearance(elevation: Column, floor_z: Column) -> Column:
    return elevation - floor_z >= MIN_CLEARANCE


def height_band(points: DataFrame, floor_z: float, ceiling_z: float, labels: Sequence[int]) -> DataFrame:
    return points.filter(F.col("label").isin(*labels) & F.col("z").between(floor_z, ceiling_z))


def drop_ray_classes(rays: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop rays with one of the named labels."""
    return rays.filter(~F.col("label").isin(*(LAYOUT_LABELS.index(n) for n in names)))


def mask_by_orientation(df: DataFrame, up_dot: Column) -> DataFrame:
    """Zero class probabilities a plane's orientation rules out: walls upright, floors up, ceilings down."""
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up_dot))))
    d = df.withColumn("_angle", angle)
    keep = lambda ok, name: F.when(ok, F.col(name)).otherwise(F.lit(0.0))
    return d.withColumns({
        "wall": keep(F.abs(90 - F.col("_angle")) <= MAX_TILT, "wall"),
        "floor": keep(F.col("_angle") <= MAX_TILT, "floor"),
        "ceiling": keep(180 - F.col("_angle") <= MAX_TILT, "ceiling"),
    }).drop("_angle")


def cluster_extent(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("u").alias("u_min"), F.max("u").alias("u_max"), F.min("z").alias("z_min"),
        F.max("z").alias("z_max"), (F.max("u") - F.min("u")).alias("width"), (F.max("z") - F.min("z")).alias("height"))
