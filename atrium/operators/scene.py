"""Scene graph and layout compositions keyed by level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions import text
from atrium.operators import aggregates, layout, mesh, raster, rooms
from atrium.operators.grids import RESOLUTION

MIN_AREA = 1e-10


def ceiling_candidate_table(triangles: DataFrame, vertices: DataFrame, planes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plane (unit length), mean height and area of each polygon that has an area."""
    poly = [*keys, "polygon_id"]
    area = mesh.with_area_normal(mesh.corners(triangles, vertices, keys)).groupBy(*poly).agg(F.sum("area").alias("area_square_meters"))
    height = rooms.polygon_elevation(triangles, vertices, keys)
    length = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    unit = planes.withColumn("_l", length).filter("_l > 1e-12").select(*poly, *((F.col(k) / F.nullif("_l", F.lit(0.0))).alias(k) for k in "abcd"))
    out = unit.join(height, poly).join(area, poly).filter(F.col("area_square_meters") > MIN_AREA)
    return out.select(*poly, "a", "b", "c", "d", F.col("elevation").alias("mean_elevation_meters"), "area_square_meters")


def level_summary(polygons: DataFrame, keys: Sequence[str], floor_override: float | None = None) -> DataFrame:
    """Floor and ceiling height of each level from its polygons (class, elevation, area)."""
    w = F.greatest(F.col("area"), F.lit(1e-6))
    mean = lambda name: F.sum(F.when(F.col("class") == name, w * F.col("elevation"))) / F.sum(F.when(F.col("class") == name, w))
    out = polygons.groupBy(*keys).agg(
        mean("floor").alias("floor_height"), mean("ceiling").alias("ceiling_height"),
        F.sort_array(F.collect_set(F.when(F.col("class") == "floor", F.col("elevation")))).alias("floor_heights"))
    if floor_override is not None:
        out = out.withColumn("floor_height", F.lit(float(floor_override)))
    return out.withColumn("ceiling_height", F.coalesce("ceiling_height", F.col("floor_height") + rooms.LEVEL_HEIGHT))


def normalize_polygons(info: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contour rows of polygons given as nested vertex lists and keep masks.

    A vertex stays if its mask says so or if it lies on more than one outer contour (contour 0).
    """
    rows = info.select(*keys, "polygon_id", F.posexplode(F.arrays_zip("contours", "masks")).alias("contour", "z")).select(
        *keys, "polygon_id", "contour", F.posexplode(F.arrays_zip(F.col("z.contours").alias("vertex_id"), F.col("z.masks").alias("keep"))).alias("pos", "v")).select(
        *keys, "polygon_id", "contour", "pos", "v.vertex_id", "v.keep")
    shared = rows.filter("contour = 0").select(*keys, "vertex_id", "polygon_id").distinct().groupBy(*keys, "vertex_id").agg(
        F.count("*").alias("_n")).filter("_n > 1")
    return rows.join(shared, [*keys, "vertex_id"], "left").filter("keep OR _n > 1").drop("_n", "keep")


def scene_graph(cells: DataFrame, keys: Sequence[str], resolution: float = RESOLUTION) -> tuple[DataFrame, DataFrame]:
    """Room nodes and door/opening edges of labelled floorplan cells."""
    stats = raster.room_stats(cells, keys, resolution)
    name = lambda label: text.room_id(F.col(keys[-1]), F.col(label))
    nodes = stats.withColumn("room_id", name("label"))
    edges = raster.opening_edges(cells, keys, resolution=resolution, known=stats.select(*keys, "label"))
    return nodes, edges.withColumn("room_ids", F.array(name("label_a"), name("label_b")))


def layout_export(cells: DataFrame, candidates: DataFrame, candidate_edges: DataFrame, keys: Sequence[str], floor_z: float,
                  ceiling_z: float, resolution: float = RESOLUTION, windows: DataFrame | None = None, stairs: DataFrame | None = None) -> DataFrame:
    """All entities of a level: shells, walls with openings, ceiling steps, doors, windows, stairs."""
    fallback = ceiling_z if ceiling_z > floor_z else floor_z + 2.7
    assigned = layout.assigned_rooms(cells, candidates, candidate_edges, keys, floor_z, fallback, resolution)
    _, openings = scene_graph(cells, keys, resolution)
    name = text.room_id(F.col(keys[-1]), F.col("label"))
    edges = layout.room_edges(assigned, keys, "label", resolution)
    parts = [
        layout.shell_entities(assigned, name, floor_z, resolution, keys=keys),
        layout.boundary_walls(edges, openings, name, floor_z, keys),
        layout.ceiling_step_walls(edges, name, keys),
        layout.door_entities(openings, floor_z, keys),
    ]
    parts += [layout.window_entities(windows, keys)] if windows is not None else []
    parts += [layout.stair_entities(stairs, keys)] if stairs is not None else []
    return layout.union_entities(*parts)


def validate_layout(entities: DataFrame, rooms_known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All-of checks of a layout: entities exist, faces have corners, rooms are known."""
    known = rooms_known.select(*keys, "room_id", F.lit(True).alias("_known"))
    e = entities.join(known, [*keys, "room_id"], "left")
    finite = F.forall("vertices", lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & ~F.isnan(p["z"]))
    return aggregates.validation(e, keys, {
        "faces_have_corners": F.size("vertices") >= 3, "vertices_finite": finite,
        "rooms_known": F.col("room_id").isNull() | F.col("_known")})
