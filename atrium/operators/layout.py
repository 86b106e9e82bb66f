"""Layout entities: room shells, walls, openings, doors, windows, stairs and their meshes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions import text
from atrium.functions.vectors import plane, plane_z
from atrium.operators import matching, mesh, raster
from atrium.operators.grids import RESOLUTION
from atrium.operators.ranking import dense_index, prefix_counts
from atrium.session import end_round as cut_lineage

LEVEL = ("level_id",)

# Sizes of doors and openings in metres.
DOOR_HEIGHT, OPENING_HEIGHT, DOOR_THICKNESS = 2.10, 2.35, 0.08
STEP, MIN_SPAN, FLOOR_CLEARANCE = 1e-4, 1e-6, 1e-4
ENTITY_COLORS = {"wall": (210, 68, 68), "floor": (80, 185, 105), "ceiling": (90, 150, 230), "door": (150, 105, 70), "window": (75, 205, 215), "stairs": (245, 105, 30)}
CORNER = 1 << 24


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def corner_x(v: Column, resolution: float, origin_x: float) -> Column:
    return F.pmod(v, F.lit(CORNER)) * resolution + origin_x


def corner_y(v: Column, resolution: float, origin_y: float) -> Column:
    return F.floor(v / CORNER) * resolution + origin_y


def room_triangles(cells: DataFrame, keys: Sequence[str] = LEVEL, label: str = "label", resolution: float = RESOLUTION, origin=(0.0, 0.0)) -> DataFrame:
    """Triangles of each room over integer grid corners ``v0..v2``, numbered per room.

    Columns: keys, label, triangle_id, v0, v1, v2 and the planar centroid x, y.
    """
    tri = raster.run_triangles(raster.cell_runs(cells, keys, label), keys, label, 1.0)
    ident = F.col("r").cast("bigint") * F.lit(CORNER * 2) + F.col("ca").cast("bigint") * 2 + F.col("half")
    corner = lambda n: (F.col(f"{n}y").cast("bigint") * CORNER + F.col(f"{n}x").cast("bigint"))
    tri = tri.select(*keys, label, ident.alias("_id"), *(corner(n).alias(f"v{i}") for i, n in enumerate("abc")),
                     ((F.col("ax") + F.col("bx") + F.col("cx")) / 3 * resolution + origin[0]).alias("x"),
                     ((F.col("ay") + F.col("by") + F.col("cy")) / 3 * resolution + origin[1]).alias("y"))
    number = dense_index(tri, "_id", "triangle_id", [*keys, label], bits=64)
    return tri.join(number, [*keys, label, "_id"]).drop("_id")


def propagate_ceilings(triangles: DataFrame, neighbors: DataFrame, keys: Sequence[str], floor_z: float) -> DataFrame:
    """Triangles on the fallback take the lowest valid plane among their neighbours, round by round.

    ``triangles``: keys, triangle_id, x, y, polygon_id, is_fallback, a..d, ceiling_z.  Rounds are
    synchronous; planes that do not clear the floor at the triangle's centroid are not taken.  Rooms
    without a fallback or without a plane do not change and take no part in the rounds.
    """
    on = [*keys, "triangle_id"]
    triangles = cut_lineage(triangles)
    mixed = triangles.groupBy(*keys).agg(F.bool_or("is_fallback").alias("_open"), F.bool_and("is_fallback").alias("_bare")).filter("_open AND NOT _bare").select(*keys)
    mixed = cut_lineage(mixed)
    settled = triangles.join(mixed, list(keys), "left_anti").select(*triangles.columns)
    state = cut_lineage(triangles.join(mixed, list(keys), "left_semi").select(*triangles.columns))
    neighbors = cut_lineage(neighbors.join(mixed, list(keys), "left_semi"))
    eq = F.struct("polygon_id", "a", "b", "c", "d")
    while True:
        open_ = state.filter("is_fallback").select(*on, "x", "y")
        if open_.isEmpty():
            return settled.unionByName(state)
        donors = state.filter("NOT is_fallback").select(*keys, F.col("triangle_id").alias("neighbor_id"), eq.alias("eq"))
        offers = open_.join(neighbors, on).join(donors, [*keys, "neighbor_id"]).select(*on, "x", "y", "eq.*")
        offers = offers.withColumn("z", plane_z(plane(), F.col("x"), F.col("y"))).filter(F.col("z") > floor_z + FLOOR_CLEARANCE)
        best = cut_lineage(offers.groupBy(*on).agg(F.min(F.struct("z", "polygon_id", "a", "b", "c", "d")).alias("h")))
        if best.isEmpty():
            return settled.unionByName(state)
        joined = state.join(best, on, "left")
        got = F.col("h").isNotNull()
        new = {n: F.when(got, F.col(f"h.{m}")).otherwise(F.col(n)) for n, m in (("polygon_id", "polygon_id"), ("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("ceiling_z", "z"))}
        state = cut_lineage(joined.withColumns({**new, "is_fallback": F.col("is_fallback") & ~got}).drop("h").select(*state.columns))


def assigned_rooms(cells: DataFrame, candidates: DataFrame, edges: DataFrame, keys: Sequence[str], floor_z: float, fallback_z: float,
                   resolution: float = RESOLUTION, origin=(0.0, 0.0), label: str = "label", allowed: DataFrame | None = None) -> DataFrame:
    """Room triangles with their ceiling plane, fallbacks resolved from neighbours where possible."""
    tri = cut_lineage(room_triangles(cells, keys, label, resolution, origin))
    room = [*keys, label]
    placed = matching.assign_ceiling(tri, candidates, edges, keys, [label, "triangle_id"], floor_z, fallback_z, allowed)
    return propagate_ceilings(placed, mesh.triangle_neighbors(tri, room), room, floor_z)


def shell_entities(rooms: DataFrame, room_id: Column, floor_z: float, resolution: float, origin=(0.0, 0.0), keys: Sequence[str] = LEVEL) -> DataFrame:
    """Floor (turned over) and ceiling triangles of each room triangle."""
    xs = [corner_x(F.col(f"v{i}"), resolution, origin[0]) for i in range(3)]
    ys = [corner_y(F.col(f"v{i}"), resolution, origin[1]) for i in range(3)]
    floor = [point(x, y, F.lit(float(floor_z))) for x, y in zip(xs, ys)]
    top = [point(x, y, plane_z(plane(), x, y)) for x, y in zip(xs, ys)]
    base = rooms.withColumn("room_id", room_id)
    rows = F.array(
        F.struct(F.lit("floor").alias("class"), F.array(floor[0], floor[2], floor[1]).alias("vertices")),
        F.struct(F.lit("ceiling").alias("class"), F.array(*top).alias("vertices")))
    return base.select(*keys, "room_id", "polygon_id", "is_fallback", "triangle_id", F.explode(rows).alias("e")).select(
        *keys, F.concat_ws(":", "room_id", "e.class", F.col("triangle_id").cast("string")).alias("entity_id"),
        F.col("e.class").alias("class"), "room_id", F.col("e.vertices").alias("vertices"), "polygon_id", "is_fallback")


def room_edges(rooms: DataFrame, keys: Sequence[str], label: str, resolution: float, origin=(0.0, 0.0)) -> DataFrame:
    """Edges of the room triangles with the planes of the one or two triangles on them."""
    room = [*keys, label]
    rows = mesh.edge_rows(rooms, room, ["polygon_id", "a", "b", "c", "d"])
    side = F.struct("triangle_id", "polygon_id", "a", "b", "c", "d")
    # an edge of a planar triangulation has at most two triangles
    edges = rows.groupBy(*room, "e0", "e1").agg(F.count("*").alias("uses"), F.min(side).alias("first"), F.max(side).alias("second"))
    coords = {f"{c}{i}": f(F.col(f"e{i}"), resolution, o) for i in (0, 1) for c, f, o in (("x", corner_x, origin[0]), ("y", corner_y, origin[1]))}
    edges = edges.withColumns(coords)
    number = dense_index(edges.withColumn("_k", F.col("e0") * 4 + F.when(F.col("e1") - F.col("e0") < CORNER, 0).when(F.col("e1") % CORNER == F.col("e0") % CORNER, 1).otherwise(2)), "_k", "edge_index", room, bits=64)
    keyed = edges.withColumn("_k", F.col("e0") * 4 + F.when(F.col("e1") - F.col("e0") < CORNER, 0).when(F.col("e1") % CORNER == F.col("e0") % CORNER, 1).otherwise(2))
    return keyed.join(number, [*room, "_k"]).drop("_k")


def height_on(side: str, end: int) -> Column:
    x, y = F.col(f"x{end}"), F.col(f"y{end}")
    return -(F.col(f"{side}.a") * x + F.col(f"{side}.b") * y + F.col(f"{side}.d")) / F.col(f"{side}.c")


def boundary_walls(edges: DataFrame, openings: DataFrame, room_id: Column, floor_z: float, keys: Sequence[str] = LEVEL, label: str = "label") -> DataFrame:
    """Walls on edges used once: full height, or only the lintel above a matching door or opening."""
    rim = edges.filter("uses = 1").withColumns({"room_id": room_id, "t0": height_on("first", 0), "t1": height_on("first", 1)})
    tolerance = max(0.10, 2 * DOOR_THICKNESS)
    rim = matching.match_opening(rim, openings, keys, [label, "edge_index"], tolerance)
    height = F.when(F.col("kind") == "door", DOOR_HEIGHT).otherwise(OPENING_HEIGHT)
    bottom = F.when(F.col("edge_id").isNull(), F.lit(float(floor_z))).otherwise(F.least(F.lit(float(floor_z)) + height, F.col("t0"), F.col("t1")))
    rim = rim.withColumn("bottom", bottom).filter(F.greatest("t0", "t1") > F.col("bottom") + MIN_SPAN)
    plain, above = text.wall_id(F.col("room_id"), F.col("edge_index")), text.wall_id(F.col("room_id"), F.col("edge_index"), F.col("edge_id"))
    return rim.select(
        *keys, F.when(F.col("edge_id").isNull(), plain).otherwise(above).alias("entity_id"), F.lit("wall").alias("class"), "room_id",
        F.array(point(F.col("x0"), F.col("y0"), F.col("bottom")), point(F.col("x1"), F.col("y1"), F.col("bottom")),
                point(F.col("x1"), F.col("y1"), F.col("t1")), point(F.col("x0"), F.col("y0"), F.col("t0"))).alias("vertices"),
        F.col("first.polygon_id").alias("polygon_id"), F.col("edge_id").alias("source_edge_id"))


def ceiling_step_walls(edges: DataFrame, room_id: Column, keys: Sequence[str] = LEVEL) -> DataFrame:
    """Vertical quads on inner edges where the two ceilings differ in height."""
    step = edges.filter("uses = 2").withColumns({
        "room_id": room_id, "a0": height_on("first", 0), "a1": height_on("first", 1), "b0": height_on("second", 0), "b1": height_on("second", 1)})
    step = step.filter(F.greatest(F.abs(F.col("a0") - F.col("b0")), F.abs(F.col("a1") - F.col("b1"))) > STEP)
    return step.select(
        *keys, F.concat(text.wall_id(F.col("room_id"), F.col("edge_index")), F.lit(":ceiling_discontinuity")).alias("entity_id"),
        F.lit("wall").alias("class"), "room_id",
        F.array(point(F.col("x0"), F.col("y0"), F.col("a0")), point(F.col("x1"), F.col("y1"), F.col("a1")),
                point(F.col("x1"), F.col("y1"), F.col("b1")), point(F.col("x0"), F.col("y0"), F.col("b0"))).alias("vertices"),
        F.array("first.polygon_id", "second.polygon_id").alias("ceiling_polygon_ids"))


def door_entities(openings: DataFrame, floor_z: float, keys: Sequence[str] = LEVEL) -> DataFrame:
    """Door frames: four faces around the opening line, one row per face."""
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    d = openings.filter("kind = 'door'").withColumn("_l", F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-12)))
    d = d.withColumns({"_nx": -dy / F.col("_l") * (DOOR_THICKNESS / 2), "_ny": dx / F.col("_l") * (DOOR_THICKNESS / 2)})
    corner = [(F.col(f"x{e}") + s * F.col("_nx"), F.col(f"y{e}") + s * F.col("_ny")) for e, s in (("a", -1), ("b", -1), ("b", 1), ("a", 1))]
    low, high = F.lit(float(floor_z)), F.lit(float(floor_z) + DOOR_HEIGHT)
    faces = [F.array(point(*corner[i], low), point(*corner[(i + 1) % 4], low), point(*corner[(i + 1) % 4], high), point(*corner[i], high)) for i in range(4)]
    return d.select(*keys, F.concat(F.lit("door:"), F.col("edge_id")).alias("entity_id"), F.lit("door").alias("class"), "room_ids",
                    "width_meters", F.posexplode(F.array(*faces)).alias("face", "vertices"))


def window_entities(windows: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    return windows.select(*keys, F.col("window_id").alias("entity_id"), F.lit("window").alias("class"), "room_ids", "vertices",
                          "width_meters", "height_meters")


def stair_entities(stairs: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    """Stair rectangles laid flat at their lowest height."""
    flat = F.transform("rectangle", lambda p: point(p[0], p[1], F.col("minimum_z")))
    return stairs.select(*keys, F.col("stair_region_id").alias("entity_id"), F.lit("stairs").alias("class"), "room_ids", flat.alias("vertices"))


def union_entities(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def entity_counts(entities: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    return entities.groupBy(*keys, "class").agg(F.countDistinct("entity_id").alias("n_entities"), F.sum(F.size("vertices") - 2).alias("n_triangles"))


def mesh_concat(parts: DataFrame, part: str, n_vertices: str, keys: Sequence[str] = ()) -> DataFrame:
    """First vertex number of each part of a concatenated mesh."""
    return prefix_counts(parts.select(*keys, part, F.col(n_vertices).cast("bigint").alias(n_vertices)), part, n_vertices, "offset", keys)


def class_mesh(entities: DataFrame, keys: Sequence[str] = LEVEL, classes: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Unindexed mesh per class: vertex rows and triangle rows, three new vertices per triangle.

    Quads and larger faces are fanned from their first corner.  Triangles are numbered per class in
    the order of a 48-bit hash of the entity and face, which needs no global sort.
    """
    picked = entities if classes is None else entities.filter(F.col("class").isin(*classes))
    group = [*keys, "class"]
    fan = F.transform(F.sequence(F.lit(1), F.size("vertices") - 2), lambda i: F.array(F.col("vertices")[0], F.get("vertices", i), F.get("vertices", i + 1)))
    face = F.coalesce(F.col("face"), F.lit(0)) if "face" in picked.columns else F.lit(0)
    tri = picked.select(*group, "entity_id", face.alias("face"), F.posexplode(fan).alias("slot", "corners"))
    code = F.conv(F.substring(F.md5(F.concat_ws("|", "entity_id", "face", "slot")), 1, 12), 16, 10).cast("bigint")
    tri = tri.withColumn("_code", code)
    # equal codes are told apart by counting them, in the rare case that there are any
    counts = tri.groupBy(*group, "_code").agg(F.count("*").alias("_n"))
    offsets = prefix_counts(counts, "_code", "_n", "_offset", group)
    from pyspark.sql import Window as W

    inside = F.row_number().over(W.partitionBy(*group, "_code").orderBy("entity_id", "face", "slot")) - 1
    tri = tri.withColumn("_i", inside).join(offsets.select(*group, "_code", "_offset"), [*group, "_code"])
    tri = tri.withColumn("triangle_id", F.col("_offset") + F.col("_i")).drop("_code", "_offset", "_i")
    vertices = tri.select(*group, "triangle_id", F.posexplode("corners").alias("corner", "p")).select(
        *group, (F.col("triangle_id") * 3 + F.col("corner")).alias("vertex_id"), "p.x", "p.y", "p.z")
    faces = tri.select(*group, "triangle_id", *((F.col("triangle_id") * 3 + i).alias(f"v{i}") for i in range(3)), "entity_id")
    return vertices, faces
