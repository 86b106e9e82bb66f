"""Joins between entities: ceilings over points, rooms near stairs and windows, openings on walls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions.vectors import Vec, plane, plane_z, segment_distance2
from atrium.operators import spatial as S
from atrium.operators.polygons import points_in_polygons
from atrium.operators.ranking import top_k

# Distances in metres.
FLOOR_CLEARANCE = 1e-4
BOUNDARY = 1e-8
STAIR_DISTANCE = 0.75
WALL_DISTANCE = 0.35
MAX_CANDIDATES = 30


def without_copies(candidates: DataFrame, edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Candidates and outlines without those that have the outline and the plane of one with a lower id."""
    outline = edges.groupBy(*keys, "polygon_id").agg(F.array_sort(F.collect_list(F.struct("i", "x0", "y0", "x1", "y1"))).alias("_ring"))
    same = candidates.join(outline, [*keys, "polygon_id"]).groupBy(*keys, "_ring", "a", "b", "c", "d")
    kept = same.agg(F.min("polygon_id").alias("polygon_id"))
    return kept.select(*keys, "polygon_id", "a", "b", "c", "d"), kept.select(*keys, "polygon_id", F.inline("_ring"))


def assign_ceiling(points: DataFrame, candidates: DataFrame, edges: DataFrame, keys: Sequence[str], point_id: Sequence[str],
                   floor_z: float, fallback_z: float, allowed: DataFrame | None = None) -> DataFrame:
    """Lowest ceiling above the floor at each point; points under none get the flat fallback.

    ``candidates`` carry ``polygon_id`` and plane a..d, ``edges`` their outlines.  ``allowed``
    restricts candidates per point through rows (point keys, polygon_id).  Of candidates with one
    outline and plane only the lowest id can win, so without ``allowed`` the others are left out
    before they multiply the points.
    """
    if allowed is None:
        candidates, edges = map(S.cut_lineage, without_copies(candidates, edges, keys))
    hits = points_in_polygons(points, edges, keys, point_id, boundary=BOUNDARY)
    if allowed is not None:
        hits = hits.join(allowed, [c for c in allowed.columns], "left_semi")
    at = hits.join(candidates.select(*keys, "polygon_id", "a", "b", "c", "d"), [*keys, "polygon_id"])
    at = at.withColumn("z", plane_z(plane(), F.col("x"), F.col("y"))).filter(F.col("z") > floor_z + FLOOR_CLEARANCE)
    best = at.groupBy(*keys, *point_id).agg(F.min(F.struct("z", "polygon_id", "a", "b", "c", "d")).alias("h"))
    out = points.join(best, [*keys, *point_id], "left")
    missing = F.col("h").isNull()
    return out.select(
        *points.columns, F.col("h.polygon_id").alias("polygon_id"), missing.alias("is_fallback"),
        F.coalesce("h.a", F.lit(0.0)).alias("a"), F.coalesce("h.b", F.lit(0.0)).alias("b"),
        F.coalesce("h.c", F.lit(1.0)).alias("c"), F.coalesce("h.d", F.lit(-float(fallback_z))).alias("d"),
        F.coalesce("h.z", F.lit(float(fallback_z))).alias("ceiling_z"))


def room_candidates(room_cells: DataFrame, ceiling_cells: DataFrame, keys: Sequence[str], room: str, resolution: float, n: int = MAX_CANDIDATES) -> DataFrame:
    """The n ceilings with the largest overlap per room, by shared raster cells."""
    shared = room_cells.join(ceiling_cells, [*keys, "r", "c"]).groupBy(*keys, room, "polygon_id").agg(F.count("*").alias("n_cells"))
    scored = shared.withColumn("overlap", F.col("n_cells") * F.lit(resolution**2))
    return top_k(scored, [*keys, room], [F.col("n_cells").desc(), F.col("polygon_id")], n, rank="rank")


def interval_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], bin_size: float = 1.0) -> DataFrame:
    """Pairs of rows whose [z_min, z_max] and [low, high] overlap.

    Both sides are spread over height bins and joined on the bin; a pair counts only in the bin
    where its overlap begins, so it appears once.
    """
    bin_of = lambda c: F.floor(F.col(c) / bin_size)
    spread = lambda df, a, b: df.select("*", F.explode(F.sequence(bin_of(a), bin_of(b))).alias("_bin"))
    joined = spread(left, "z_min", "z_max").join(spread(right, "low", "high"), [*keys, "_bin"])
    begin = F.floor(F.greatest("z_min", "low") / bin_size)
    return joined.filter((F.col("z_min") <= F.col("high")) & (F.col("z_max") >= F.col("low")) & (F.col("_bin") == begin)).drop("_bin")


def box_metric(q: Vec, g: Column) -> Column:
    return S.gap2((q, q), (Vec(g["x0"], g["y0"], F.lit(0.0)), Vec(g["x1"], g["y1"], F.lit(0.0))))


def box_tree(boxes: DataFrame, keys: Sequence[str], tid: str, k: int | None = 1) -> S.Tree:
    zero = F.lit(0.0)
    low, high = Vec(F.col("x0"), F.col("y0"), zero), Vec(F.col("x1"), F.col("y1"), zero)
    return S.build_tree(boxes, keys, tid, F.struct("x0", "y0", "x1", "y1"), low, high, k=k)


def flat(x: str = "x", y: str = "y") -> Vec:
    return Vec(F.col(x), F.col(y), F.lit(0.0))


def rooms_near(points: DataFrame, room_boxes: DataFrame, keys: Sequence[str], point_id: Sequence[str], max_dist: float = STAIR_DISTANCE, room: str = "room_id") -> DataFrame:
    """Sorted rooms within a distance of each point; without any, the single nearest room.

    A room is a set of boxes (runs of its cells, or one rectangle).
    """
    tree = box_tree(room_boxes, keys, room, k=None)
    near = S.within(points, tree, flat(), max_dist, box_metric).groupBy(*keys, *point_id).agg(F.sort_array(F.collect_set("tid")).alias("near"))
    closest = S.nearest(points, box_tree(room_boxes, keys, room), flat(), box_metric, tid="closest")
    out = closest.join(near, [*keys, *point_id], "left")
    return out.select(*keys, *point_id, F.coalesce("near", F.array("closest")).alias("room_ids"))


def points_near_segments(points: DataFrame, segments: DataFrame, keys: Sequence[str], tid: str, max_dist: float = WALL_DISTANCE) -> DataFrame:
    """All (point, segment) pairs up to a distance in the plane; segments carry x0, y0, x1, y1."""
    tree = S.shape_tree(segments, keys, tid, [flat("x0", "y0"), flat("x1", "y1")], k=None)
    return S.within(points, tree, flat(), max_dist, S.segment_metric)


def segment_gap2(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Squared distance of two segments in the plane: 0 where they cross, else an end decides."""
    side = lambda p, q, r: (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)
    crossing = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    ends = F.least(segment_distance2(a, c, d, 1e-18), segment_distance2(b, c, d, 1e-18), segment_distance2(c, a, b, 1e-18), segment_distance2(d, a, b, 1e-18))
    return F.when(crossing, F.lit(0.0)).otherwise(ends)


def match_opening(walls: DataFrame, openings: DataFrame, keys: Sequence[str], wall_id: Sequence[str], tolerance: float) -> DataFrame:
    """First opening, in edge order, that touches each wall segment of one of its rooms.

    ``walls``: room_id, x0..y1; ``openings``: edge_index, edge_id, kind, room_ids, xa..yb.  Walls
    without a match keep nulls.
    """
    one = openings.filter(F.col("kind").isin("door", "opening")).select(
        *keys, F.explode("room_ids").alias("room_id"), F.struct("edge_index", "edge_id", "kind").alias("edge"),
        F.col("xa").alias("x0"), F.col("ya").alias("y0"), F.col("xb").alias("x1"), F.col("yb").alias("y1"))
    room = [*keys, "room_id"]
    tree = S.shape_tree(one, room, "edge", [flat("x0", "y0"), flat("x1", "y1")], k=None)
    # long walls are probed in pieces of at most two metres, each with the same reach
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    parts = F.greatest(F.ceil(length / 2.0), F.lit(1)).cast("int")
    pieces = walls.select(*room, *wall_id, "x0", "y0", "x1", "y1", parts.alias("_n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_i"))
    t = (F.col("_i") + 0.5) / F.col("_n")
    probes = pieces.withColumns({"x": F.col("x0") + (F.col("x1") - F.col("x0")) * t, "y": F.col("y0") + (F.col("y1") - F.col("y0")) * t})
    pairs = S.within(probes, tree, flat(), 1.0 + tolerance, S.segment_metric).select(*room, *wall_id, "x0", "y0", "x1", "y1", F.col("tid").alias("edge")).distinct()
    lines = one.select(*room, "edge", F.col("x0").alias("xa"), F.col("y0").alias("ya"), F.col("x1").alias("xb"), F.col("y1").alias("yb"))
    pairs = pairs.join(lines, [*room, "edge"])
    a, b, c, d = flat("x0", "y0"), flat("x1", "y1"), flat("xa", "ya"), flat("xb", "yb")
    mid, line = (a + b).scale(0.5), d - c
    along = (mid - c).dot(line)
    across = (mid - c).cross(line).z
    covered = (along >= 0) & (along <= line.norm2()) & (across * across <= line.norm2() * tolerance**2)
    touching = pairs.filter((segment_gap2(a, b, c, d) <= tolerance**2) | covered)
    first = touching.groupBy(*room, *wall_id).agg(F.min("edge").alias("edge"))
    return walls.join(first, [*room, *wall_id], "left").select(
        *walls.columns, F.col("edge.edge_id").alias("edge_id"), F.col("edge.kind").alias("kind"))


def next_lower_polygon(points: DataFrame, triangles: DataFrame, keys: Sequence[str], point_id: Sequence[str], classes: DataFrame,
                       class_id: int, slack: float = -0.05, max_dist: float | None = 3.0) -> DataFrame:
    """Nearest polygon of a class among those whose midpoint is not above the point; -1 without one.

    ``triangles`` carry corners ``ax..cz`` and ``polygon_id``.  Triangles carry the height of their
    polygon's midpoint and cells its range, so one search prunes by height and distance together.
    """
    wanted = triangles.join(classes.filter(F.col("class_id") == class_id), [*keys, "polygon_id"], "left_semi")
    mid = wanted.groupBy(*keys, "polygon_id").agg(F.avg((F.col("az") + F.col("bz") + F.col("cz")) / 3).alias("mid_z"))
    tree = S.shape_tree(wanted.join(mid, [*keys, "polygon_id"]), keys, "polygon_id", [Vec(*(F.col(f"{n}{c}") for c in "xyz")) for n in "abc"], value=F.col("mid_z"))
    out = S.nearest(points, tree, Vec(F.col("x"), F.col("y"), F.col("z")), S.triangle_metric, max_dist=max_dist, how="left", tid="polygon_id",
                    below=F.col("z") - slack)
    return out.withColumn("polygon_id", F.coalesce("polygon_id", F.lit(-1)))


def nearest_polygon_of_class(points: DataFrame, triangles: DataFrame, keys: Sequence[str], classes: DataFrame, class_id: int,
                             max_dist: float | None = None) -> DataFrame:
    """Polygon of the nearest triangle of a class, within ``max_dist`` if given; -1 where there is none."""
    wanted = triangles.join(classes.filter(F.col("class_id") == class_id), [*keys, "polygon_id"], "left_semi")
    corner = [Vec(*(F.col(f"{n}{c}") for c in "xyz")) for n in "abc"]
    tree = S.shape_tree(wanted, keys, "polygon_id", corner)
    out = S.nearest(points, tree, Vec(F.col("x"), F.col("y"), F.col("z")), S.triangle_metric, max_dist=max_dist, how="left", tid="polygon_id")
    return out.withColumn("polygon_id", F.coalesce("polygon_id", F.lit(-1)))
