"""Polygon set maintenance: holes, merges, simplification, extension, projection and metrics."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.functions import vectors as V
from atrium.functions.vectors import plane, vec
from atrium.operators import graphs, mesh
from atrium.operators import spatial as S
from atrium.session import end_round

SCENE = ("scene_id",)

# Thresholds of polygon maintenance in metres and degrees.
CONVEX_DEPTH2 = 0.05**2
MERGE_DISTANCE = 0.01
MAX_TURN = 15.0
SHORT_EDGE = 0.005
ATTACH_DISTANCE = 0.01
ATTACH_MOVE = 0.02
SMALL_COMPONENT = 0.01


def convex_contour_vertices(contour: DataFrame, neighbors: DataFrame, vertices: DataFrame, planes: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Contour vertices ``(keys, polygon_id, vertex_id)`` with a mesh neighbour clearly behind the plane."""
    at = vertices.select(*keys, F.col("vertex_id").alias("neighbor_id"), "x", "y", "z")
    near = contour.join(neighbors, [*keys, "vertex_id"]).join(at, [*keys, "neighbor_id"]).join(planes, [*keys, "polygon_id"])
    behind = near.filter(plane().at(vec()) < -CONVEX_DEPTH2).select(*keys, "polygon_id", "vertex_id")
    return contour.join(behind, [*keys, "polygon_id", "vertex_id"], "left_semi")


def mesh_components(triangles: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    return graphs.connected_components(mesh.triangle_neighbors(triangles, keys), triangles, keys, "triangle_id", "triangle_id", "neighbor_id")


def drop_small_components(triangles: DataFrame, vertices: DataFrame, min_area: float = SMALL_COMPONENT, keys: Sequence[str] = SCENE) -> DataFrame:
    member = mesh_components(triangles, keys)
    area = mesh.with_area_normal(mesh.corners(triangles, vertices, keys)).select(*keys, "triangle_id", "area")
    large = member.join(area, [*keys, "triangle_id"]).groupBy(*keys, "component").agg(F.sum("area").alias("area")).filter(F.col("area") >= min_area)
    return triangles.join(member.join(large, [*keys, "component"], "left_semi"), [*keys, "triangle_id"], "left_semi")


def largest_component(members: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Members of the component with most members (or most weight); ties go to the lowest id."""
    size = F.count("*") if weight is None else F.sum(weight)
    sizes = members.groupBy(*keys, "component").agg(size.alias("n"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("component")).alias("neg"))).alias("b")).select(*keys, (-F.col("b.neg")).alias("component"))
    return members.join(best, [*keys, "component"], "left_semi")


def merge_candidates(vertices: DataFrame, max_dist: float = MERGE_DISTANCE, k: int = 10, keys: Sequence[str] = SCENE) -> DataFrame:
    """Unordered vertex pairs closer than ``max_dist`` among each vertex's k nearest."""
    tree = S.point_tree(vertices, keys, "vertex_id", vec(), k)
    found = S.knn(vertices.select(*keys, "vertex_id", "x", "y", "z"), tree, vec(), k=k, max_dist=max_dist)
    pairs = found.select(*keys, "vertex_id", F.explode("hits").alias("h")).filter(F.col("h.tid") != F.col("vertex_id"))
    return pairs.select(*keys, F.least("vertex_id", "h.tid").alias("i"), F.greatest("vertex_id", "h.tid").alias("j"),
                        F.sqrt("h.d2").alias("dist")).filter(F.col("dist") < max_dist).distinct()


def nearest_edges(points: DataFrame, segments: DataFrame, k: int, keys: Sequence[str], point_id: str, edge_id: str, include_zero: bool = False) -> DataFrame:
    """The k nearest segments per point; segments through the point itself do not count unless asked.

    Since those take part in the search, points that come out short are searched again with twice
    as many candidates until none is short or all segments were seen.
    """
    corner = [vec(suffix="0"), vec(suffix="1")]
    todo, done, ask = points, None, k if include_zero else k + 8
    total = None
    while True:
        tree = S.shape_tree(segments, keys, edge_id, corner, k=ask)
        found = S.knn(todo, tree, vec(), S.listed_segment_metric, k=ask)
        # a copy of a geometry beyond the ask-th is never among the ask nearest
        kept = F.slice(F.filter("hits", lambda h: F.lit(include_zero) | (h["d2"] > 1e-16)), 1, k)
        found = end_round(found.select(*points.columns, F.size("hits").alias("_seen"), kept.alias("hits")))
        short = (F.size("hits") < k) & (F.col("_seen") >= ask)
        finished = found.filter(~short).drop("_seen")
        done = finished if done is None else done.unionByName(finished)
        todo = found.filter(short).select(*points.columns)
        if include_zero or todo.isEmpty():
            break
        total = total or segments.count()
        if ask >= total:
            break
        ask *= 2
    return done.select(*points.columns, F.posexplode("hits").alias("rank", "h")).select(
        *points.columns, "rank", F.col("h.tid").alias(edge_id), F.sqrt("h.d2").alias("dist"))


def triangle_tree(cornered: DataFrame, keys: Sequence[str] = SCENE, tid: str = "triangle_id", k: int = 1) -> S.Tree:
    return S.shape_tree(cornered, keys, tid, list(mesh.corner_vectors()), k=k)


def closest_face(points: DataFrame, cornered: DataFrame, max_dist: float, min_area: float = 5e-3, keys: Sequence[str] = SCENE) -> DataFrame:
    """Nearest triangle of at least ``min_area``; -1 where the squared distance exceeds ``max_dist``."""
    large = mesh.with_area_normal(cornered).filter(F.col("area") >= min_area)
    out = S.nearest(points, triangle_tree(large, keys), vec(), S.triangle_metric, how="left", tid="triangle_id")
    near = F.col("dist") * F.col("dist") <= max_dist
    return out.withColumn("triangle_id", F.when(near, F.col("triangle_id")).otherwise(F.lit(-1)))


def closest_triangle_inside(points: DataFrame, cornered: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Nearest triangle, and whether the closest point lies off the two edges at its first corner."""
    out = S.nearest(points, triangle_tree(cornered, keys), vec(), S.triangle_metric, tid="triangle_id")
    joined = out.join(cornered.select(*keys, "triangle_id", *(f"{n}{c}" for n in "abc" for c in "xyz")), [*keys, "triangle_id"])
    placed = V.with_triangle_closest(joined, vec(), *mesh.corner_vectors())
    return placed.select(*points.columns, "triangle_id", "dist", ((F.col("qv") > 1e-9) & (F.col("qw") > 1e-9)).alias("inside"))


def chamfer(left: DataFrame, right: DataFrame, keys: Sequence[str], max_dist: float | None = None) -> DataFrame:
    """Mean nearest distance in both directions; with ``max_dist`` only over points that close."""
    def one_way(a, b, name):
        d = S.nearest(a, S.point_tree(b, keys, F.lit(0), vec()), vec())
        if max_dist is not None:
            d = d.filter(F.col("dist") < max_dist)
        return d.groupBy(*keys).agg(F.avg("dist").alias(name), F.count("*").alias(f"n_{name}"))
    return one_way(left, right, "left_to_right").join(one_way(right, left, "right_to_left"), list(keys), "full_outer")


def mutual_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs that are each other's nearest point."""
    lr = S.nearest(left, S.point_tree(right, keys, right_id, vec()), vec(), tid=right_id).select(*keys, left_id, right_id, "dist")
    rl = S.nearest(right, S.point_tree(left, keys, left_id, vec()), vec(), tid=left_id).select(*keys, left_id, right_id)
    return lr.join(rl, [*keys, left_id, right_id])


def windowed_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], splits: dict[str, float], right_id: str) -> DataFrame:
    """Nearest point within the same axis-aligned window; windows are not searched across seams."""
    window = lambda df: df.withColumn("window", sum((F.when(F.col(a) >= s, 2**i).otherwise(0) for i, (a, s) in enumerate(splits.items())), F.lit(0)))
    tree = S.point_tree(window(right), [*keys, "window"], right_id, vec())
    return S.nearest(window(left), tree, vec(), how="left", tid=right_id)


def point_mesh_distance(points: DataFrame, cornered: DataFrame, keys: Sequence[str] = SCENE, max_dist: float | None = None) -> DataFrame:
    """Mean squared distance of the points to the mesh, over points up to ``max_dist``."""
    out = S.nearest(points, triangle_tree(cornered, keys), vec(), S.triangle_metric)
    if max_dist is not None:
        out = out.filter(F.col("dist") <= max_dist)
    return out.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("dist") * F.col("dist")).alias("mean_d2"))


def append_triangles(new: DataFrame, vertices: DataFrame, keys: Sequence[str] = SCENE) -> tuple[DataFrame, DataFrame]:
    """Three fresh vertices for each new triangle (corners ``ax..cz``), numbered after the existing ones."""
    from atrium.operators.ranking import dense_index

    number = dense_index(new, "triangle_id", "_i", keys)
    top = vertices.groupBy(*keys).agg(F.max("vertex_id").alias("_top"))
    at = new.join(number, [*keys, "triangle_id"]).join(top, list(keys), "left").withColumn(
        "_base", F.coalesce("_top", F.lit(-1)) + 1 + F.col("_i") * 3)
    tri = at.select(*keys, "triangle_id", *((F.col("_base") + i).alias(f"v{i}") for i in range(3)), "polygon_id")
    corner = lambda i, n: F.struct((F.col("_base") + i).alias("vertex_id"), *(F.col(f"{n}{c}").alias(c) for c in "xyz"))
    rows = at.select(*keys, "polygon_id", F.inline(F.array(*(corner(i, n) for i, n in enumerate("abc")))))
    return rows, tri


def add_channel(probabilities: Column) -> Column:
    """Class probabilities with one more class of probability zero."""
    return F.concat(probabilities, F.array(F.lit(0.0)))


# ---- contours and holes ------------------------------------------------------------------------------------


def class_filter_polygons(polygons: DataFrame, classes: Sequence[str], keys: Sequence[str] = SCENE) -> DataFrame:
    """Polygons of the wanted classes, with their ``shared_edges`` map pruned to each other."""
    kept = polygons.filter(F.col("class").isin(*classes))
    alive = kept.select(*keys, F.col("polygon_id").cast("string").alias("other"))
    links = kept.select(*keys, "polygon_id", F.explode("shared_edges").alias("other", "edges")).join(alive, [*keys, "other"], "left_semi")
    pruned = links.groupBy(*keys, "polygon_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("other", "edges")))).alias("_s"))
    empty = F.map_from_entries(F.filter(F.map_entries("shared_edges"), lambda e: F.lit(False)))
    return kept.join(pruned, [*keys, "polygon_id"], "left").withColumn("shared_edges", F.coalesce("_s", empty)).drop("_s")


def unshared_contours(contours: DataFrame, members: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Contours none of whose vertices lies on another polygon; ``members``: polygon, contour, vertex."""
    owners = members.select(*keys, "vertex_id", "polygon_id").distinct().groupBy(*keys, "vertex_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = members.join(owners, [*keys, "vertex_id"], "left_semi").select(*keys, "polygon_id", "contour").distinct()
    return contours.join(shared, [*keys, "polygon_id", "contour"], "left_anti")


def drop_small_holes(contours: DataFrame, members: DataFrame, min_area: float, keys: Sequence[str] = SCENE) -> DataFrame:
    small = contours.filter((~F.col("is_outer")) & (F.col("area") < min_area))
    gone = unshared_contours(small, members, keys)
    return contours.join(gone, [*keys, "polygon_id", "contour"], "left_anti")


def drop_nonconvex_holes(contours: DataFrame, members: DataFrame, convex: DataFrame, min_convex: int = 5, keys: Sequence[str] = SCENE) -> DataFrame:
    """Drop unshared holes with fewer than ``min_convex`` convex vertices."""
    on = [*keys, "polygon_id", "vertex_id"]
    counts = members.join(convex.select(*on).distinct(), on, "left_semi").groupBy(*keys, "polygon_id", "contour").agg(F.count("*").alias("_c"))
    holes = unshared_contours(contours.filter(~F.col("is_outer")), members, keys).join(counts, [*keys, "polygon_id", "contour"], "left")
    gone = holes.filter(F.coalesce("_c", F.lit(0)) < min_convex)
    return contours.join(gone, [*keys, "polygon_id", "contour"], "left_anti")


def group_contours(nested: DataFrame, keys: Sequence[str], ring_id: str = "ring_id") -> DataFrame:
    """Outer contours with their holes, largest outer area first within each polygon."""
    holes = nested.filter("NOT is_outer").groupBy(*keys, F.col("parent_id").alias(ring_id)).agg(F.sort_array(F.collect_list(ring_id)).alias("holes"))
    outer = nested.filter("is_outer").select(*keys, ring_id, "area").join(holes, [*keys, ring_id], "left")
    w = W.partitionBy(*keys).orderBy(F.col("area").desc(), F.col(ring_id))  # the outer contours of one polygon
    return outer.withColumn("rank", F.row_number().over(w) - 1)


def fill_small_holes(loops: DataFrame, vertices: DataFrame, vertex_polygon: DataFrame, max_length: int, max_dist: float, keys: Sequence[str] = SCENE) -> DataFrame:
    """New position of the vertices of small holes: the hole's centre.

    ``loops``: loop_id, vertex_id.  A hole is small if it has at most ``max_length`` vertices, all
    within ``max_dist`` of the centre, and at most one polygon appears more than once around it.
    """
    at = loops.join(vertices, [*keys, "vertex_id"])
    centre = at.groupBy(*keys, "loop_id").agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"))
    around = loops.join(vertex_polygon, [*keys, "vertex_id"]).groupBy(*keys, "loop_id", "polygon_id").agg(F.count("*").alias("_k"))
    repeated = around.groupBy(*keys, "loop_id").agg(F.count_if(F.col("_k") > 1).alias("_rep"))
    joined = at.join(centre, [*keys, "loop_id"])
    reach = joined.groupBy(*keys, "loop_id").agg(F.max((vec() - vec("c")).norm()).alias("_far"))
    small = reach.join(repeated, [*keys, "loop_id"], "left").filter((F.col("_far") <= max_dist) & (F.coalesce("_rep", F.lit(0)) <= 1))
    return joined.filter(F.col("_n") <= max_length).join(small, [*keys, "loop_id"], "left_semi").select(*keys, "loop_id", "vertex_id", "cx", "cy", "cz")


# ---- merging planes ----------------------------------------------------------------------------------------


def plane_merge_pairs(vertices: DataFrame, vertex_planes: DataFrame, cornered: DataFrame, planes: DataFrame, k: int, max_dist: float, max_angle: float,
                      classes: DataFrame | None = None, keys: Sequence[str] = SCENE) -> DataFrame:
    """Unordered polygon pairs: a vertex of one close to a face of the other, with similar normals."""
    tree = S.shape_tree(cornered, keys, F.struct("triangle_id", "polygon_id"), list(mesh.corner_vectors()), k=k)
    found = S.knn(vertices.select(*keys, "vertex_id", "x", "y", "z"), tree, vec(), S.triangle_metric, k=k, max_dist=max_dist)
    near = found.select(*keys, "vertex_id", F.explode("hits").alias("h")).filter(F.sqrt("h.d2") < max_dist).select(*keys, "vertex_id", F.col("h.tid.polygon_id").alias("q"))
    pairs = near.distinct().join(vertex_planes.select(*keys, "vertex_id", F.col("plane_id").alias("p")), [*keys, "vertex_id"]).filter("p <> q")
    pairs = pairs.select(*keys, F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    for side, letter in (("p", "1"), ("q", "2")):
        pairs = pairs.join(planes.select(*keys, F.col("polygon_id").alias(side), *(F.col(c).alias(f"{c}{letter}") for c in "abcd")), [*keys, side])
        if classes is not None:
            pairs = pairs.join(classes.select(*keys, F.col("polygon_id").alias(side), F.col("class_id").alias(f"class{letter}")), [*keys, side])
    ok = V.angle_degrees(plane(suffix="1").n, plane(suffix="2").n) < max_angle
    if classes is not None:
        ok = ok & (F.col("class1") == F.col("class2"))
    return pairs.filter(ok).select(*keys, "p", "q")


def plane_merge_cost(points: DataFrame, pairs: DataFrame, keys: Sequence[str] = SCENE, distance_base: float = 0.02, angle_base: float = 5.0,
                     max_distance_cost: float = 0.5, max_angle_cost: float = 0.2) -> DataFrame:
    """Relative loss of fitting both sides of each pair with one plane.

    ``points``: polygon_id, x..z, nx..nz.  Joint planes come from the sum of both sides' moments.
    Each side's points are measured against the joint plane and the other side's plane, and the
    smaller error counts, for distance and angle alike; a cost is the worse side's growth over its
    own error (or a base error).  Angles are signed: opposite normals are 180 degrees apart.
    Returns both costs, ``cost`` (their maximum), the winner (more points, then the lower id), the joint
    plane, turned to the winner's side, and whether the pair is accepted.
    """
    from atrium.functions.eigen import MOMENTS, merge_moments, moment_sums, planes_from_moments

    poly = [*keys, "polygon_id"]
    moments = S.cut_lineage(points.groupBy(*poly).agg(*moment_sums(vec())))
    own = S.cut_lineage(planes_from_moments(moments, poly).select(*poly, "a", "b", "c", "d"))
    side = lambda c: pairs.join(moments.withColumnRenamed("polygon_id", c), [*keys, c]).select(*keys, "p", "q", *(f"m_{n}" for n in MOMENTS))
    pair = [*keys, "p", "q"]
    joint = planes_from_moments(merge_moments(side("p").unionByName(side("q")), pair), pair).select(*pair, F.lit("joint").alias("kind"), "a", "b", "c", "d")
    other = lambda c: pairs.join(own.withColumnRenamed("polygon_id", c), [*keys, c]).select(*pair, F.lit(f"of_{c}").alias("kind"), "a", "b", "c", "d")
    tried = S.cut_lineage(joint.unionByName(other("p")).unionByName(other("q")))
    errors = lambda df, by: df.groupBy(*by).agg(F.avg(F.abs(plane().at(vec()))).alias("e_dist"), F.avg(V.angle_degrees(vec("n"), plane().n)).alias("e_angle"), F.count("*").alias("n"))
    base = errors(points.join(own, poly), poly).select(*poly, F.col("e_dist").alias("o_dist"), F.col("e_angle").alias("o_angle"), F.col("n").alias("n_own"))
    both = tried.select("*", F.explode(F.array("p", "q")).alias("polygon_id"))
    # a side's own plane is no candidate for it
    against = both.filter((F.col("kind") == "joint") | ((F.col("kind") == "of_p") & (F.col("polygon_id") == F.col("q"))) | ((F.col("kind") == "of_q") & (F.col("polygon_id") == F.col("p"))))
    new = errors(points.join(against, poly), [*pair, "kind", "polygon_id"]).groupBy(*pair, "polygon_id").agg(F.min("e_dist").alias("e_dist"), F.min("e_angle").alias("e_angle")).join(base, poly)
    growth = lambda e, o, b: (F.col(e) - F.col(o)) / F.greatest(F.col(o), F.lit(b))
    costs = new.groupBy(*pair).agg(
        F.max(growth("e_dist", "o_dist", distance_base)).alias("distance_cost"), F.max(growth("e_angle", "o_angle", angle_base)).alias("angle_cost"),
        (-F.max(F.struct("n_own", (-F.col("polygon_id")).alias("neg")))["neg"]).alias("winner"))
    turned = own.select(*keys, F.col("polygon_id").alias("winner"), *(F.col(c).alias(f"w_{c}") for c in "abc"))
    out = costs.join(joint.drop("kind"), pair).join(turned, [*keys, "winner"])
    side_of = F.when(F.col("a") * F.col("w_a") + F.col("b") * F.col("w_b") + F.col("c") * F.col("w_c") < 0, -1.0).otherwise(1.0)
    return out.select(*pair, "distance_cost", "angle_cost", F.greatest("distance_cost", "angle_cost").alias("cost"), "winner",
                      *((side_of * F.col(c)).alias(c) for c in "abcd"),
                      ((F.col("distance_cost") < max_distance_cost) & (F.col("angle_cost") < max_angle_cost)).alias("accepted"))


def merge_planes(costs: DataFrame, triangles: DataFrame, vertex_planes: DataFrame, keys: Sequence[str] = SCENE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply accepted merges greedily by the larger cost: triangles and constraints of the loser go to the winner.

    Returns triangles, constraints and the moves with the joint plane that the winner takes over.
    """
    good = costs.filter("accepted")
    picked = graphs.greedy_pairs(good.select(*keys, "p", "q", "cost"), keys, "p", "q", "cost")
    won = picked.join(good.select(*keys, "p", "q", "winner", "a", "b", "c", "d"), [*keys, "p", "q"])
    moves = S.cut_lineage(won.select(*keys, F.when(F.col("winner") == F.col("p"), F.col("q")).otherwise(F.col("p")).alias("loser"), "winner", "a", "b", "c", "d"))
    remap = lambda df, c: df.join(moves.select(*keys, "loser", "winner").withColumnRenamed("loser", c), [*keys, c], "left").withColumn(c, F.coalesce("winner", c)).drop("winner")
    return remap(triangles, "polygon_id").select(*triangles.columns), remap(vertex_planes, "plane_id").select(*keys, "vertex_id", "plane_id").distinct(), moves


def polygon_class_vote(points: DataFrame, cornered: DataFrame, planes: DataFrame, classes: Sequence[str], keys: Sequence[str] = SCENE, min_share: float = 0.2) -> DataFrame:
    """Class of each polygon: mean probabilities of the points nearest to it, masked by orientation.

    -1 where every probability is zero or the best one is below ``min_share``.
    """
    from atrium.operators.rooms import mask_by_orientation

    tree = triangle_tree(cornered, keys, F.struct("triangle_id", "polygon_id"))
    near = S.nearest(points, tree, vec(), S.triangle_metric)
    soft = near.groupBy(*keys, F.col("tid.polygon_id").alias("polygon_id")).agg(F.count("*").alias("n_points"), *(F.avg(c).alias(c) for c in classes))
    masked = mask_by_orientation(soft.join(planes, [*keys, "polygon_id"]), F.col("c"))
    best = F.greatest(*classes)
    index = F.array_position(F.array(*classes), best) - 1
    return masked.select(*keys, "polygon_id", "n_points", *classes, F.when(best < min_share, -1).otherwise(index).cast("int").alias("class_id"))


# ---- vertices and edges --------------------------------------------------------------------------------------


def joint_constraints(pairs: DataFrame, plane_sets: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Plane sets of both ends of vertex pairs, their union, common part and inclusion."""
    out = pairs
    for end, name in (("i", "pi"), ("j", "pj")):
        out = out.join(plane_sets.select(*keys, F.col("vertex_id").alias(end), F.col("planes").alias(name)), [*keys, end], "left")
    empty = F.array().cast(plane_sets.schema["planes"].dataType)
    out = out.withColumns({"pi": F.coalesce("pi", empty), "pj": F.coalesce("pj", empty)})
    return out.withColumns({"joint": F.array_sort(F.array_union("pi", "pj")), "common": F.array_sort(F.array_intersect("pi", "pj")),
                            "i_in_j": F.size(F.array_except("pi", "pj")) == 0, "j_in_i": F.size(F.array_except("pj", "pi")) == 0})


def vertex_merge_plan(vertices: DataFrame, vertex_planes: DataFrame, planes: DataFrame, max_dist: float, max_angle_to_90: float = 70.0, keys: Sequence[str] = SCENE) -> DataFrame:
    """Close vertex pairs that may merge: their joint planes number three at most, meet at a usable
    angle, and moving both vertices onto them shifts neither by ``max_dist`` or more."""
    sets = mesh.vertex_plane_sets(vertex_planes, keys)
    pairs = joint_constraints(merge_candidates(vertices, max_dist, 10, keys), sets, keys).filter(F.size("joint").between(1, 3))
    n = F.size("joint")
    for s, slot in enumerate("123"):
        eq = planes.select(*keys, F.col("plane_id").alias(f"_k{slot}"), *(F.col(c).alias(f"{c}{slot}") for c in "abcd"))
        pairs = pairs.withColumn(f"_k{slot}", F.get("joint", F.lit(s))).join(eq, [*keys, f"_k{slot}"], "left")
    for end in "ij":
        at = vertices.select(*keys, F.col("vertex_id").alias(end), *(F.col(c).alias(f"{c}{end}") for c in "xyz"))
        pairs = pairs.join(at, [*keys, end])
    p, q, t = (plane(suffix=s) for s in "123")
    tilt = lambda u, v: F.abs(90 - V.angle_degrees(u.n, v.n))
    angle = F.when(n == 1, 0.0).when(n == 2, tilt(p, q)).otherwise(F.greatest(tilt(p, q), tilt(p, t), tilt(q, t)))
    point, direction, ok2 = V.plane_plane_line(p, q)
    corner, ok3 = V.three_plane_point(p, q, t)
    pairs = pairs.withColumns({"_angle": angle, **V.named("l", point), **V.named("u", direction), **V.named("k", corner), "_ok2": ok2, "_ok3": ok3})
    line, along = vec("l"), vec("u")

    def shift(end: str) -> Column:
        v = vec(suffix=end)
        foot = line + along.scale((v - line).dot(along) / F.nullif(along.norm2(), F.lit(0.0)))
        return F.when(n == 1, 0.0).when((n == 2) & F.col("_ok2"), (v - foot).norm()).when((n == 3) & F.col("_ok3"), (v - vec("k")).norm())

    pairs = pairs.withColumn("shift", F.greatest(shift("i"), shift("j")))
    keeps_j = F.size("pj") > F.size("pi")
    return pairs.filter((F.col("shift") < max_dist) & (F.col("_angle") <= max_angle_to_90)).select(
        *keys, "i", "j", "dist", "shift", "joint", F.when(keeps_j, F.col("j")).otherwise(F.col("i")).alias("kept"), F.when(keeps_j, F.col("i")).otherwise(F.col("j")).alias("gone"))


def simplify_vertices(vertices: DataFrame, triangles: DataFrame, vertex_planes: DataFrame, planes: DataFrame, max_dist: float = 0.005, rounds: int | None = None, keys: Sequence[str] = SCENE):
    """Merge close vertices that agree on their planes, nearest pairs first, until none is left.

    ``rounds`` stops earlier; what is left is then not merged.
    Triangles that collapse are dropped.  Returns vertices, triangles and vertex planes.
    """
    for _ in itertools.count() if rounds is None else range(rounds):
        plan = end_round(vertex_merge_plan(vertices, vertex_planes, planes, max_dist, keys=keys))
        if plan.isEmpty():
            break
        picked = graphs.greedy_pairs(plan.select(*keys, "i", "j", F.col("dist").alias("cost")), keys, "i", "j", "cost")
        merges = end_round(picked.join(plan, [*keys, "i", "j"]).select(*keys, "kept", "gone", "joint"))
        moved = merges.select(*keys, F.col("gone").alias("vertex_id"), "kept")
        for c in ("v0", "v1", "v2"):
            triangles = triangles.join(moved.withColumnRenamed("vertex_id", c), [*keys, c], "left").withColumn(c, F.coalesce("kept", c)).drop("kept")
        triangles = end_round(triangles.filter("v0 <> v1 AND v1 <> v2 AND v0 <> v2"))
        vertices = end_round(vertices.join(moved, [*keys, "vertex_id"], "left_anti"))
        touched = merges.select(*keys, F.explode(F.array("kept", "gone")).alias("vertex_id"))
        fresh = merges.select(*keys, F.col("kept").alias("vertex_id"), F.explode("joint").alias("plane_id"))
        vertex_planes = end_round(vertex_planes.select(*keys, "vertex_id", "plane_id").join(touched, [*keys, "vertex_id"], "left_anti").unionByName(fresh))
    return vertices, triangles, vertex_planes


def simplify_edges(contour: DataFrame, vertices: DataFrame, vertex_planes: DataFrame, triangles: DataFrame, max_turn: float = MAX_TURN, short: float = SHORT_EDGE, keys: Sequence[str] = SCENE) -> DataFrame:
    """Contour vertices to delete, with the place they are pulled to on the line of their neighbours.

    A vertex qualifies with exactly two contour edges and one plane, a small turn or a short edge;
    corners of two-triangle polygons are protected; of two adjacent candidates the lower id goes.
    """
    both = contour.select(*keys, F.explode(F.array(F.struct(F.col("e0").alias("v"), F.col("e1").alias("n")), F.struct(F.col("e1").alias("v"), F.col("e0").alias("n")))).alias("e")).select(*keys, F.col("e.v").alias("vertex_id"), F.col("e.n").alias("n"))
    ends = both.groupBy(*keys, "vertex_id").agg(F.count("*").alias("deg"), F.min("n").alias("n1"), F.max("n").alias("n2")).filter("deg = 2")
    single = vertex_planes.groupBy(*keys, "vertex_id").agg(F.countDistinct("plane_id").alias("k")).filter("k = 1")
    small = triangles.groupBy(*keys, "polygon_id").agg(F.count("*").alias("n")).filter("n = 2")
    protected = mesh.corner_rows(triangles.join(small, [*keys, "polygon_id"], "left_semi"), keys).select(*keys, "vertex_id").distinct()
    cand = ends.join(single, [*keys, "vertex_id"], "left_semi").join(protected, [*keys, "vertex_id"], "left_anti")
    at = vertices.select(*keys, "vertex_id", "x", "y", "z")
    cand = cand.join(at, [*keys, "vertex_id"])
    for i in "12":
        cand = cand.join(at.select(*keys, F.col("vertex_id").alias(f"n{i}"), *(F.col(c).alias(f"{c}{i}") for c in "xyz")), [*keys, f"n{i}"])
    here, one, two = vec(), vec(suffix="1"), vec(suffix="2")
    u, w = one - here, two - here
    turn = 180 - F.degrees(F.acos(V.clamp(u.dot(w) / (u.norm() * w.norm() + 1e-8), -1 + 1e-8, 1 - 1e-8)))
    foot, _ = V.project_to_line(here, one, two)
    cand = S.cut_lineage(cand.withColumns({"turn": turn, "_short": u.norm(), **{f"t{n}": F.coalesce(f, o) for n, f, o in zip("xyz", foot, one)}}).filter((F.col("turn") < max_turn) | (F.col("_short") < short)))
    picked = graphs.independent_set(cand, contour, keys, "vertex_id", "e0", "e1")
    return cand.join(picked, [*keys, "vertex_id"], "left_semi").select(*keys, "vertex_id", "turn", "tx", "ty", "tz")


def attach_to_lines(vertices: DataFrame, vertex_planes: DataFrame, planes: DataFrame, contour: DataFrame, max_dist: float = ATTACH_DISTANCE, max_move: float = ATTACH_MOVE, k: int = 20, keys: Sequence[str] = SCENE) -> DataFrame:
    """Planes vertices gain from contour edges they lie on.

    A vertex within ``max_dist`` of an edge adopts the planes both ends of the edge share, if it
    then has at most three and would not move by more than ``max_move``; the nearest edge counts.
    """
    sets = mesh.vertex_plane_sets(vertex_planes, keys)
    ends = joint_constraints(contour.select(*keys, F.col("e0").alias("i"), F.col("e1").alias("j")), sets, keys).filter(F.size("common") >= 1)
    at = vertices.select(*keys, "vertex_id", "x", "y", "z")
    for i, end in enumerate("ij"):
        ends = ends.join(at.select(*keys, F.col("vertex_id").alias(end), *(F.col(c).alias(f"{c}{i}") for c in "xyz")), [*keys, end])
    edges = ends.select(*keys, F.struct("i", "j", "common").alias("edge_id"), *(f"{c}{i}" for c in "xyz" for i in (0, 1)))
    near = nearest_edges(at, edges, k, keys, "vertex_id", "edge_id").filter(F.col("dist") <= max_dist)
    own = near.filter("vertex_id <> edge_id.i AND vertex_id <> edge_id.j").join(sets, [*keys, "vertex_id"], "left")
    none = F.array().cast(sets.schema["planes"].dataType)
    own = own.withColumn("planes", F.coalesce("planes", none)).withColumn("joint", F.array_sort(F.array_union("planes", F.col("edge_id")["common"])))
    own = own.filter((F.size("joint") <= 3) & (F.size("joint") > F.size("planes")))
    best = own.groupBy(*keys, "vertex_id").agg(F.min(F.struct("dist", F.col("edge_id.i").alias("i"), F.col("edge_id.j").alias("j"), "joint")).alias("b")).select(*keys, "vertex_id", "b.*")
    links = best.select(*keys, "vertex_id", F.posexplode("joint").alias("rank", "plane_id"))
    moved = mesh.constrain_vertices(best.join(at, [*keys, "vertex_id"]).select(*keys, "vertex_id", "x", "y", "z"), links, planes, keys)
    ok = moved.filter(F.col("displacement") <= max_move)
    return best.join(ok, [*keys, "vertex_id"], "left_semi").select(*keys, "vertex_id", "i", "j", "dist", "joint")


def drop_unsatisfiable(vertices: DataFrame, vertex_planes: DataFrame, planes: DataFrame, max_distance: float, keys: Sequence[str] = SCENE) -> DataFrame:
    """Drop the last plane of every vertex its planes displace by ``max_distance`` or more, until none is displaced so far.

    Each round takes a plane from a vertex, so there are at most as many rounds as planes at a vertex.
    """
    links = end_round(vertex_planes)
    while True:
        moved = mesh.constrain_vertices(vertices, links, planes, keys)
        bad = end_round(moved.filter((F.col("displacement") >= max_distance) & (F.col("n_planes") > 0)).select(*keys, "vertex_id", (F.col("n_planes") - 1).alias("last")))
        if bad.isEmpty():
            break
        links = end_round(links.join(bad, [*keys, "vertex_id"], "left").filter("last IS NULL OR rank < last").drop("last"))
    return links


def bridged_contour(contour: DataFrame, gone: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Contour edges ``(keys, e0, e1)`` after vertices are gone: the two neighbours of each, which stay, meet in an edge."""
    gone = gone.select(*keys, "vertex_id")
    ways = [F.struct(F.col(v).alias("vertex_id"), F.col(n).alias("n")) for v, n in (("e0", "e1"), ("e1", "e0"))]
    ends = contour.select(*keys, F.explode(F.array(*ways)).alias("e")).select(*keys, "e.*").join(gone, [*keys, "vertex_id"], "left_semi")
    bridges = ends.groupBy(*keys, "vertex_id").agg(F.min("n").alias("e0"), F.max("n").alias("e1")).drop("vertex_id")
    kept = contour.select(*keys, "e0", "e1")
    for e in ("e0", "e1"):
        kept = kept.join(gone.withColumnRenamed("vertex_id", e), [*keys, e], "left_anti")
    return kept.select(*keys, "e0", "e1").unionByName(bridges.select(*keys, "e0", "e1")).distinct()


def simplify_polygons(vertices: DataFrame, triangles: DataFrame, vertex_planes: DataFrame, planes: DataFrame, keys: Sequence[str] = SCENE):
    """Pull removable contour vertices onto their neighbours' line, then attach vertices to the edges that are left.

    Returns the vertices, ``removed`` or not, those ``attached`` at their place on the planes they
    have and gain, and the planes of these (`attach_to_lines`).
    """
    contour = S.cut_lineage(mesh.contour_edges(triangles, mesh.vertex_plane_sets(vertex_planes, keys), keys))
    pulled = simplify_edges(contour, vertices, vertex_planes, triangles, keys=keys)
    moved = vertices.join(pulled, [*keys, "vertex_id"], "left").select(
        *keys, "vertex_id", *(F.coalesce(f"t{c}", c).alias(c) for c in "xyz"), F.col("tx").isNotNull().alias("removed"))
    moved = S.cut_lineage(moved)
    left = bridged_contour(contour, moved.filter("removed"), keys)
    gained = S.cut_lineage(attach_to_lines(moved.filter("NOT removed"), vertex_planes, planes, left, keys=keys))
    links = gained.select(*keys, "vertex_id", F.posexplode("joint").alias("rank", "plane_id"))
    attached = moved.join(gained, [*keys, "vertex_id"], "left_semi").select(*keys, "vertex_id", "x", "y", "z")
    placed = mesh.constrain_vertices(attached, links, planes, keys).select(*keys, "vertex_id", "px", "py", "pz")
    moved = moved.join(placed, [*keys, "vertex_id"], "left").select(
        *keys, "vertex_id", *(F.coalesce(f"p{c}", c).alias(c) for c in "xyz"), "removed", F.col("px").isNotNull().alias("attached"))
    return moved, gained


# ---- walls, floors and metrics ------------------------------------------------------------------------------


def edges_facing(cornered: DataFrame, inner: DataFrame, planes: DataFrame, direction: V.Vec, keys: Sequence[str] = SCENE) -> DataFrame:
    """Contour edges of each triangle a ray along ``direction`` meets first.

    Corners are ordered along the direction; the two edges at the first one count both when they
    lie on different sides of the direction within the plane, else only the more level one.
    """
    tri = cornered.join(inner, [*keys, "triangle_id"]).join(planes, [*keys, "polygon_id"])
    across = plane().n.cross(direction)
    a, b, c = mesh.corner_vectors()
    corner = lambda v, p: F.struct(p.dot(direction).alias("h"), F.col(v).alias("v"), *(x.alias(n) for x, n in zip(p, "xyz")))
    tri = tri.withColumns({"_s": F.array_sort(F.array(corner("v0", a), corner("v1", b), corner("v2", c))), **V.named("w", across)})
    at = [V.vec_of(F.col("_s")[i]) for i in range(3)]
    lean = lambda e: e.dot(vec("w")) / (e.norm() + 1e-8)
    tri = tri.withColumns({"_l1": lean(at[1] - at[0]), "_l2": lean(at[2] - at[0])})
    differ = F.signum("_l1") != F.signum("_l2")
    first, second = differ | (F.abs("_l1") > F.abs("_l2")), differ | ~(F.abs("_l1") > F.abs("_l2"))
    v = [F.col("_s")[i]["v"] for i in range(3)]
    edge = lambda u, w: F.struct(F.least(u, w).alias("e0"), F.greatest(u, w).alias("e1"))
    picks = F.array_compact(F.array(F.when(first, edge(v[0], v[1])), F.when(second, edge(v[0], v[2]))))
    rim = F.array_compact(F.array(*(F.when(~F.col(f"inner_{i}"), edge(F.col(p), F.col(q))) for i, (p, q) in enumerate((("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))))
    return tri.select(*keys, "polygon_id", "triangle_id", F.explode(F.array_intersect(picks, rim)).alias("e")).select(*keys, "polygon_id", "triangle_id", "e.e0", "e.e1")


def _tilt(pl: V.Plane) -> Column:
    """Degrees between a plane's normal and straight up."""
    return F.degrees(F.acos(V.clamp(pl.c / pl.n.norm(), -1.0, 1.0)))


def edges_on_two_planes(edges: DataFrame, assignments: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Edges (e0, e1) whose two vertices are assigned to two common planes or more."""
    at = lambda e: assignments.select(*keys, F.col("vertex_id").alias(e), "plane_id").filter("plane_id <> -1").distinct()
    both = edges.select(*keys, "e0", "e1").distinct().join(at("e0"), [*keys, "e0"]).join(at("e1"), [*keys, "e1", "plane_id"])
    return both.groupBy(*keys, "e0", "e1").agg(F.count("*").alias("_n")).filter("_n >= 2").drop("_n")


def wall_targets(lower: DataFrame, vertices: DataFrame, cornered: DataFrame, planes: DataFrame, classes: DataFrame, floor_class: int,
                 keys: Sequence[str] = SCENE, must_be_below: bool = False, max_floor_tilt: float = 30.0, max_dist: float = 3.0) -> DataFrame:
    """Floor polygon (target_id, -1 for none) of each lower edge: that nearest to its lower end, or the nearest below it.

    Polygons of the floor class count as floors up to ``max_floor_tilt`` degrees from level.
    """
    from atrium.operators import matching

    level = planes.filter(_tilt(plane()) <= max_floor_tilt).select(*keys, "polygon_id")
    floors = classes.join(level, [*keys, "polygon_id"], "left_semi")
    ends = lower.select(*keys, "e0", "e1").distinct()
    for e in ("e0", "e1"):
        ends = ends.join(vertices.select(*keys, F.col("vertex_id").alias(e), F.struct("z", "x", "y").alias(f"_{e}")), [*keys, e])
    low = F.when(F.col("_e0.z") < F.col("_e1.z"), F.col("_e0")).otherwise(F.col("_e1"))
    points = ends.withColumn("_p", low).select(*keys, "e0", "e1", "_p.x", "_p.y", "_p.z")
    if must_be_below:
        found = matching.next_lower_polygon(points, cornered, keys, ["e0", "e1"], floors, floor_class, max_dist=max_dist)
    else:
        found = matching.nearest_polygon_of_class(points, cornered, keys, floors, floor_class, max_dist=max_dist)
    return found.select(*keys, "e0", "e1", F.col("polygon_id").alias("target_id"))


def extend_walls(lower: DataFrame, vertices: DataFrame, planes: DataFrame, targets: DataFrame, rays: DataFrame, hit_limit: DataFrame,
                 keys: Sequence[str] = SCENE, margin: float = 0.1, min_length: float = 0.2, max_tilt: float = 10.0, assignments: DataFrame | None = None) -> DataFrame:
    """Quads that carry the lower edges of walls down (or up) to their target plane.

    ``lower``: polygon_id, e0, e1; ``targets``: e0, e1, target_id (null or -1 for none); ``rays``:
    ray_id, ox..oz, ex..ez; ``hit_limit``: polygon_id, max_hits_per_area; ``assignments``: vertex_id,
    plane_id.  Walls further than ``max_tilt`` degrees from upright have no quads, nor have edges
    whose two vertices share two planes or more.  A quad is taken if the edge is long and level
    enough and rays cross it less often per area than its wall allows.
    """
    upright = planes.filter(F.abs(_tilt(plane()) - 90) <= max_tilt).select(*keys, "polygon_id")
    q = lower.join(upright, [*keys, "polygon_id"], "left_semi").join(targets.filter("target_id IS NOT NULL AND target_id <> -1"), [*keys, "e0", "e1"])
    if assignments is not None:
        q = q.join(edges_on_two_planes(q, assignments, keys), [*keys, "e0", "e1"], "left_anti")
    for i, e in enumerate(("e0", "e1")):
        q = q.join(vertices.select(*keys, F.col("vertex_id").alias(e), *(F.col(c).alias(f"{c}{i}") for c in "xyz")), [*keys, e])
    for col, s in (("polygon_id", "1"), ("target_id", "2")):
        q = q.join(planes.select(*keys, F.col("polygon_id").alias(col), *(F.col(c).alias(f"{c}{s}") for c in "abcd")), [*keys, col])
    p0, p1 = vec(suffix="0"), vec(suffix="1")
    length = (p1 - p0).norm()
    tilt = F.degrees(F.acos(V.clamp((F.col("z1") - F.col("z0")) / F.greatest(length, F.lit(1e-12)), -1, 1)))
    q = q.filter((length > min_length) & (F.least(tilt, 180 - tilt) > max_tilt))
    point, direction, ok = V.plane_plane_line(plane(suffix="1"), plane(suffix="2"))
    q = q.withColumns({**V.named("l", point), **V.named("u", direction), "_ok": ok}).filter("_ok")
    line, along = vec("l"), vec("u")
    foot = lambda p: line + along.scale((p - line).dot(along) / F.nullif(along.norm2(), F.lit(0.0)))
    q = q.withColumns({**V.named("f0", foot(p0)), **V.named("f1", foot(p1))})
    f0, f1 = vec("f0"), vec("f1")
    area = ((p1 - p0).cross(f0 - p0).norm() + (p1 - f1).cross(f0 - f1).norm()) / 2
    q = S.cut_lineage(q.withColumn("area", area).filter("area > 1e-9").select(*keys, "polygon_id", "target_id", "e0", "e1", "area", *(f"{c}{i}" for i in (0, 1) for c in "xyz"), *(f"f{i}{c}" for i in (0, 1) for c in "xyz")))
    tri = lambda *ps: F.struct(*(c.alias(f"{n}{m}") for p, n in zip(ps, "abc") for c, m in zip(p, "xyz")))
    quads = q.select(*keys, F.struct("polygon_id", "e0", "e1").alias("quad"), F.posexplode(F.array(tri(p0, p1, f0), tri(p1, f1, f0))).alias("half", "t")).select(*keys, F.struct("quad", "half").alias("_tid"), "t.*")
    tree = S.shape_tree(quads, keys, "_tid", list(mesh.corner_vectors()), k=None)
    hits = S.ray_hits(rays, tree, ["ray_id"], vec("o"), vec("e"), margin)
    counts = hits.groupBy(*keys, F.col("tid.quad").alias("quad")).agg(F.count("*").alias("hits")).select(*keys, "quad.*", "hits")
    out = q.join(counts, [*keys, "polygon_id", "e0", "e1"], "left").join(hit_limit, [*keys, "polygon_id"], "left")
    hits_ = F.coalesce("hits", F.lit(0))
    return out.withColumns({"hits": hits_, "accepted": hits_ / F.col("area") < F.coalesce("max_hits_per_area", F.lit(0.0))})


def project_objects_to_floor(object_vertices: DataFrame, object_triangles: DataFrame, cornered: DataFrame, classes: DataFrame, floor_class: int,
                             keys: Sequence[str] = SCENE, must_be_below: bool = False, max_dist: float | None = None) -> DataFrame:
    """Object triangles whose three corners find the same floor polygon, with that polygon and their corners.

    A corner's floor is the nearest polygon of the class, or with ``must_be_below`` the nearest whose
    midpoint is not above it.  Corners without a floor do not count.
    """
    from atrium.operators import matching

    points = object_vertices.select(*keys, "vertex_id", "x", "y", "z")
    if must_be_below:
        found = matching.next_lower_polygon(points, cornered, keys, ["vertex_id"], classes, floor_class, max_dist=max_dist)
    else:
        found = matching.nearest_polygon_of_class(points, cornered, keys, classes, floor_class, max_dist=max_dist)
    floors = found.filter("polygon_id <> -1").select(*keys, "vertex_id", F.col("polygon_id").alias("plane_id"))
    kept = mesh.same_plane_triangles(object_triangles, floors, keys).withColumnRenamed("plane_id", "floor_polygon_id")
    return mesh.corners(kept, object_vertices, keys)


def ray_obstruction(hits: DataFrame, rays: DataFrame, cornered: DataFrame, inner: DataFrame, areas: DataFrame, ray_id: Sequence[str], margin: float = 0.1, weight: float = 10.0, keys: Sequence[str] = SCENE) -> DataFrame:
    """How far rays run through surfaces: border distance where the hit is near an open edge, else
    the weighted distance of the ray's end to the plane over the polygon's area."""
    j = hits.withColumnRenamed("tid", "triangle_id").join(rays, [*keys, *ray_id]).join(mesh.with_area_normal(cornered), [*keys, "triangle_id"]).join(inner, [*keys, "triangle_id"])
    j = j.join(areas.select(*keys, "polygon_id", F.col("area").alias("polygon_area")), [*keys, "polygon_id"])
    a, b, c = mesh.corner_vectors()
    at = vec("o") + (vec("e") - vec("o")).scale(F.col("t"))
    j = j.withColumns(V.named("h", at))
    h = vec("h")
    rim = [F.when(~F.col(f"inner_{i}"), V.segment_distance2(h, p, q)) for i, (p, q) in enumerate(((a, b), (b, c), (c, a)))]
    border = F.sqrt(F.least(*rim))
    depth = F.abs((vec("e") - a).dot(vec("n")))
    j = j.withColumns({"border": border, "depth": depth})
    near = F.col("border").isNotNull() & (F.col("border") < margin)
    return j.groupBy(*keys, "polygon_id").agg(
        F.count("*").alias("hits"), F.count_if(near).alias("near_border"), F.sum(F.when(near, F.col("border")).otherwise(0.0)).alias("border_sum"),
        F.sum(F.when(near, 0.0).otherwise(F.col("depth") * weight / F.col("polygon_area"))).alias("depth_sum"))


def layout_regularity(triangles: DataFrame, vertices: DataFrame, contour: DataFrame, planes: DataFrame, keys: Sequence[str] = SCENE, threshold: float = 0.2) -> DataFrame:
    """Figures of how regular a scene's polygons are: edge lengths, wedge and plane angles, attraction.

    Attraction sums log(distance / threshold + 1e-6) below the threshold: over all vertex pairs (``magnetism``), over
    vertices and their nearest contour edge that does not end in them (``edge_magnetism``), and over vertices and
    their nearest triangle of a polygon they are not on (``face_magnetism``, where triangles carry a ``polygon_id``).
    Figures without any wedge, plane or near thing are null.
    """
    at = vertices.select(*keys, "vertex_id", "x", "y", "z")
    side = lambda c, s: at.select(*keys, F.col("vertex_id").alias(c), *(F.col(k).alias(f"{k}{s}") for k in "xyz"))
    edges = contour.join(side("e0", "0"), [*keys, "e0"]).join(side("e1", "1"), [*keys, "e1"]).withColumn("_l", (vec(suffix="1") - vec(suffix="0")).norm())
    lengths = edges.groupBy(*keys).agg(F.sum(F.when(F.col("uses") == 1, F.col("_l")).otherwise(0.0)).alias("open_length"), F.sum("_l").alias("contour_length"))
    both = contour.select(*keys, F.explode(F.array(F.struct(F.col("e0").alias("v"), F.col("e1").alias("n")), F.struct(F.col("e1").alias("v"), F.col("e0").alias("n")))).alias("e")).select(*keys, F.col("e.v").alias("vertex_id"), F.col("e.n").alias("neighbor_id"))
    wedges = mesh.edge_wedges(both.distinct(), keys).join(at, [*keys, "vertex_id"]).join(side("n1", "1"), [*keys, "n1"]).join(side("n2", "2"), [*keys, "n2"])
    u, w = (vec(suffix="1") - vec()), (vec(suffix="2") - vec())
    angle = F.degrees(F.acos(V.clamp(u.dot(w) / F.greatest(u.norm() * w.norm(), F.lit(1e-12)), -1, 1)))
    bends = wedges.withColumn("_a", angle).groupBy(*keys).agg(
        F.count("*").alias("wedges"), F.avg(180 - F.col("_a")).alias("straightness"), F.avg(F.least(F.abs(90 - F.col("_a")), 180 - F.col("_a"))).alias("rectangularity"))
    n = plane().n
    off = lambda c: 90 - F.abs(90 - F.degrees(F.acos(V.clamp(c, -1, 1))))
    tilt = planes.groupBy(*keys).agg(F.avg(F.least(off(n.x), off(n.y), off(n.z))).alias("manhattan"), F.avg(F.least(off(n.z), 90 - off(n.z))).alias("up_angle"))
    # all pairs under the threshold are in the same or in touching cells
    cell = lambda k: F.floor(F.col(k) / (threshold * 1.001))
    steps = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    left = at.select(*keys, F.col("vertex_id").alias("i"), *(F.col(k).alias(f"{k}0") for k in "xyz"), *(cell(k).alias(f"c{k}") for k in "xyz"))
    right = at.select(*keys, F.col("vertex_id").alias("j"), *(F.col(k).alias(f"{k}1") for k in "xyz"), *(cell(k).alias(f"c{k}") for k in "xyz"))
    for k in "xyz":
        right = right.withColumn("_d", F.explode(steps)).withColumn(f"c{k}", F.col(f"c{k}") + F.col("_d")).drop("_d")
    pairs = left.join(right, [*keys, "cx", "cy", "cz"]).filter("i < j").withColumn("dist", (vec(suffix="1") - vec(suffix="0")).norm()).filter(F.col("dist") < threshold)
    close = pairs.groupBy(*keys).agg(F.sum(F.log(F.col("dist") / threshold + 1e-6)).alias("magnetism"), F.count("*").alias("close_pairs"))
    out = lengths.join(bends, list(keys), "left").join(tilt, list(keys), "left").join(close, list(keys), "left")
    segments = edges.select(*keys, F.struct("e0", "e1").alias("edge"), *(f"{k}{i}" for i in (0, 1) for k in "xyz"))
    by_edge = S.within(at, S.shape_tree(segments, keys, "edge", [vec(suffix="0"), vec(suffix="1")], k=None), vec(), threshold, S.segment_metric)
    by_edge = by_edge.filter("tid.e0 <> vertex_id AND tid.e1 <> vertex_id")
    out = out.join(attraction(by_edge, threshold, "edge", keys), list(keys), "left")
    if "polygon_id" not in triangles.columns:
        return out
    faces = mesh.corners(triangles, vertices, keys).withColumn("face", F.struct("triangle_id", "polygon_id"))
    by_face = S.within(at, S.shape_tree(faces, keys, "face", list(mesh.corner_vectors()), k=None), vec(), threshold, S.triangle_metric)
    by_face = by_face.groupBy(*keys, "vertex_id", F.col("tid.polygon_id").alias("polygon_id")).agg(F.min("dist").alias("dist"))
    own = triangles.select(*keys, "polygon_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).distinct()
    by_face = by_face.join(own, [*keys, "vertex_id", "polygon_id"], "left_anti")
    return out.join(attraction(by_face, threshold, "face", keys), list(keys), "left")


def attraction(near: DataFrame, threshold: float, name: str, keys: Sequence[str] = SCENE) -> DataFrame:
    """Log sum and number of the vertices whose nearest thing (of ``near``: vertex_id, dist) lies under the threshold."""
    least = near.filter(F.col("dist") < threshold).groupBy(*keys, "vertex_id").agg(F.min("dist").alias("dist"))
    return least.groupBy(*keys).agg(F.sum(F.log(F.col("dist") / threshold + 1e-6)).alias(f"{name}_magnetism"), F.count("*").alias(f"{name}_attracted"))
