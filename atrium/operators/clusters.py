"""Density clustering, window candidates, stair regions and local shape features."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions.eigen import eigen_of_moments, moment_sums
from atrium.functions.vectors import Vec, vec, vec_of
from atrium.operators import graphs
from atrium.operators import spatial as S
from atrium.operators.ranking import dense_index
from atrium.session import cut_lineage

# Clustering of window evidence and stair components.
WINDOW_EPS, WINDOW_SAMPLES, WINDOW_MIN_SIZE = 0.35, 10, 0.30
STAIR_MIN_TRIANGLES = 10


def dbscan(points: DataFrame, keys: Sequence[str], point_id: str, u: str = "u", z: str = "z", eps: float = WINDOW_EPS, min_samples: int = WINDOW_SAMPLES) -> DataFrame:
    """Cluster number (-1 for noise) and core flag per point.

    A point is core if its ``min_samples``-th neighbour (itself included) is within ``eps``, which
    needs that many neighbours and not all of them.  Space is cut into cells whose diagonal is
    ``eps``: core points of one cell belong together without looking at pairs, and two cells are
    linked if some core point of one has its nearest core point of the other within ``eps``.
    Border points join the lowest-numbered cluster in reach; clusters are numbered by their
    smallest core point.
    """
    side = eps / math.sqrt(2.0)
    flat = points.select(*keys, point_id, F.col(u).alias("x"), F.col(z).alias("y"), F.lit(0.0).alias("z"))
    flat = flat.withColumns({"ci": F.floor(F.col("x") / side), "cj": F.floor(F.col("y") / side)})
    tree = S.point_tree(flat, keys, point_id, vec(), min_samples)
    core = S.knn(flat, tree, vec(), k=min_samples, max_dist=eps).withColumn("is_core", F.size("hits") >= min_samples).drop("hits")
    core = cut_lineage(core)
    cell = [*keys, "ci", "cj"]
    cells = core.filter("is_core").groupBy(*cell).agg(F.min(point_id).alias("first_point"))
    reach = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)))
    asks = core.select("*", F.explode(reach).alias("o")).select(
        *keys, point_id, "x", "y", "z", "is_core", F.col("ci").alias("hi"), F.col("cj").alias("hj"),
        (F.col("ci") + F.col("o.i")).alias("ci"), (F.col("cj") + F.col("o.j")).alias("cj"))
    asks = asks.filter("NOT (is_core AND ci = hi AND cj = hj)").join(cells, cell, "left_semi")
    core_tree = S.point_tree(core.filter("is_core"), cell, point_id, vec())
    near = S.nearest(asks, core_tree, vec(), max_dist=eps)
    near = cut_lineage(near.select(*keys, point_id, "is_core", "hi", "hj", "ci", "cj").distinct())
    code = lambda i, j: (F.col(i) * F.lit(1 << 32) + F.col(j))
    links = near.filter("is_core").select(*keys, code("hi", "hj").alias("a"), code("ci", "cj").alias("b")).distinct()
    nodes = cells.select(*keys, code("ci", "cj").alias("cell"), "first_point")
    comp = graphs.connected_components(links, nodes, keys, "cell", "a", "b").join(nodes, [*keys, "cell"])
    firsts = comp.groupBy(*keys, "component").agg(F.min("first_point").alias("first_point"))
    number = dense_index(firsts, "first_point", "cluster", keys)
    numbered = comp.select(*keys, "cell", "component").join(firsts.join(number, [*keys, "first_point"]), [*keys, "component"]).select(*keys, "cell", "cluster")
    inside = core.filter("is_core").select(*keys, point_id, code("ci", "cj").alias("cell"))
    border = near.filter("NOT is_core").select(*keys, point_id, code("ci", "cj").alias("cell"))
    found = inside.unionByName(border).join(numbered, [*keys, "cell"]).groupBy(*keys, point_id).agg(F.min("cluster").alias("cluster"))
    return core.select(*keys, point_id, "is_core").join(found, [*keys, point_id], "left").withColumn(
        "cluster", F.coalesce("cluster", F.lit(-1)).cast("bigint"))


def wall_axis(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Main horizontal direction and centre of the points of each wall."""
    m = points.groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("_vx"),
        F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_c"))
    t = F.lit(0.5) * F.atan2(2 * F.col("_c"), F.col("_vx") - F.col("_vy"))
    return m.withColumn("_t", t).select(*keys, "n_points", "mx", "my", F.cos("_t").alias("ux"), F.sin("_t").alias("uy"))


def window_candidates(wall_points: DataFrame, keys: Sequence[str], point_id: str, eps: float = WINDOW_EPS,
                      min_samples: int = WINDOW_SAMPLES, min_size: float = WINDOW_MIN_SIZE) -> DataFrame:
    """Window rectangles per wall from evidence points near it.

    Points are laid along the wall's main axis, clustered in (along, height), and clusters larger
    than the minimum size both ways become rectangles.
    """
    axis = wall_axis(wall_points, keys).filter(F.col("n_points") >= min_samples)
    laid = wall_points.join(axis, list(keys)).withColumn("u", (F.col("x") - F.col("mx")) * F.col("ux") + (F.col("y") - F.col("my")) * F.col("uy"))
    laid = cut_lineage(laid)
    found = dbscan(laid, keys, point_id, "u", "z", eps, min_samples).filter("cluster >= 0")
    ext = laid.join(found.select(*keys, point_id, "cluster"), [*keys, point_id]).groupBy(*keys, "cluster", "mx", "my", "ux", "uy").agg(
        F.count("*").alias("point_count"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    sized = ext.withColumns({"width_meters": F.col("u1") - F.col("u0"), "height_meters": F.col("z1") - F.col("z0")}).filter(
        (F.col("point_count") >= min_samples) & (F.col("width_meters") > min_size) & (F.col("height_meters") > min_size))
    at = lambda t, h: F.struct((F.col("mx") + F.col(t) * F.col("ux")).alias("x"), (F.col("my") + F.col(t) * F.col("uy")).alias("y"), F.col(h).alias("z"))
    return sized.select(*keys, "cluster", "point_count", "width_meters", "height_meters",
                        F.array(at("u0", "z0"), at("u1", "z0"), at("u1", "z1"), at("u0", "z1")).alias("vertices"))


def hull(xy: np.ndarray, directions: int = 32) -> np.ndarray:
    """Convex hull of planar points, counter-clockwise.

    Points inside the polygon of the extremes in some directions are dropped all at once; the chain then sees the rest.
    """
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts
    turn = np.arange(directions) * (2 * np.pi / directions)
    rim = pts[np.argmax(pts @ np.stack([np.cos(turn), np.sin(turn)]), axis=0)]
    side = np.roll(rim, -1, axis=0) - rim
    side, rim = side[np.any(side != 0, axis=1)], rim[np.any(side != 0, axis=1)]
    inside = np.ones(len(pts), bool)
    for (ux, uy), (px, py) in zip(side, rim):
        inside &= ux * (pts[:, 1] - py) - uy * (pts[:, 0] - px) > 0
    pts = pts[~inside]
    chains = []
    for ordered in (pts.tolist(), pts[::-1].tolist()):
        chain: list[list[float]] = []
        for x, y in ordered:
            while len(chain) >= 2:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                chain.pop()
            chain.append([x, y])
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


def smallest_rectangle(corners: np.ndarray) -> np.ndarray | None:
    """Corners of the smallest rectangle around a hull; one side lies on a hull edge."""
    if len(corners) < 3:
        return None
    edges = np.roll(corners, -1, axis=0) - corners
    dirs = edges / np.linalg.norm(edges, axis=1, keepdims=True)
    normals = np.stack([-dirs[:, 1], dirs[:, 0]], axis=1)
    along, across = corners @ dirs.T, corners @ normals.T
    lo_u, hi_u, lo_v, hi_v = along.min(0), along.max(0), across.min(0), across.max(0)
    i = int(np.argmin((hi_u - lo_u) * (hi_v - lo_v)))
    box = [(lo_u[i], lo_v[i]), (hi_u[i], lo_v[i]), (hi_u[i], hi_v[i]), (lo_u[i], hi_v[i])]
    return np.array([u * dirs[i] + v * normals[i] for u, v in box])


def min_rectangles(points: DataFrame, keys: Sequence[str], chunk: int = 50_000) -> DataFrame:
    """Smallest rotated rectangle of each group of (x, y) points.

    Large groups are first cut by hash into chunks whose hulls replace them, so the final task of a
    group sees hull corners only.
    """
    size = points.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).alias("_parts"))
    cut = points.select(*keys, "x", "y").distinct().join(size, list(keys))
    cut = cut.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.col("_parts"))).drop("_parts")
    schema = points.select(*keys, "x", "y").schema

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy(float))
        out = pd.DataFrame(h, columns=["x", "y"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "x", "y"]]

    corners = cut.groupBy(*keys, "_part").applyInPandas(partial, schema)
    rect_schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if f.name in keys] + ["rectangle array<array<double>>", "area double"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        box = smallest_rectangle(hull(pdf[["x", "y"]].to_numpy(float)))
        row = {k: pdf[k].iloc[0] for k in keys}
        row["area"] = 0.0 if box is None else float(np.linalg.norm(box[1] - box[0]) * np.linalg.norm(box[3] - box[0]))
        row["rectangle"] = None if box is None else box.tolist()
        return pd.DataFrame([row])[[*keys, "rectangle", "area"]]

    return corners.groupBy(*keys).applyInPandas(final, rect_schema)


def stair_regions(triangles: DataFrame, vertices: DataFrame, keys: Sequence[str], min_triangles: int = STAIR_MIN_TRIANGLES,
                  rooms: DataFrame | None = None, max_dist: float = 0.75) -> DataFrame:
    """Connected stair components with their rectangle, its area and height range, or the reason they were rejected.

    Accepted ones are numbered by component (``stair_region_id``).  With ``rooms`` (keys, room_id, x0, y0, x1, y1) they
    carry ``room_ids``: all within ``max_dist`` of the rectangle's centre, else the nearest; null where a scene has none.
    """
    from atrium.operators import matching, mesh
    from atrium.operators.maintenance import mesh_components

    member = mesh_components(triangles, keys)
    sizes = member.groupBy(*keys, "component").agg(F.count("*").alias("triangle_count"))
    used = mesh.corner_rows(triangles, keys).join(member, [*keys, "triangle_id"]).select(*keys, "component", "vertex_id").distinct()
    pts = used.join(vertices.select(*keys, "vertex_id", "x", "y", "z"), [*keys, "vertex_id"])
    large = sizes.filter(F.col("triangle_count") >= min_triangles)
    pts = pts.join(large, [*keys, "component"], "left_semi")
    heights = pts.groupBy(*keys, "component").agg(F.min("z").alias("minimum_z"), F.max("z").alias("maximum_z"))
    boxes = min_rectangles(pts, [*keys, "component"])
    out = sizes.join(heights, [*keys, "component"], "left").join(boxes, [*keys, "component"], "left")
    status = (F.when(F.col("triangle_count") < min_triangles, "rejected_too_few_triangles")
              .when(F.coalesce("area", F.lit(0.0)) <= 1e-8, "rejected_degenerate_rectangle").otherwise("accepted"))
    out = cut_lineage(out.withColumn("status", status))
    taken = out.filter("status = 'accepted'")
    number = dense_index(taken, "component", "_number", keys).select(*keys, "component", F.format_string("stair_region_%03d", "_number").alias("stair_region_id"))
    out = out.join(number, [*keys, "component"], "left")
    if rooms is None:
        return out
    middle = lambda i: F.aggregate("rectangle", F.lit(0.0), lambda total, p: total + p[i]) / F.size("rectangle")
    centers = taken.select(*keys, "component", middle(0).alias("x"), middle(1).alias("y"))
    return out.join(matching.rooms_near(centers, rooms, keys, ["component"], max_dist), [*keys, "component"], "left")


def local_geometry_features(vertices: DataFrame, k: int, keys: Sequence[str], radius: float | None = None) -> DataFrame:
    """Linearity, planarity, scattering and verticality from each vertex's k nearest neighbours."""
    at = F.struct("vertex_id", "x", "y", "z")
    tree = S.point_tree(vertices, keys, at, vec(), k)
    found = S.knn(vertices.select(*keys, "vertex_id", "x", "y", "z"), tree, vec(), k=k, max_dist=radius)
    long = found.select(*keys, "vertex_id", Vec(*map(F.col, "xyz")).struct().alias("o"), F.explode("hits.tid").alias("n"))
    rel = vec_of(F.col("n")) - vec_of(F.col("o"))  # relative coordinates keep the covariance exact
    m = long.groupBy(*keys, "vertex_id").agg(*moment_sums(rel)).withColumn("e", eigen_of_moments())
    l0, l1, l2 = (F.greatest(F.col(f"e.l{i}"), F.lit(0.0)) for i in range(3))
    safe = F.greatest(l2, F.lit(1e-30))
    return m.select(*keys, "vertex_id", ((l2 - l1) / safe).alias("linearity"), ((l1 - l0) / safe).alias("planarity"),
                    (l0 / safe).alias("scattering"), (1 - F.abs(F.col("e.nz"))).alias("verticality"))
