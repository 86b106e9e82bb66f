"""Planar rings stored as ``array<struct<x,y>>`` and as edge rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions.vectors import Vec, segment_distance2


def ring_edges(rings: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """One row per edge of a closed ring, last vertex joined to the first."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return rings.select(*keys, F.posexplode(F.arrays_zip(F.col(ring).alias("p"), following.alias("q"))).alias("i", "e")).select(
        *keys, "i", F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1")
    )


def ring_distance2(points: DataFrame, rings: DataFrame, point_keys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Smallest squared distance of each point to the ring it is keyed to."""
    edges = ring_edges(rings, keys)
    zero = F.lit(0.0)
    d2 = segment_distance2(
        Vec(F.col("x"), F.col("y"), zero), Vec(F.col("x0"), F.col("y0"), zero), Vec(F.col("x1"), F.col("y1"), zero)
    )
    return points.join(edges, list(keys)).groupBy(*point_keys).agg(F.min(d2).alias("dist2"))


def crosses_upward(y: Column, x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does the horizontal ray to the right of (x, y) cross the edge (even-odd rule)?"""
    return ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)


def ring_area2(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed area (shoelace) and perimeter per ring."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    return edges.groupBy(*keys).agg((F.sum(cross) / 2).alias("area"), F.sum(length).alias("perimeter"))


def polygon_length(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Perimeter, sum of root lengths, and perimeter with edges shared by planes weighted down."""
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    e = edges.withColumn("_l", length)
    share = F.pow(F.lit(0.1), F.col("n_planes") - 1)
    return e.groupBy(*keys).agg(F.sum("_l").alias("perimeter"), F.sum(F.sqrt("_l")).alias("root_length"),
                                F.sum(F.col("_l") * share).alias("shared_length"))


def ring_lead(rows: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], offset: int = 1) -> DataFrame:
    """Value of the next (or, with offset -1, previous) row of each closed ring.

    Rings are indexed 0..n-1, so the neighbour is an equi join on the shifted index; no ring is
    gathered in one task.
    """
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    at = rows.join(size, list(keys)).withColumn("_next", F.pmod(F.col(order) + offset, F.col("_n")).cast("bigint"))
    other = rows.select(*keys, F.col(order).cast("bigint").alias("_next"), *(F.col(c).alias(n) for c, n in columns.items()))
    return at.join(other, [*keys, "_next"]).drop("_n", "_next")


def contour_angles(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Turning angle in degrees at each vertex of a closed contour, and the length of its next edge."""
    from atrium.functions.vectors import angle_degrees, vec

    full = ring_lead(rows, keys, order, {c: f"{c}_n" for c in "xyz"})
    full = ring_lead(full, keys, order, {c: f"{c}_p" for c in "xyz"}, -1)
    here, ahead, back = vec(), vec(suffix="_n"), vec(suffix="_p")
    step, came = ahead - here, here - back
    cosine = F.when((step.norm() > 0) & (came.norm() > 0), came.dot(step) / came.norm() / step.norm()).otherwise(1.0)
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return full.withColumns({"turn": turn, "next_length": step.norm(), "prev_length": came.norm()})


def edge_boxes(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box of each polygon's edges and the number of height bands they are sorted into."""
    both_y = F.array(F.col("y0"), F.col("y1"))
    return edges.groupBy(*keys).agg(
        F.min(F.least("x0", "x1")).alias("bx0"), F.max(F.greatest("x0", "x1")).alias("bx1"),
        F.min(F.array_min(both_y)).alias("by0"), F.max(F.array_max(both_y)).alias("by1"),
        F.greatest(F.lit(1), F.least(F.lit(4096), F.ceil(F.count("*") / 4))).cast("int").alias("bands"))


def points_in_polygons(points: DataFrame, edges: DataFrame, keys: Sequence[str], point_id: Sequence[str], polygon: str = "polygon_id",
                       boundary: float | None = None) -> DataFrame:
    """(point, polygon) pairs with the point inside by the even-odd rule.

    Pairs come from the polygons' bounding boxes; each pair then meets only the polygon's edges in
    the point's height band, about four on average whatever the polygon's size.  With ``boundary``,
    points that close to an edge count as inside.
    """
    from atrium.operators import spatial as S

    pad = boundary or 0.0
    boxes = edge_boxes(edges, [*keys, polygon])
    zero = F.lit(0.0)
    low, high = Vec(F.col("bx0"), F.col("by0"), zero), Vec(F.col("bx1"), F.col("by1"), zero)
    geom = F.struct(low.struct().alias("lo"), high.struct().alias("hi"))
    tree = S.build_tree(boxes.withColumn("_tid", F.struct(polygon, "by0", "by1", "bands")), keys, "_tid", geom, low, high, k=None)
    q = Vec(F.col("x"), F.col("y"), zero)
    gap = lambda p, g: S.gap2((p, p), (Vec(*(g["lo"][c] for c in "xyz")), Vec(*(g["hi"][c] for c in "xyz"))))
    pairs = S.within(points.select(*keys, *point_id, "x", "y"), tree, q, pad, gap).select(
        *keys, *point_id, "x", "y", "tid.*")
    return inside_pairs(pairs, edges, boxes, keys, [*point_id, "x", "y"], polygon, boundary)


def inside_pairs(pairs: DataFrame, edges: DataFrame, boxes: DataFrame, keys: Sequence[str], point_id: Sequence[str], polygon: str = "polygon_id",
                 boundary: float | None = None) -> DataFrame:
    """Those of the given (point, polygon) pairs with the point inside; pairs and ``boxes`` carry by0, by1 and bands of the polygon."""
    zero, pad = F.lit(0.0), boundary or 0.0
    q = Vec(F.col("x"), F.col("y"), zero)
    band_of = lambda y: F.floor((y - F.col("by0")) / F.when(F.col("by1") > F.col("by0"), F.col("by1") - F.col("by0")).otherwise(1.0) * F.col("bands"))
    clip = lambda b: F.greatest(F.lit(0).cast("bigint"), F.least(b, F.col("bands").cast("bigint") - 1))
    banded = edges.join(boxes.select(*keys, polygon, "by0", "by1", "bands"), [*keys, polygon]).select(
        *keys, polygon, "x0", "y0", "x1", "y1",
        F.explode(F.sequence(clip(band_of(F.least("y0", "y1") - pad)), clip(band_of(F.greatest("y0", "y1") + pad)))).alias("band"))
    placed = pairs.withColumn("band", clip(band_of(F.col("y"))))
    met = placed.join(banded, [*keys, polygon, "band"])
    crossing = crosses_upward(F.col("y"), F.col("x"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    inside = F.sum(crossing.cast("int")) % 2 == 1
    if boundary is not None:
        d2 = segment_distance2(q, Vec(F.col("x0"), F.col("y0"), zero), Vec(F.col("x1"), F.col("y1"), zero), 1e-18)
        inside = inside | (F.min(d2) <= boundary * boundary)
    return met.groupBy(*keys, *point_id, polygon).agg(inside.alias("_in")).filter("_in").drop("_in")
