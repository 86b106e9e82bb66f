"""Triangle meshes: corners, edges, adjacency, areas, boundaries, compaction and constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.functions.vectors import (
    Vec, named, plane, plane_plane_line, three_plane_point, triangle_normal, vec,
)
from atrium.operators.ranking import dense_index

SCENE = ("scene_id",)


def corners(triangles: DataFrame, vertices: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Triangles with the coordinates of their corners as ``ax..cz``."""
    out = triangles
    for name, corner in zip("abc", ("v0", "v1", "v2")):
        side = vertices.select(
            *keys, F.col("vertex_id").alias(corner), *(F.col(c).alias(f"{name}{c}") for c in "xyz")
        )
        out = out.join(side, [*keys, corner])
    return out.select(*triangles.columns, *(f"{n}{c}" for n in "abc" for c in "xyz"))


def corner_vectors() -> tuple[Vec, Vec, Vec]:
    return vec("a"), vec("b"), vec("c")


def with_area_normal(cornered: DataFrame) -> DataFrame:
    area, n = triangle_normal(*corner_vectors())
    return cornered.withColumns({"area": area, "nx": n.x, "ny": n.y, "nz": n.z})


def corner_rows(triangles: DataFrame, keys: Sequence[str] = SCENE, extra: Sequence[str] = ()) -> DataFrame:
    """One row per triangle corner."""
    return triangles.select(
        *keys, "triangle_id", *extra, F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vertex_id")
    )


def edge_rows(triangles: DataFrame, keys: Sequence[str] = SCENE, extra: Sequence[str] = ()) -> DataFrame:
    """Three undirected edges ``e0 < e1`` per triangle with the slot they come from."""
    pair = lambda u, v: F.struct(F.least(u, v).alias("e0"), F.greatest(u, v).alias("e1"))
    return triangles.select(
        *keys, "triangle_id", *extra,
        F.posexplode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("slot", "edge"),
    ).select(*keys, "triangle_id", *extra, "slot", "edge.e0", "edge.e1")


def edge_uses(triangles: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    return edge_rows(triangles, keys).groupBy(*keys, "e0", "e1").agg(F.count("*").alias("uses"))


def boundary_edges(triangles: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    return edge_uses(triangles, keys).filter("uses = 1").drop("uses")


def watertight_edges(triangles: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    return edge_uses(triangles, keys).filter("uses > 1").drop("uses")


def vertex_plane_sets(vertex_planes: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Plane ids of each vertex, at most three by contract."""
    return vertex_planes.groupBy(*keys, "vertex_id").agg(
        F.sort_array(F.collect_set("plane_id")).alias("planes")
    )


def contour_edges(triangles: DataFrame, plane_sets: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Open edges plus inner edges whose two ends have at least two planes in common."""
    uses = edge_uses(triangles, keys)
    for end, name in (("e0", "p0"), ("e1", "p1")):
        side = plane_sets.select(*keys, F.col("vertex_id").alias(end), F.col("planes").alias(name))
        uses = uses.join(side, [*keys, end], "left")
    shared = F.coalesce(F.size(F.array_intersect("p0", "p1")), F.lit(0))
    return uses.filter((F.col("uses") == 1) | (shared >= 2)).select(*keys, "e0", "e1", "uses")


def inner_edges(triangles: DataFrame, contour: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    return edge_uses(triangles, keys).select(*keys, "e0", "e1").join(
        contour, [*keys, "e0", "e1"], "left_anti"
    )


def inner_edge_mask(triangles: DataFrame, contour: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Per triangle, which of its three edges are not contour edges."""
    marked = edge_rows(triangles, keys).join(
        contour.select(*keys, "e0", "e1", F.lit(True).alias("on_contour")), [*keys, "e0", "e1"], "left"
    )
    inner = F.col("on_contour").isNull()
    return marked.groupBy(*keys, "triangle_id").agg(
        *(F.bool_or(inner & (F.col("slot") == i)).alias(f"inner_{i}") for i in range(3))
    )


def vertex_neighbors(triangles: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Directed vertex adjacency ``(vertex_id, neighbor_id)`` without duplicates."""
    und = edge_rows(triangles, keys).select(*keys, "e0", "e1").distinct()
    both = F.explode(F.array(F.struct("e0", "e1"), F.struct(F.col("e1").alias("e0"), F.col("e0").alias("e1"))))
    return und.select(*keys, both.alias("e")).select(
        *keys, F.col("e.e0").alias("vertex_id"), F.col("e.e1").alias("neighbor_id")
    )


def triangle_neighbors(triangles: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Triangle pairs over edges used by exactly two triangles, in both directions."""
    pairs = (
        edge_rows(triangles, keys)
        .groupBy(*keys, "e0", "e1")
        .agg(F.count("*").alias("n"), F.min("triangle_id").alias("lo"), F.max("triangle_id").alias("hi"))
        .filter("n = 2 AND lo < hi")
    )
    return pairs.selectExpr(
        *keys, "inline(array(struct(lo AS triangle_id, hi AS neighbor_id), struct(hi AS triangle_id, lo AS neighbor_id)))"
    ).distinct()


def edge_wedges(neighbors: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """All pairs of edges meeting in a vertex."""
    fans = neighbors.groupBy(*keys, "vertex_id").agg(F.sort_array(F.collect_list("neighbor_id")).alias("fan"))
    left = F.posexplode("fan").alias("i", "n1")
    return (
        fans.select(*keys, "vertex_id", "fan", left)
        .select(*keys, "vertex_id", "n1", F.explode(F.expr("slice(fan, i + 2, size(fan))")).alias("n2"))
    )


def compact_vertices(vertices: DataFrame, triangles: DataFrame, keys: Sequence[str] = SCENE) -> tuple[DataFrame, DataFrame]:
    """Drop vertices no triangle uses and renumber the rest densely in id order."""
    used = corner_rows(triangles, keys).select(*keys, "vertex_id").distinct()
    ids = dense_index(used, "vertex_id", "new_id", keys)
    kept = vertices.join(ids, [*keys, "vertex_id"]).drop("vertex_id").withColumnRenamed("new_id", "vertex_id")
    return kept, remap_corners(triangles, ids, keys)


def remap_corners(triangles: DataFrame, ids: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Replace corner ids by ``new_id``; triangles with an unmapped corner disappear."""
    out = triangles
    for corner in ("v0", "v1", "v2"):
        side = ids.select(*keys, F.col("vertex_id").alias(corner), F.col("new_id").alias(f"_{corner}"))
        out = out.join(side, [*keys, corner]).drop(corner).withColumnRenamed(f"_{corner}", corner)
    return out.select(*triangles.columns)


def faces_within(triangles: DataFrame, members: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Triangles whose corners are all among ``members(keys, vertex_id)``."""
    hits = corner_rows(triangles, keys).join(members.select(*keys, "vertex_id").distinct(), [*keys, "vertex_id"], "left_semi")
    full = hits.groupBy(*keys, "triangle_id").agg(F.count("*").alias("n")).filter("n = 3").drop("n")
    return triangles.join(full, [*keys, "triangle_id"], "left_semi")


def corner_values(triangles: DataFrame, values: DataFrame, value: str, keys: Sequence[str] = SCENE) -> DataFrame:
    """Attach a per-vertex value of each corner as ``{value}_0..2`` with one shuffle per side."""
    long = corner_rows(triangles, keys).join(values.select(*keys, "vertex_id", value), [*keys, "vertex_id"], "left")
    wide = long.groupBy(*keys, "triangle_id").agg(
        *(F.max(F.when(F.col("corner") == i, F.col(value))).alias(f"{value}_{i}") for i in range(3))
    )
    return triangles.join(wide, [*keys, "triangle_id"])


def same_plane_triangles(triangles: DataFrame, vertex_plane: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Triangles whose three corners carry one and the same plane id >= 0."""
    full = corner_values(triangles, vertex_plane, "plane_id", keys)
    same = (F.col("plane_id_0") >= 0) & (F.col("plane_id_0") == F.col("plane_id_1")) & (F.col("plane_id_0") == F.col("plane_id_2"))
    return full.filter(same).select(*triangles.columns, F.col("plane_id_0").alias("plane_id"))


def flip_misaligned(cornered: DataFrame, planes: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Swap v1 and v2 where the face looks against its polygon's plane normal."""
    joined = with_area_normal(cornered).join(planes, [*keys, "polygon_id"])
    against = vec("n").dot(plane().n) < 0
    return joined.select(
        *keys, "triangle_id", "polygon_id", "v0",
        F.when(against, F.col("v2")).otherwise(F.col("v1")).alias("v1"),
        F.when(against, F.col("v1")).otherwise(F.col("v2")).alias("v2"),
        against.alias("flipped"),
    )


def constraint_order(vertex_planes: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Rank of each plane of a vertex: planes with fewer vertices first, then by id."""
    from pyspark.sql import Window as W

    population = vertex_planes.groupBy(*keys, "plane_id").agg(F.count("*").alias("population"))
    joined = vertex_planes.join(population, [*keys, "plane_id"])
    w = W.partitionBy(*keys, "vertex_id").orderBy("population", "plane_id")
    return joined.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def constrain_vertices(vertices: DataFrame, vertex_planes: DataFrame, planes: DataFrame, keys: Sequence[str] = SCENE) -> DataFrame:
    """Snap each vertex to its planes: free, on one plane, on the line of two, at the point of three."""
    coefficients = vertex_planes.join(
        planes.select(*keys, "plane_id", F.struct("a", "b", "c", "d").alias("eq")), [*keys, "plane_id"]
    )
    lists = coefficients.groupBy(*keys, "vertex_id").agg(F.array_sort(F.collect_list(F.struct("rank", "eq"))).alias("eqs"))
    too_many = F.raise_error(F.concat(F.lit("more than three planes at vertex "), F.col("vertex_id").cast("string")))
    lists = lists.withColumn("eqs", F.when(F.size("eqs") > 3, too_many).otherwise(F.col("eqs")))
    joined = vertices.join(lists, [*keys, "vertex_id"], "left").withColumn(
        "n_planes", F.coalesce(F.size("eqs"), F.lit(0))
    )
    for i, letter in enumerate("pqr"):
        eq = F.get("eqs", F.lit(i))["eq"]
        joined = joined.withColumns({f"{letter}{k}": eq[k] for k in "abcd"})
    p, q, r = (plane(letter) for letter in "pqr")
    v = vec()
    on_plane = v - p.n.scale(p.at(v))
    joined = joined.withColumns(named("f", on_plane))
    point, direction, ok2 = plane_plane_line(p, q)
    joined = joined.withColumns({**named("l", point), **named("u", direction), "ok2": ok2})
    line, along = vec("l"), vec("u")
    on_line = line + along.scale((v - line).dot(along) / F.nullif(along.norm2(), F.lit(0.0)))
    corner, ok3 = three_plane_point(p, q, r)
    joined = joined.withColumns({**named("m", on_line.when(F.col("ok2"), vec("f"))), **named("k", corner), "ok3": ok3})
    fixed = vec("k").when(F.col("ok3"), vec("m"))
    n = F.col("n_planes")
    out = vec("f").when(n == 1, vec("m").when(n == 2, fixed.when(n == 3, v)))
    moved = joined.withColumns(named("o", out))
    return moved.withColumn("displacement", (vec("o") - vec()).norm()).select(
        *keys, "vertex_id", "n_planes", "x", "y", "z", F.col("ox").alias("px"), F.col("oy").alias("py"),
        F.col("oz").alias("pz"), "displacement",
    )


def split_by_class(vertices: DataFrame, triangles: DataFrame, wanted: Sequence[int], keys: Sequence[str] = SCENE, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Sub-mesh of the vertices with a wanted label and the triangles entirely on them, renumbered."""
    kept = vertices.filter(F.col(label).isin(*wanted))
    ids = dense_index(kept.select(*keys, "vertex_id"), "vertex_id", "new_id", keys)
    return (
        kept.join(ids, [*keys, "vertex_id"]).drop("vertex_id").withColumnRenamed("new_id", "vertex_id"),
        remap_corners(triangles, ids, keys),
    )
