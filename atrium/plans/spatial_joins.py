"""Registered queries: nearest, range, ray and point-in-polygon joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions import vectors as V
from atrium.functions.text import short_number
from atrium.functions.vectors import r6
from atrium.operators import mesh, spatial as S
from atrium.plans.registry import query, r

D2 = "(({q}.x-{p}.x)*({q}.x-{p}.x) + ({q}.y-{p}.y)*({q}.y-{p}.y) + ({q}.z-{p}.z)*({q}.z-{p}.z))"
SC = ["scene_id"]

NEAREST_SQL = f"""q AS (SELECT DISTINCT scene_id, x, y, z FROM fx_rays),
n AS (SELECT q.scene_id, q.x, q.y, q.z, arg_min(v.vertex_id, (least({D2.format(q='q', p='v')}, 1e18), v.vertex_id)) AS vertex_id,
    min({D2.format(q='q', p='v')}) AS d2 FROM q JOIN fx_vertices v ON v.scene_id = q.scene_id GROUP BY ALL),
hit AS (SELECT r.*, n.vertex_id, sqrt(n.d2) AS dist FROM fx_rays r JOIN n ON n.scene_id = r.scene_id AND n.x = r.x AND n.y = r.y AND n.z = r.z)"""


def vertex_tree(t, k=1):
    return S.point_tree(t.vertices, SC, "vertex_id", V.vec(), k)


def nearest_vertices(t):
    return S.nearest(t.rays, vertex_tree(t), V.vec(), tid="vertex_id")


@query("nearest_vertex", f"WITH {NEAREST_SQL} SELECT scene_id, x, y, z, label, vertex_id, {r('dist')} AS dist FROM hit")
def _(t):
    return nearest_vertices(t).select("scene_id", "x", "y", "z", "label", "vertex_id", r6(F.col("dist")).alias("dist"))


@query("knn_probabilities", f"""
WITH d AS (SELECT v.scene_id, v.vertex_id, r.label, {D2.format(q='v', p='r')} AS d2 FROM fx_vertices v JOIN fx_rays r ON r.scene_id = v.scene_id),
k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, vertex_id ORDER BY d2, label) AS rn FROM d)
SELECT vertex_id, label, {r('count(*) / 5.0')} AS p FROM k WHERE rn <= 5 GROUP BY vertex_id, label""")
def _(t):
    from atrium.operators.semantics import knn_probabilities

    return knn_probabilities(t.vertices, t.rays, SC, 5).select("vertex_id", "label", r6(F.col("p")).alias("p"))


def self_knn(t, k, radius=None):
    found = S.knn(t.vertices, vertex_tree(t, k), V.vec(), k=k, max_dist=radius)
    return found.select("scene_id", "vertex_id", F.posexplode("hits").alias("rank", "h")).select(
        "scene_id", "vertex_id", "rank", F.col("h.tid").alias("neighbor_id"), F.sqrt("h.d2").alias("dist"))


SELF_SQL = f"""d AS (SELECT v.scene_id, v.vertex_id, w.vertex_id AS neighbor_id, {D2.format(q='v', p='w')} AS d2 FROM fx_vertices v JOIN fx_vertices w ON v.scene_id = w.scene_id),
k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, vertex_id ORDER BY d2, neighbor_id) - 1 AS rank FROM d)"""


@query("knn_self", f"WITH {SELF_SQL} SELECT vertex_id, CAST(rank AS INT) AS rank, neighbor_id, {r('sqrt(d2)')} AS dist FROM k WHERE rank < 10")
def _(t):
    return self_knn(t, 10).select("vertex_id", "rank", "neighbor_id", r6(F.col("dist")).alias("dist"))


@query("knn_self_radius", f"WITH {SELF_SQL} SELECT vertex_id, CAST(rank AS INT) AS rank, neighbor_id, {r('sqrt(d2)')} AS dist FROM k WHERE rank < 15 AND d2 <= 0.4::DOUBLE * 0.4::DOUBLE")
def _(t):
    return self_knn(t, 15, 0.4).select("vertex_id", "rank", "neighbor_id", r6(F.col("dist")).alias("dist"))


# ---- second part: edges, triangles, rays, polygons ---------------------------------------------------

from atrium.operators import maintenance as M  # noqa: E402
from atrium.operators import matching, polygons  # noqa: E402


@query("merge_candidates", f"""
WITH {SELF_SQL} SELECT DISTINCT least(vertex_id, neighbor_id) AS i, greatest(vertex_id, neighbor_id) AS j, {r('sqrt(d2)')} AS dist
FROM k WHERE rank < 10 AND vertex_id <> neighbor_id AND sqrt(d2) < 0.4::DOUBLE""")
def _(t):
    return M.merge_candidates(t.vertices, 0.4).select("i", "j", r6(F.col("dist")).alias("dist"))


def plain_vertices(t):
    return t.vertices.selectExpr("0L AS scene_id", "vertex_id", "x", "y", "z")


def plain_mesh_vertices(t):
    return t.mesh_vertices.selectExpr("scene_id", "vertex_id AS mesh_vertex_id", "x", "y", "z")


PAIR_SQL = f"""pd AS (SELECT v.vertex_id, w.vertex_id AS mesh_vertex_id, {D2.format(q='v', p='w')} AS d2 FROM fx_vertices v, fx_mesh_vertices w),
pl AS (SELECT vertex_id, arg_min(mesh_vertex_id, (d2, mesh_vertex_id)) AS mesh_vertex_id, min(d2) AS d2 FROM pd GROUP BY 1),
pr AS (SELECT mesh_vertex_id, arg_min(vertex_id, (d2, vertex_id)) AS vertex_id, min(d2) AS d2 FROM pd GROUP BY 1)"""


@query("knn_bruteforce", f"""
WITH pd AS (SELECT v.vertex_id, w.vertex_id AS mesh_vertex_id, {D2.format(q='v', p='w')} AS d2 FROM fx_vertices v, fx_mesh_vertices w),
k AS (SELECT *, row_number() OVER (PARTITION BY vertex_id ORDER BY d2, mesh_vertex_id) - 1 AS rank FROM pd)
SELECT vertex_id, CAST(rank AS INT) AS rank, {r('sqrt(d2)')} AS dist FROM k WHERE rank < 3""")
def _(t):
    tree = S.point_tree(plain_mesh_vertices(t), SC, "mesh_vertex_id", V.vec(), 3)
    out = S.knn(plain_vertices(t), tree, V.vec(), k=3)
    return out.select("vertex_id", F.posexplode("hits").alias("rank", "h")).select("vertex_id", "rank", r6(F.sqrt("h.d2")).alias("dist"))


@query("mutual_nearest", f"WITH {PAIR_SQL} SELECT pl.vertex_id, pl.mesh_vertex_id, {r('sqrt(pl.d2)')} AS dist FROM pl JOIN pr ON pr.vertex_id = pl.vertex_id AND pr.mesh_vertex_id = pl.mesh_vertex_id")
def _(t):
    out = M.mutual_nearest(plain_vertices(t), plain_mesh_vertices(t), SC, "vertex_id", "mesh_vertex_id")
    return out.select("vertex_id", "mesh_vertex_id", r6(F.col("dist")).alias("dist"))


@query("truncated_chamfer", f"""
WITH {PAIR_SQL}
SELECT {r('(SELECT avg(sqrt(d2)) FROM pl WHERE sqrt(d2) < 2)')} AS left_to_right, {r('(SELECT avg(sqrt(d2)) FROM pr WHERE sqrt(d2) < 2)')} AS right_to_left,
  (SELECT count(*) FROM pl WHERE sqrt(d2) < 2) AS n_left_to_right, (SELECT count(*) FROM pr WHERE sqrt(d2) < 2) AS n_right_to_left""")
def _(t):
    out = M.chamfer(plain_vertices(t), plain_mesh_vertices(t), SC, 2.0)
    return out.select(*(r6(F.col(c)).alias(c) for c in ("left_to_right", "right_to_left")), "n_left_to_right", "n_right_to_left")


@query("windowed_nearest", f"""
WITH pd AS (SELECT v.vertex_id, {D2.format(q='v', p='w')} AS d2 FROM fx_vertices v, fx_mesh_vertices w WHERE (v.x >= 2.5) = (w.x >= 2.5) AND (v.y >= 2) = (w.y >= 2))
SELECT v.vertex_id, {r('sqrt(min(d2))')} AS dist FROM fx_vertices v LEFT JOIN pd ON pd.vertex_id = v.vertex_id GROUP BY 1""")
def _(t):
    out = M.windowed_nearest(plain_vertices(t), plain_mesh_vertices(t), SC, {"x": 2.5, "y": 2.0}, "mesh_vertex_id")
    return out.select("vertex_id", r6(F.col("dist")).alias("dist"))


def boundary_segments(t):
    edges = mesh.boundary_edges(t.triangles)
    for i, end in enumerate(("e0", "e1")):
        side = t.mesh_vertices.select("scene_id", F.col("vertex_id").alias(end), *(F.col(c).alias(f"{c}{i}") for c in "xyz"))
        edges = edges.join(side, ["scene_id", end])
    return edges.withColumn("edge_id", F.col("e0") * 100000 + F.col("e1"))


SEG_T = "(CASE WHEN (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) < 1e-8 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((m.x-p.x)*(q.x-p.x) + (m.y-p.y)*(q.y-p.y) + (m.z-p.z)*(q.z-p.z)) / ((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z)))) END)"


@query("nearest_edge", f"""
WITH b AS (SELECT e0, e1 FROM fx_edges GROUP BY ALL HAVING count(*) = 1),
d0 AS (SELECT m.vertex_id, m.x, m.y, m.z, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS byy, q.z AS bz, {SEG_T} AS t FROM fx_mesh_vertices m, b JOIN fx_mesh_vertices p ON p.vertex_id = e0 JOIN fx_mesh_vertices q ON q.vertex_id = e1),
d AS (SELECT vertex_id, (x-(ax+(bx-ax)*t))*(x-(ax+(bx-ax)*t)) + (y-(ay+(byy-ay)*t))*(y-(ay+(byy-ay)*t)) + (z-(az+(bz-az)*t))*(z-(az+(bz-az)*t)) AS d2 FROM d0),
k AS (SELECT *, row_number() OVER (PARTITION BY vertex_id ORDER BY d2) - 1 AS rank FROM d WHERE d2 > 1e-16)
SELECT vertex_id, CAST(rank AS INT) AS rank, {r('sqrt(d2)')} AS dist FROM k WHERE rank < 3""")
def _(t):
    out = M.nearest_edges(t.mesh_vertices, boundary_segments(t), 3, SC, "vertex_id", "edge_id")
    return out.select("vertex_id", "rank", r6(F.col("dist")).alias("dist"))


# squared point-triangle distance of every vertex to every triangle (alias v and t)
TRI_SQL = """tp AS (SELECT v.vertex_id, v.x AS px, v.y AS py, v.z AS pz, t.* FROM {points} v, {tris} t),
ts AS (SELECT *, nx*nx + ny*ny + nz*nz AS n2, (px-ax)*nx + (py-ay)*ny + (pz-az)*nz AS h,
  ((py-ay)*(cz-az)-(pz-az)*(cy-ay))*nx + ((pz-az)*(cx-ax)-(px-ax)*(cz-az))*ny + ((px-ax)*(cy-ay)-(py-ay)*(cx-ax))*nz AS bv,
  ((by-ay)*(pz-az)-(bz-az)*(py-ay))*nx + ((bz-az)*(px-ax)-(bx-ax)*(pz-az))*ny + ((bx-ax)*(py-ay)-(by-ay)*(px-ax))*nz AS bw,
  greatest(0, least(1, ((px-ax)*(bx-ax) + (py-ay)*(by-ay) + (pz-az)*(bz-az)) / ((bx-ax)*(bx-ax) + (by-ay)*(by-ay) + (bz-az)*(bz-az)))) AS t0,
  greatest(0, least(1, ((px-bx)*(cx-bx) + (py-by)*(cy-by) + (pz-bz)*(cz-bz)) / ((cx-bx)*(cx-bx) + (cy-by)*(cy-by) + (cz-bz)*(cz-bz)))) AS t1,
  greatest(0, least(1, ((px-cx)*(ax-cx) + (py-cy)*(ay-cy) + (pz-cz)*(az-cz)) / ((ax-cx)*(ax-cx) + (ay-cy)*(ay-cy) + (az-cz)*(az-cz)))) AS t2 FROM tp),
td AS (SELECT vertex_id, triangle_id, polygon_id, pz, CASE WHEN bv >= 0 AND bw >= 0 AND bv + bw <= n2 THEN h*h/n2 ELSE least(
  pow(px-(ax+(bx-ax)*t0), 2) + pow(py-(ay+(by-ay)*t0), 2) + pow(pz-(az+(bz-az)*t0), 2),
  pow(px-(bx+(cx-bx)*t1), 2) + pow(py-(by+(cy-by)*t1), 2) + pow(pz-(bz+(cz-bz)*t1), 2),
  pow(px-(cx+(ax-cx)*t2), 2) + pow(py-(cy+(ay-cy)*t2), 2) + pow(pz-(cz+(az-cz)*t2), 2)) END AS d2 FROM ts)"""
ALL_TRI = TRI_SQL.format(points="fx_vertices", tris="fx_normals")


def cornered(t):
    return mesh.corners(t.triangles, t.mesh_vertices)


@query("nearest_triangle", f"""
WITH {ALL_TRI}, k AS (SELECT *, row_number() OVER (PARTITION BY vertex_id ORDER BY d2) - 1 AS rank FROM td)
SELECT vertex_id, CAST(rank AS INT) AS rank, {r('sqrt(d2)')} AS dist FROM k WHERE rank < 3""")
def _(t):
    out = S.knn(plain_vertices(t), M.triangle_tree(cornered(t), k=3), V.vec(), S.triangle_metric, k=3)
    return out.select("vertex_id", F.posexplode("hits").alias("rank", "h")).select("vertex_id", "rank", r6(F.sqrt("h.d2")).alias("dist"))


@query("closest_face", f"""
WITH {ALL_TRI}, k AS (SELECT vertex_id, min(d2) AS d2 FROM td WHERE triangle_id IN (SELECT triangle_id FROM fx_normals WHERE 0.5 * sqrt(nx*nx + ny*ny + nz*nz) >= 0.006) GROUP BY 1)
SELECT vertex_id, d2 <= 30 AS has_face, {r('sqrt(d2)')} AS dist FROM k""")
def _(t):
    out = M.closest_face(plain_vertices(t), cornered(t), 30.0, 6e-3)
    return out.select("vertex_id", (F.col("triangle_id") >= 0).alias("has_face"), r6(F.col("dist")).alias("dist"))


@query("closest_triangle_inside", f"""
WITH {ALL_TRI} SELECT vertex_id, {r('sqrt(min(d2))')} AS dist FROM td GROUP BY 1""")
def _(t):
    return M.closest_triangle_inside(plain_vertices(t), cornered(t)).select("vertex_id", r6(F.col("dist")).alias("dist"))


@query("distance_to_mesh", f"WITH {ALL_TRI}, m AS (SELECT vertex_id, sqrt(min(d2)) AS d FROM td GROUP BY 1) SELECT {r('min(d)')} AS min, {r('avg(d)')} AS mean, {r('max(d)')} AS max FROM m")
def _(t):
    out = S.nearest(plain_vertices(t), M.triangle_tree(cornered(t)), V.vec(), S.triangle_metric)
    return out.agg(r6(F.min("dist")).alias("min"), r6(F.avg("dist")).alias("mean"), r6(F.max("dist")).alias("max"))


@query("point_mesh_distance", f"WITH {ALL_TRI}, m AS (SELECT vertex_id, min(d2) AS d FROM td GROUP BY 1) SELECT count(*) AS n, {r('avg(d)')} AS mean_d2 FROM m WHERE sqrt(d) <= 5")
def _(t):
    return M.point_mesh_distance(plain_vertices(t), cornered(t), max_dist=5.0).select("n", r6(F.col("mean_d2")).alias("mean_d2"))


def room_rays(t):
    """Rays from (2.5, 2, 3) down to the mesh vertices, slightly past them."""
    return t.mesh_vertices.selectExpr("scene_id", "vertex_id", "2.5D AS ox", "2D AS oy", "3D AS oz", "x + 0.013 AS ex", "y + 0.017 AS ey", "z - 0.4 AS ez")


RAY_SQL = """rr AS (SELECT vertex_id, 2.5::DOUBLE AS ox, 2.0::DOUBLE AS oy, 3.0::DOUBLE AS oz, x + 0.013::DOUBLE - 2.5 AS dx, y + 0.017::DOUBLE - 2 AS dy, z - 0.4::DOUBLE - 3 AS dz FROM fx_mesh_vertices),
rt AS (SELECT rr.*, t.*, dy*(cz-az)-dz*(cy-ay) AS hx, dz*(cx-ax)-dx*(cz-az) AS hy, dx*(cy-ay)-dy*(cx-ax) AS hz FROM rr, fx_corners t),
ru AS (SELECT *, (bx-ax)*hx + (by-ay)*hy + (bz-az)*hz AS det, (oy-ay)*(bz-az)-(oz-az)*(by-ay) AS qx, (oz-az)*(bx-ax)-(ox-ax)*(bz-az) AS qy, (ox-ax)*(by-ay)-(oy-ay)*(bx-ax) AS qz FROM rt),
rv AS (SELECT vertex_id, triangle_id, dx, dy, dz, ((ox-ax)*hx+(oy-ay)*hy+(oz-az)*hz)/det AS u, (dx*qx+dy*qy+dz*qz)/det AS v, ((cx-ax)*qx+(cy-ay)*qy+(cz-az)*qz)/det AS t FROM ru WHERE abs(det) > 1e-12),
hit AS (SELECT vertex_id, any_value(dx) AS dx, any_value(dy) AS dy, any_value(dz) AS dz, min(t) AS t, arg_min(triangle_id, (t, triangle_id)) AS triangle_id FROM rv WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t >= 0 AND t < 1 GROUP BY 1)"""


def ray_hits(t, margin=0.05):
    o, d = V.vec("o"), V.vec("e")
    return S.ray_hits(room_rays(t), M.triangle_tree(cornered(t)), ["vertex_id"], o, d, margin)


@query("ray_triangle_hits", f"WITH {RAY_SQL} SELECT vertex_id, triangle_id, {r('t')} AS t, {r('(1-t)*sqrt(dx*dx+dy*dy+dz*dz)')} AS overshoot FROM hit WHERE (1-t)*sqrt(dx*dx+dy*dy+dz*dz) >= 0.05")
def _(t):
    return ray_hits(t).select("vertex_id", F.col("tid").alias("triangle_id"), r6(F.col("t")).alias("t"), r6(F.col("overshoot")).alias("overshoot"))


@query("hits_per_polygon", f"WITH {RAY_SQL} SELECT polygon_id, count(*) AS n FROM hit JOIN fx_triangles t ON t.triangle_id = hit.triangle_id WHERE (1-t)*sqrt(dx*dx+dy*dy+dz*dz) >= 0.05 GROUP BY 1")
def _(t):
    hits = ray_hits(t).withColumnRenamed("tid", "triangle_id")
    return hits.join(t.triangles, ["scene_id", "triangle_id"]).groupBy("polygon_id").agg(F.count("*").alias("n"))


def slanted_rooms(t):
    rings = t.rooms.selectExpr("0 AS level_id", "room_key AS polygon_id", "array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y0 + 1 AS y), struct(x1 + 1 AS x, y1 AS y), struct(x0 AS x, y1 AS y)) AS ring")
    return polygons.ring_edges(rings, ["level_id", "polygon_id"])


SLANT = "se AS (SELECT room_key, unnest([[x0,y0,x1,y0+1],[x1,y0+1,x1+1,y1],[x1+1,y1,x0,y1],[x0,y1,x0,y0]]) AS e FROM fx_rooms)"


@query("point_in_polygon", f"""
WITH {SLANT} SELECT vertex_id, room_key AS polygon_id FROM fx_vertices v, se WHERE (e[2] > y) <> (e[4] > y) AND x < (e[3]-e[1])*(y-e[2])/(e[4]-e[2]) + e[1] GROUP BY ALL HAVING count(*) % 2 = 1""")
def _(t):
    pts = t.vertices.selectExpr("0 AS level_id", "vertex_id", "x", "y")
    return polygons.points_in_polygons(pts, slanted_rooms(t), ["level_id"], ["vertex_id"]).select("vertex_id", "polygon_id")


def ceiling_edges(t):
    rings = t.ceilings.selectExpr("0 AS level_id", "polygon_id", "array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y0 AS y), struct(x1 AS x, y1 AS y), struct(x0 AS x, y1 AS y)) AS ring")
    return polygons.ring_edges(rings, ["level_id", "polygon_id"])


@query("assign_ceiling", f"""
WITH j AS (SELECT v.vertex_id, c.polygon_id, -(a*v.x + b*v.y + d)/c AS z FROM fx_vertices v JOIN fx_ceilings c
    ON v.x BETWEEN x0 - 1e-8 AND x1 + 1e-8 AND v.y BETWEEN y0 - 1e-8 AND y1 + 1e-8 AND -(a*v.x + b*v.y + d)/c > 1.5 + 1e-4),
m AS (SELECT vertex_id, min(z) AS z FROM j GROUP BY 1)
SELECT v.vertex_id, m.z IS NULL AS is_fallback, {r('coalesce(m.z, 2.7)')} AS ceiling_z FROM fx_vertices v LEFT JOIN m ON m.vertex_id = v.vertex_id""")
def _(t):
    pts = t.vertices.selectExpr("0 AS level_id", "vertex_id", "x", "y")
    out = matching.assign_ceiling(pts, t.ceilings.withColumn("level_id", F.lit(0)), ceiling_edges(t), ["level_id"], ["vertex_id"], 1.5, 2.7)
    return out.select("vertex_id", "is_fallback", r6(F.col("ceiling_z")).alias("ceiling_z"))


@query("room_candidates_top30", f"""
WITH o AS (SELECT room_key, polygon_id, greatest(0, least(r.x1, c.x1) - greatest(r.x0, c.x0)) * greatest(0, least(r.y1, c.y1) - greatest(r.y0, c.y0)) AS area FROM fx_rooms r, fx_ceilings c),
k AS (SELECT *, row_number() OVER (PARTITION BY room_key ORDER BY area DESC, polygon_id) AS rank FROM o WHERE area > 1e-8)
SELECT room_key, polygon_id, {r('area')} AS overlap, CAST(rank AS INT) AS rank FROM k WHERE rank <= 30""")
def _(t):
    from atrium.operators import raster

    rooms = raster.rasterize_polygons(polygons.ring_edges(t.rooms.selectExpr("room_key", "array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y0 AS y), struct(x1 AS x, y1 AS y), struct(x0 AS x, y1 AS y)) AS ring"), ["room_key"]), ["room_key"], 0.25)
    ceilings = raster.rasterize_polygons(ceiling_edges(t), ["polygon_id"], 0.25)
    out = matching.room_candidates(rooms, ceilings, [], "room_key", 0.25)
    return out.select("room_key", "polygon_id", r6(F.col("overlap")).alias("overlap"), "rank")


@query("interval_overlap", """
SELECT w.wall_id, r.room_key FROM fx_walls w JOIN fx_rooms r ON w.wx = r.x0 AND w.z_min <= r.level_key * 0.5 + 0.4 AND w.z_max >= r.level_key * 0.5""")
def _(t):
    levels = t.rooms.selectExpr("room_key", "x0 AS wx", "level_key * 0.5D AS low", "level_key * 0.5D + 0.4D AS high")
    return matching.interval_overlap(t.walls, levels, ["wx"]).select("wall_id", "room_key")


@query("stair_rooms", """
WITH p AS (SELECT s_suppkey AS stair_id, s_suppkey % 50 * 0.5::DOUBLE - 1 AS x, s_nationkey * 0.9::DOUBLE AS y FROM supplier),
d AS (SELECT stair_id, room_id, sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2)) AS d FROM p, fx_rooms),
g AS (SELECT stair_id, list_sort(list(room_id) FILTER (d <= 0.75)) AS near, arg_min(room_id, (d, room_id)) AS closest FROM d GROUP BY 1)
SELECT stair_id, coalesce(near, [closest]) AS room_ids FROM g""")
def _(t):
    pts = t.raw("supplier").selectExpr("0 AS level_id", "s_suppkey AS stair_id", "s_suppkey % 50 * 0.5D - 1 AS x", "s_nationkey * 0.9D AS y")
    return matching.rooms_near(pts, t.rooms.withColumn("level_id", F.lit(0)), ["level_id"], ["stair_id"]).select("stair_id", "room_ids")


WALL_SEG = "ws AS (SELECT room_key, unnest([[x0,y0,x1,y0],[x0,y0,x0,y1]]) AS s, unnest([0, 1]) AS side FROM fx_rooms)"


def wall_segments(t):
    return t.rooms.selectExpr("0 AS level_id", "room_id", "inline(array(struct(room_key * 2 AS wall_id, x0 AS x0, y0 AS y0, x1 AS x1, y0 AS y1), struct(room_key * 2 + 1 AS wall_id, x0 AS x0, y0 AS y0, x0 AS x1, y1 AS y1)))")


@query("window_walls", f"""
WITH {WALL_SEG}, p AS (SELECT DISTINCT x, y FROM fx_rays)
SELECT x, y, CAST(room_key * 2 + side AS INT) AS wall_id, {r('sqrt(pow(greatest(s[1] - x, 0, x - s[3]), 2) + pow(greatest(s[2] - y, 0, y - s[4]), 2))')} AS dist FROM p, ws
WHERE sqrt(pow(greatest(s[1] - x, 0, x - s[3]), 2) + pow(greatest(s[2] - y, 0, y - s[4]), 2)) <= 0.35 + 1e-12""")
def _(t):
    pts = t.rays.selectExpr("0 AS level_id", "x", "y").distinct()
    out = matching.points_near_segments(pts, wall_segments(t), ["level_id"], "wall_id", 0.35 + 1e-12)
    return out.select("x", "y", F.col("tid").alias("wall_id"), r6(F.col("dist")).alias("dist"))


@query("window_rooms", """
WITH p AS (SELECT s_suppkey AS window_id, s_suppkey % 50 * 0.43::DOUBLE AS x, s_nationkey * 0.79::DOUBLE AS y FROM supplier),
d AS (SELECT window_id, room_id, CASE WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 THEN least(x - x0, x1 - x, y - y0, y1 - y)
  ELSE sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2)) END AS d FROM p, fx_rooms)
SELECT window_id, list_sort(list(room_id)) AS room_ids FROM d WHERE d <= 0.35 GROUP BY 1""")
def _(t):
    pts = t.raw("supplier").selectExpr("0 AS level_id", "s_suppkey AS window_id", "s_suppkey % 50 * 0.43D AS x", "s_nationkey * 0.79D AS y")
    rings = t.rooms.selectExpr("0 AS level_id", "room_id", "array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y0 AS y), struct(x1 AS x, y1 AS y), struct(x0 AS x, y1 AS y)) AS ring")
    sides = polygons.ring_edges(rings, ["level_id", "room_id"])
    near = matching.points_near_segments(pts, sides, ["level_id"], "room_id")
    return near.groupBy("window_id").agg(F.sort_array(F.collect_set("tid")).alias("room_ids"))


OPENING_SQL = """op AS (SELECT s_suppkey AS edge_index, 'opening_' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') AS edge_id, CASE WHEN s_suppkey % 3 = 0 THEN 'opening' ELSE 'door' END AS kind, s_suppkey % 25 AS ra, s_nationkey AS rb,
  (s_suppkey % 25 % 5) * 4 + 0.5::DOUBLE + (s_suppkey % 4) AS xa, floor(s_suppkey % 25 / 5.0) * 4 + (s_suppkey % 3) * 0.11::DOUBLE AS ya FROM supplier)"""


def openings(t):
    return t.raw("supplier").selectExpr(
        "0 AS level_id", "s_suppkey AS edge_index", "format_string('opening_%03d', s_suppkey) AS edge_id", "CASE WHEN s_suppkey % 3 = 0 THEN 'opening' ELSE 'door' END AS kind",
        "array_distinct(array(CAST(s_suppkey % 25 AS INT), s_nationkey)) AS rooms", "(s_suppkey % 25 % 5) * 4 + 0.5D + (s_suppkey % 4) AS xa", "floor(s_suppkey % 25 / 5.0) * 4 + (s_suppkey % 3) * 0.11D AS ya").selectExpr(
        "*", "xa + 0.9D AS xb", "ya AS yb", "0.9D AS width_meters", "transform(rooms, k -> format_string('level_%d_room_%03d', k % 5, k)) AS room_ids")


@query("match_opening", f"""
WITH {OPENING_SQL}, w AS (SELECT room_key, x0, y0, x1 FROM fx_rooms),
m AS (SELECT w.room_key, min(edge_index) AS k FROM w JOIN op ON (op.ra = w.room_key OR op.rb = w.room_key)
  WHERE sqrt(pow(greatest(x0 - (xa + 0.9::DOUBLE), 0, xa - x1), 2) + pow(ya - y0, 2)) <= 0.2::DOUBLE GROUP BY 1)
SELECT w.room_key, op.edge_id, op.kind FROM w LEFT JOIN m ON m.room_key = w.room_key LEFT JOIN op ON op.edge_index = m.k""")
def _(t):
    # region ids of the supplied nations are not their key modulo five, so rooms are renamed here
    walls = t.rooms.selectExpr("0 AS level_id", "room_key", "format_string('level_%d_room_%03d', room_key % 5, room_key) AS room_id", "x0", "y0", "x1", "y0 AS y1")
    out = matching.match_opening(walls, openings(t), ["level_id"], ["room_key"], 0.2)
    return out.select("room_key", short_number(F.col("edge_id"), "opening_", 3).alias("edge_id"), "kind")


CLASS_SQL = "cls AS (SELECT polygon_id FROM fx_triangles GROUP BY 1 HAVING polygon_id % 2 = 0)"


def polygon_classes(t):
    return t.triangles.select("scene_id", "polygon_id").distinct().withColumn("class_id", F.when(F.col("polygon_id") % 2 == 0, 2).otherwise(0))


@query("next_lower_polygon", f"""
WITH {ALL_TRI}, {CLASS_SQL}, mid AS (SELECT polygon_id, avg((az+bz+cz)/3) AS mz FROM fx_corners GROUP BY 1),
k AS (SELECT vertex_id, min(d2) AS d2, CAST(arg_min(td.polygon_id, (d2, td.polygon_id)) AS BIGINT) AS polygon_id
  FROM td JOIN mid ON mid.polygon_id = td.polygon_id WHERE td.polygon_id IN (SELECT polygon_id FROM cls) AND pz - mz > -0.05 AND d2 <= 9 GROUP BY 1)
SELECT v.vertex_id, coalesce(k.polygon_id, -1) AS polygon_id, {r('sqrt(k.d2)')} AS dist FROM fx_vertices v LEFT JOIN k ON k.vertex_id = v.vertex_id""")
def _(t):
    out = matching.next_lower_polygon(plain_vertices(t), cornered(t), SC, ["vertex_id"], polygon_classes(t), 2)
    return out.select("vertex_id", F.col("polygon_id").cast("bigint").alias("polygon_id"), r6(F.col("dist")).alias("dist"))


@query("nearest_polygon_of_class", f"""
WITH {ALL_TRI}, {CLASS_SQL} SELECT vertex_id, CAST(arg_min(polygon_id, (d2, polygon_id)) AS BIGINT) AS polygon_id, {r('sqrt(min(d2))')} AS dist FROM td WHERE polygon_id IN (SELECT polygon_id FROM cls) GROUP BY 1""")
def _(t):
    out = matching.nearest_polygon_of_class(plain_vertices(t), cornered(t), SC, polygon_classes(t), 2)
    return out.select("vertex_id", F.col("polygon_id").cast("bigint").alias("polygon_id"), r6(F.col("dist")).alias("dist"))
