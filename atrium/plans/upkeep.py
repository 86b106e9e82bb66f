"""Registered queries: plane fitting, contours, polygon maintenance and its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions import vectors as V
from atrium.functions.vectors import r6
from atrium.operators import fitting, maintenance as M
from atrium.operators import mesh
from atrium.plans.projections import planes
from atrium.plans.registry import query, r
from atrium.plans.spatial_joins import ALL_TRI, CLASS_SQL, RAY_SQL, SC, SELF_SQL, TRI_SQL, cornered, plain_vertices, polygon_classes, ray_hits, room_rays
from atrium.plans.topology import contours, plane_links

# ---- plane fitting ------------------------------------------------------------------------------------------

RANSAC_SQL = """pt AS (SELECT vertex_id % 40 AS g, vertex_id, x, y, z, row_number() OVER (PARTITION BY vertex_id % 40 ORDER BY vertex_id) - 1 AS i, count(*) OVER (PARTITION BY vertex_id % 40) AS n FROM fx_vertices),
pk AS (SELECT g, it, j, CAST(floor(CAST('0x' || substr(md5('3|' || g || '|' || it || '|' || j), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * n) AS BIGINT) AS i
  FROM (SELECT DISTINCT g, n FROM pt), range(64) a(it), range(3) b(j)),
pp AS (SELECT pk.g, it, j, x, y, z FROM pk JOIN pt ON pt.g = pk.g AND pt.i = pk.i),
hy AS (SELECT a.g, a.it, a.x AS x0, a.y AS y0, a.z AS z0, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS nz
  FROM pp a JOIN pp b ON b.g = a.g AND b.it = a.it AND b.j = 1 JOIN pp c ON c.g = a.g AND c.it = a.it AND c.j = 2 WHERE a.j = 0),
hu AS (SELECT g, it, nx/l AS a, ny/l AS b, nz/l AS c, -(nx/l*x0 + ny/l*y0 + nz/l*z0) AS d FROM (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM hy) WHERE l > 1e-12),
sc AS (SELECT hu.g, it, count(*) FILTER (abs(a*x+b*y+c*z+d) <= 0.41::DOUBLE) AS k FROM hu JOIN pt ON pt.g = hu.g GROUP BY ALL)"""


def grouped_points(t):
    return t.vertices.select((F.col("vertex_id") % 40).alias("g"), "vertex_id", "x", "y", "z")


@query("ransac_plane", f"WITH {RANSAC_SQL} SELECT g, max(k) AS inliers FROM sc GROUP BY 1")
def _(t):
    pts = grouped_points(t)
    hyp = fitting.ransac_hypotheses(pts, ["g"], "vertex_id", 64, 3)
    return fitting.ransac_consensus(pts, hyp, ["g"], 0.41).select("g", "inliers")


@query("ransac_refit")
def _(t):
    out = fitting.ransac_plane(grouped_points(t), ["g"], "vertex_id", 0.4, 64, 3, preferred=V.const(0, 0, 1))
    return out.select("g", *(r6(F.col(k), 4).alias(k) for k in "abcd"))


@query("plane_extraction")
def _(t):
    v = t.mesh_vertices.withColumn("segment_id", F.floor(F.col("vertex_id") / 500).cast("int"))
    # a scene of its own per 2000 vertices, so that scenes advance side by side
    state, _ = fitting.plane_extraction(v, t.triangles, SC, min_seed=300, iterations=32)
    return state.groupBy("polygon_id").agg(F.count("*").alias("n_vertices"), r6(F.avg("z")).alias("mean_z"))


def squares(t):
    return t.raw("supplier").selectExpr("s_suppkey % 10 AS polygon_id", "s_suppkey AS ring_id", "CAST(s_suppkey div 10 + 1 AS DOUBLE) AS h").selectExpr(
        "polygon_id", "ring_id", "array(struct(-h AS x, -h AS y), struct(h AS x, -h AS y), struct(h AS x, h AS y), struct(-h AS x, h AS y)) AS ring")


NEST_SQL = """rg AS (SELECT s_suppkey % 10 AS polygon_id, s_suppkey AS ring_id, CAST(s_suppkey // 10 + 1 AS DOUBLE) AS h FROM supplier),
ns AS (SELECT a.polygon_id, a.ring_id, 4 * a.h * a.h AS area, (SELECT count(*) FROM rg b WHERE b.polygon_id = a.polygon_id AND b.h > a.h) AS depth,
  (SELECT arg_min(b.ring_id, b.h) FROM rg b WHERE b.polygon_id = a.polygon_id AND b.h > a.h) AS parent_id FROM rg a)"""


@query("contour_nesting", f"WITH {NEST_SQL} SELECT polygon_id, ring_id, area, depth, parent_id, depth % 2 = 0 AS is_outer FROM ns")
def _(t):
    return fitting.contour_nesting(squares(t), ["polygon_id"])


@query("group_contours_sorted", f"""
WITH {NEST_SQL} SELECT polygon_id, ring_id, CAST(row_number() OVER (PARTITION BY polygon_id ORDER BY area DESC, ring_id) - 1 AS INT) AS rank,
  (SELECT list_sort(list(h.ring_id)) FROM ns h WHERE h.parent_id = o.ring_id AND h.depth % 2 = 1) AS holes FROM ns o WHERE depth % 2 = 0""")
def _(t):
    out = M.group_contours(fitting.contour_nesting(squares(t), ["polygon_id"]), ["polygon_id"])
    return out.select("polygon_id", "ring_id", "rank", "holes")


@query("rdp_simplify")
def _(t):
    rows = t.vertices.selectExpr("CAST(vertex_id % 97 AS INT) AS ring_id", "vertex_id div 97 AS pos", "x", "y")
    return fitting.rdp_simplify(rows, ["ring_id"], "pos", 2.0)


# ---- contours -------------------------------------------------------------------------------------------------

CONTOUR_ROWS = """ct AS (SELECT o_custkey % 50 AS polygon_id, o_orderkey AS contour, o_totalprice / 100000 AS area, o_orderkey % 5 = 0 AS is_outer FROM orders),
mb AS (SELECT o_custkey % 50 AS polygon_id, o_orderkey AS contour, unnest([o_orderkey * 3, o_orderkey * 3 + 1, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000 * 3 ELSE o_orderkey * 3 + 2 END]) AS vertex_id FROM orders),
sh AS (SELECT vertex_id FROM mb GROUP BY 1 HAVING count(DISTINCT polygon_id) > 1),
sc AS (SELECT DISTINCT polygon_id, contour FROM mb WHERE vertex_id IN (SELECT vertex_id FROM sh))"""


def contour_rows(t):
    o = t.raw("orders")
    contours_ = o.selectExpr("0 AS scene_id", "o_custkey % 50 AS polygon_id", "o_orderkey AS contour", "o_totalprice / 100000 AS area", "o_orderkey % 5 = 0 AS is_outer")
    members = o.selectExpr("0 AS scene_id", "o_custkey % 50 AS polygon_id", "o_orderkey AS contour",
                           "explode(array(o_orderkey * 3, o_orderkey * 3 + 1, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000 * 3 ELSE o_orderkey * 3 + 2 END)) AS vertex_id")
    return contours_, members


@query("drop_small_holes", f"WITH {CONTOUR_ROWS} SELECT polygon_id, contour FROM ct WHERE is_outer OR area >= 2 OR (polygon_id, contour) IN (SELECT (polygon_id, contour) FROM sc)")
def _(t):
    return M.drop_small_holes(*contour_rows(t), 2.0).select("polygon_id", "contour")


@query("drop_nonconvex_holes", f"""
WITH {CONTOUR_ROWS}, cv AS (SELECT polygon_id, contour, count(*) AS k FROM mb WHERE vertex_id % 4 <> 1 GROUP BY ALL)
SELECT ct.polygon_id, ct.contour FROM ct LEFT JOIN cv ON cv.polygon_id = ct.polygon_id AND cv.contour = ct.contour
WHERE is_outer OR (ct.polygon_id, ct.contour) IN (SELECT (polygon_id, contour) FROM sc) OR coalesce(k, 0) >= 3""")
def _(t):
    c, m = contour_rows(t)
    convex = m.filter("vertex_id % 4 <> 1").select("scene_id", "polygon_id", "vertex_id")
    return M.drop_nonconvex_holes(c, m, convex, 3).select("polygon_id", "contour")


@query("class_filter_polygons", """
WITH p AS (SELECT room_key, level_key FROM fx_rooms WHERE level_key IN (0, 2, 3)),
l AS (SELECT room_key, unnest([room_key + 1, room_key + 5]) AS other FROM p)
SELECT p.room_key AS polygon_id, coalesce((SELECT list_sort(list(CAST(other AS VARCHAR))) FROM l WHERE l.room_key = p.room_key AND other IN (SELECT room_key FROM p)), []) AS shared FROM p""")
def _(t):
    polys = t.rooms.selectExpr("0 AS scene_id", "room_key AS polygon_id", "concat('c', level_key) AS class",
                               "map(CAST(room_key + 1 AS STRING), array(room_key), CAST(room_key + 5 AS STRING), array(room_key)) AS shared_edges")
    out = M.class_filter_polygons(polys, ["c0", "c2", "c3"])
    return out.select("polygon_id", F.array_sort(F.map_keys("shared_edges")).alias("shared"))


@query("fill_small_holes")
def _(t):
    from atrium.operators import graphs

    loops = graphs.trace_faces(mesh.boundary_edges(t.triangles), t.mesh_vertices, SC)
    owner = t.mesh_vertices.select("scene_id", "vertex_id", F.floor(F.col("vertex_id") / 500).alias("polygon_id"))
    out = M.fill_small_holes(loops.select("scene_id", F.to_json("loop_id").alias("loop_id"), "vertex_id"), t.mesh_vertices, owner, 8, 0.2)
    return out.select("loop_id", "vertex_id", *(r6(F.col(c)).alias(c) for c in ("cx", "cy", "cz")))


# ---- frames and sets --------------------------------------------------------------------------------------------


@query("match_frames", """
WITH f AS (SELECT name, frame_id FROM fx_frames), s AS (SELECT CASE WHEN frame_id % 11 = 0 THEN 'extra_' || name ELSE name END AS name, frame_id AS record_id FROM fx_frames WHERE frame_id % 7 <> 0)
SELECT coalesce(f.name, s.name) AS name, f.frame_id, s.record_id, CASE WHEN s.name IS NULL THEN 'missing' WHEN f.name IS NULL THEN 'extra' ELSE 'matched' END AS status FROM f FULL JOIN s ON s.name = f.name""")
def _(t):
    from atrium.sources.readers import match_frames

    frames = t.frames.select("name", "frame_id")
    records = t.frames.filter("frame_id % 7 <> 0").selectExpr("CASE WHEN frame_id % 11 = 0 THEN concat('extra_', name) ELSE name END AS name", "frame_id AS record_id")
    return match_frames(frames, records, []).select("name", "frame_id", "record_id", "status")


@query("missing_extra", """
SELECT name, 'missing' AS side FROM (SELECT name FROM fx_frames EXCEPT ALL SELECT name FROM fx_frames WHERE frame_id % 3 <> 0) UNION ALL
SELECT name, 'extra' FROM (SELECT 'x' || name AS name FROM fx_frames WHERE frame_id % 5 = 0 EXCEPT ALL SELECT name FROM fx_frames)""")
def _(t):
    from atrium.sources.readers import missing_extra

    have = t.frames.filter("frame_id % 3 <> 0").select("name").unionByName(t.frames.filter("frame_id % 5 = 0").select(F.concat(F.lit("x"), "name").alias("name")))
    return missing_extra(t.frames.select("name"), have)


@query("constraint_sets", """
WITH e AS (SELECT vertex_id AS i, vertex_id + 1 AS j, list_sort(list_distinct([vertex_id // 300, 100 + vertex_id % 50 // 13])) AS pi, list_sort(list_distinct([(vertex_id + 1) // 300, 100 + (vertex_id + 1) % 50 // 13])) AS pj
  FROM fx_mesh_vertices WHERE vertex_id < (SELECT max(vertex_id) FROM fx_mesh_vertices))
SELECT i, j, list_sort(list_distinct(pi || pj)) AS joint, list_sort(list_intersect(pi, pj)) AS common, len(list_intersect(pi, pj)) = len(pi) AS i_in_j FROM e""")
def _(t):
    links = t.mesh_vertices.selectExpr("scene_id", "vertex_id", "explode(array_distinct(array(vertex_id div 300, 100 + vertex_id % 50 div 13))) AS plane_id")
    top = t.mesh_vertices.agg(F.max("vertex_id").alias("top"))  # one row
    pairs = t.mesh_vertices.join(F.broadcast(top)).filter("vertex_id < top").selectExpr("scene_id", "vertex_id AS i", "vertex_id + 1 AS j")
    return M.joint_constraints(pairs, mesh.vertex_plane_sets(links)).select("i", "j", "joint", "common", "i_in_j")


# ---- merging and simplification -------------------------------------------------------------------------------


def mesh_planes(t):
    """A plane per mesh polygon and per constraint id, scene-keyed."""
    return planes(t).withColumn("scene_id", F.lit(0).cast("bigint"))


def vertex_polygons(t):
    return t.mesh_vertices.select("scene_id", "vertex_id", F.floor(F.col("vertex_id") / 500).alias("plane_id"))


@query("plane_merge_pairs", """
WITH p AS (SELECT t.triangle_id, polygon_id, unnest([v0, v1, v2]) AS v FROM fx_triangles t)
SELECT DISTINCT CAST(least(v // 500, polygon_id) AS BIGINT) AS p, CAST(greatest(v // 500, polygon_id) AS BIGINT) AS q FROM p WHERE v // 500 <> polygon_id""")
def _(t):
    # faces within a hair of a vertex are those that touch it
    out = M.plane_merge_pairs(t.mesh_vertices, vertex_polygons(t), cornered(t), mesh_planes(t), 10, 1e-6, 30.0)
    return out.select(F.col("p").cast("bigint").alias("p"), F.col("q").cast("bigint").alias("q"))


def noisy_points(t):
    i = F.col("vertex_id")
    return t.vertices.select(F.lit(0).cast("bigint").alias("scene_id"), F.floor(i / 200).cast("bigint").alias("polygon_id"), "x", "y",
                             (F.col("z") * 0.1 + (i % 10) * 0.01 * F.col("x")).alias("z"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))


def neighbor_pairs(t):
    """Every polygon of ``noisy_points`` with the one of the next id."""
    ids = noisy_points(t).select("scene_id", F.col("polygon_id").alias("p")).distinct()
    return ids.withColumn("q", F.col("p") + 1).join(ids.withColumnRenamed("p", "q"), ["scene_id", "q"], "left_semi").select("scene_id", "p", "q")


@query("plane_merge_cost")
def _(t):
    out = M.plane_merge_cost(noisy_points(t), neighbor_pairs(t))
    return out.select("p", "q", "winner", "accepted", *(r6(F.col(c), 4).alias(c) for c in ("distance_cost", "angle_cost", "a", "b", "c", "d")))


@query("merge_planes")
def _(t):
    costs = M.plane_merge_cost(noisy_points(t), neighbor_pairs(t), max_distance_cost=50.0, max_angle_cost=50.0)
    tri, links, moves = M.merge_planes(costs, t.triangles, vertex_polygons(t))
    return tri.groupBy("polygon_id").agg(F.count("*").alias("n_triangles"))


VOTE_POINTS = "vq AS (SELECT vertex_id, x + 0.031::DOUBLE AS x, y + 0.042::DOUBLE AS y, z + 0.05::DOUBLE AS z, vertex_id % 5 / 5.0::DOUBLE AS wall, vertex_id % 3 / 3.0::DOUBLE AS ceiling, vertex_id % 7 / 7.0::DOUBLE AS floor FROM fx_mesh_vertices)"


@query("polygon_class_vote")
def _(t):
    pts = t.mesh_vertices.selectExpr("scene_id", "vertex_id", "x + 0.031D AS x", "y + 0.042D AS y", "z + 0.05D AS z",
                                     "vertex_id % 5 / 5D AS wall", "vertex_id % 3 / 3D AS ceiling", "vertex_id % 7 / 7D AS floor")
    out = M.polygon_class_vote(pts, cornered(t), mesh_planes(t), ["wall", "ceiling", "floor"])
    return out.select("polygon_id", "n_points", "class_id", r6(F.col("floor")).alias("floor"))


@query("simplify_vertices")
def _(t):
    links = vertex_polygons(t)
    pl = mesh_planes(t).withColumnRenamed("polygon_id", "plane_id")
    v, tri, _ = M.simplify_vertices(t.mesh_vertices, t.triangles, links, pl, max_dist=0.12)
    return tri.groupBy("polygon_id").agg(F.count("*").alias("n_triangles"))


@query("simplify_edges")
def _(t):
    contour = mesh.boundary_edges(t.triangles)
    out = M.simplify_edges(contour, t.mesh_vertices, vertex_polygons(t), t.triangles)
    return out.select("vertex_id", r6(F.col("turn"), 4).alias("turn"), *(r6(F.col(c)).alias(c) for c in ("tx", "ty", "tz")))


@query("attach_to_lines")
def _(t):
    pl = mesh_planes(t).withColumnRenamed("polygon_id", "plane_id")
    rows = t.mesh_vertices.select("scene_id", "vertex_id", F.pmod(F.floor(F.col("vertex_id") / 50), F.lit(4)).alias("plane_id"))
    out = M.attach_to_lines(t.mesh_vertices, rows, pl, mesh.boundary_edges(t.triangles), 0.11, 1000.0, k=6)
    return out.select("vertex_id", r6(F.col("dist")).alias("dist"), "joint")


@query("simplify_polygons")
def _(t):
    pl = mesh_planes(t).withColumnRenamed("polygon_id", "plane_id")
    moved, _ = M.simplify_polygons(t.mesh_vertices, t.triangles, vertex_polygons(t), pl)
    return moved.select("vertex_id", "removed", "attached", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("drop_unsatisfiable", """
WITH e AS (SELECT vertex_id, abs(a*x + b*y + c*z + d) AS h FROM fx_mesh_vertices v JOIN fx_planes p ON p.polygon_id = v.vertex_id // 500)
SELECT vertex_id, CAST(vertex_id // 500 AS BIGINT) AS plane_id FROM e WHERE h < 1.7""")
def _(t):
    pl = mesh_planes(t).withColumnRenamed("polygon_id", "plane_id")
    links = vertex_polygons(t).withColumn("rank", F.lit(0))
    return M.drop_unsatisfiable(t.mesh_vertices, links, pl, 1.7).select("vertex_id", F.col("plane_id").cast("bigint").alias("plane_id"))


# ---- walls, floors, metrics -----------------------------------------------------------------------------------


def inner_mask(t):
    contour = mesh.boundary_edges(t.triangles)
    return mesh.inner_edge_mask(t.triangles, contour)


def facing(t):
    return M.edges_facing(cornered(t), inner_mask(t), mesh_planes(t), V.const(0, 1, 0))


@query("edges_facing")
def _(t):
    return facing(t).select("polygon_id", "triangle_id", "e0", "e1")


@query("extend_walls")
def _(t):
    # odd polygons are walls, seen as planes that lean by less than six degrees; even ones are floors, seen as level planes
    lower = facing(t).filter("polygon_id % 2 = 1").select("scene_id", "polygon_id", "e0", "e1").distinct()
    ids = t.triangles.select("scene_id", "polygon_id").distinct()
    upright = ids.filter("polygon_id % 2 = 1").selectExpr("scene_id", "polygon_id", "0D AS a", "1D AS b", "0.1D AS c", "-polygon_id * 1D AS d")
    level = ids.filter("polygon_id % 2 = 0").selectExpr("scene_id", "polygon_id", "0D AS a", "0D AS b", "1D AS c", "1D - polygon_id * 0.5D AS d")
    surfaces = upright.unionByName(level)
    targets = M.wall_targets(lower, t.mesh_vertices, cornered(t), surfaces, polygon_classes(t), 2)
    limit = upright.select("scene_id", "polygon_id", F.lit(40.0).alias("max_hits_per_area"))
    rays = room_rays(t).withColumnRenamed("vertex_id", "ray_id")
    out = M.extend_walls(lower, t.mesh_vertices, surfaces, targets, rays, limit, min_length=0.05, assignments=vertex_polygons(t))
    return out.select("polygon_id", "e0", "e1", "target_id", r6(F.col("area")).alias("area"), "hits", "accepted")


@query("project_objects_to_floor", f"""
WITH ob AS (SELECT vertex_id, x, y, z + 0.2::DOUBLE AS z FROM fx_mesh_vertices), {TRI_SQL.format(points='ob', tris='fx_normals')}, {CLASS_SQL},
mid AS (SELECT polygon_id, avg((az+bz+cz)/3) AS mz FROM fx_corners GROUP BY 1),
p AS (SELECT vertex_id, arg_min(td.polygon_id, (d2, td.polygon_id)) AS f FROM td JOIN mid ON mid.polygon_id = td.polygon_id
  WHERE td.polygon_id IN (SELECT polygon_id FROM cls) AND pz - mz > -0.05 AND d2 <= 9 GROUP BY 1)
SELECT triangle_id, CAST(a.f AS BIGINT) AS floor_polygon_id, {r('oa.x + ob2.x + oc.x')} AS x, {r('oa.z + ob2.z + oc.z')} AS z
FROM fx_triangles t JOIN p a ON a.vertex_id = v0 JOIN p b ON b.vertex_id = v1 JOIN p c ON c.vertex_id = v2 JOIN ob oa ON oa.vertex_id = v0 JOIN ob ob2 ON ob2.vertex_id = v1 JOIN ob oc ON oc.vertex_id = v2
WHERE a.f = b.f AND b.f = c.f""")
def _(t):
    objects = t.mesh_vertices.withColumn("z", F.col("z") + 0.2)  # the mesh again, a little higher
    out = M.project_objects_to_floor(objects, t.triangles.drop("polygon_id"), cornered(t), polygon_classes(t), 2, must_be_below=True, max_dist=3.0)
    return out.select("triangle_id", F.col("floor_polygon_id").cast("bigint").alias("floor_polygon_id"), r6(F.col("ax") + F.col("bx") + F.col("cx")).alias("x"),
                      r6(F.col("az") + F.col("bz") + F.col("cz")).alias("z"))


OBS_SQL = f"""{RAY_SQL}, us AS (SELECT e0, e1, count(*) AS k FROM fx_edges GROUP BY ALL),
hp AS (SELECT h.vertex_id, n.*, 2.5 + h.t*h.dx AS hx, 2.0 + h.t*h.dy AS hy, 3.0 + h.t*h.dz AS hz, 2.5 + h.dx AS ex, 2.0 + h.dy AS ey, 3.0 + h.dz AS ez FROM hit h JOIN fx_normals n ON n.triangle_id = h.triangle_id
  WHERE (1-h.t)*sqrt(h.dx*h.dx+h.dy*h.dy+h.dz*h.dz) >= 0.05),
ed AS (SELECT vertex_id, polygon_id, hx, hy, hz, ex, ey, ez, ax, ay, az, nx, ny, nz, unnest([[v0,v1],[v1,v2],[v2,v0]]) AS vv, unnest([[ax,ay,az,bx,by,bz],[bx,by,bz,cx,cy,cz],[cx,cy,cz,ax,ay,az]]) AS s FROM hp),
dd AS (SELECT ed.*, us.k, greatest(0, least(1, ((hx-s[1])*(s[4]-s[1]) + (hy-s[2])*(s[5]-s[2]) + (hz-s[3])*(s[6]-s[3])) / (pow(s[4]-s[1],2) + pow(s[5]-s[2],2) + pow(s[6]-s[3],2)))) AS tt
  FROM ed JOIN us ON us.e0 = least(vv[1], vv[2]) AND us.e1 = greatest(vv[1], vv[2])),
bd AS (SELECT vertex_id, any_value(polygon_id) AS polygon_id, min(CASE WHEN k = 1 THEN sqrt(pow(hx-s[1]-tt*(s[4]-s[1]),2) + pow(hy-s[2]-tt*(s[5]-s[2]),2) + pow(hz-s[3]-tt*(s[6]-s[3]),2)) END) AS border,
  any_value(abs((ex-ax)*nx + (ey-ay)*ny + (ez-az)*nz) / sqrt(nx*nx+ny*ny+nz*nz)) AS depth FROM dd GROUP BY 1),
ar AS (SELECT polygon_id, sum(0.5 * sqrt(nx*nx+ny*ny+nz*nz)) AS area FROM fx_normals GROUP BY 1)"""


@query("ray_obstruction", f"""
WITH {OBS_SQL} SELECT bd.polygon_id, count(*) AS hits, count(*) FILTER (border < 0.1) AS near_border, {r('sum(CASE WHEN border < 0.1 THEN border ELSE 0 END)')} AS border_sum,
  {r('sum(CASE WHEN border < 0.1 THEN 0 ELSE depth * 10 / area END)')} AS depth_sum FROM bd JOIN ar ON ar.polygon_id = bd.polygon_id GROUP BY 1""")
def _(t):
    c = cornered(t)
    areas = mesh.with_area_normal(c).groupBy("scene_id", "polygon_id").agg(F.sum("area").alias("area"))
    out = M.ray_obstruction(ray_hits(t), room_rays(t), c, inner_mask(t), areas, ["vertex_id"])
    return out.select("polygon_id", "hits", "near_border", r6(F.col("border_sum")).alias("border_sum"), r6(F.col("depth_sum")).alias("depth_sum"))


REGULARITY = ("manhattan", "up_angle", "straightness", "rectangularity", "magnetism", "edge_magnetism", "face_magnetism")
MAGNET_SEG = """CASE WHEN dd < 1e-8 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((m.x-x0)*(x1-x0) + (m.y-y0)*(y1-y0) + (m.z-z0)*(z1-z0)) / dd)) END"""


@query("layout_regularity", f"""
WITH us AS (SELECT e0, e1, count(*) AS uses FROM fx_edges GROUP BY ALL),
sg AS (SELECT e0, e1, uses, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, pow(a.x-b.x,2) + pow(a.y-b.y,2) + pow(a.z-b.z,2) AS dd
  FROM us JOIN fx_mesh_vertices a ON a.vertex_id = e0 JOIN fx_mesh_vertices b ON b.vertex_id = e1),
ln AS (SELECT sum(CASE WHEN uses = 1 THEN sqrt(dd) ELSE 0 END) AS open_length, sum(sqrt(dd)) AS contour_length FROM sg),
pl AS (SELECT avg(least(90 - abs(90 - degrees(acos(a))), 90 - abs(90 - degrees(acos(b))), 90 - abs(90 - degrees(acos(least(1, c)))))) AS manhattan,
  avg(least(90 - abs(90 - degrees(acos(least(1, c)))), abs(90 - degrees(acos(least(1, c)))))) AS up_angle FROM fx_planes),
nb AS (SELECT e0 AS v, e1 AS n FROM us UNION SELECT e1, e0 FROM us),
st AS (SELECT nb.v, nb.n, w.x-o.x AS x, w.y-o.y AS y, w.z-o.z AS z FROM nb JOIN fx_mesh_vertices o ON o.vertex_id = nb.v JOIN fx_mesh_vertices w ON w.vertex_id = nb.n),
an AS (SELECT degrees(acos(greatest(-1, least(1, (a.x*b.x + a.y*b.y + a.z*b.z) / sqrt((a.x*a.x + a.y*a.y + a.z*a.z) * (b.x*b.x + b.y*b.y + b.z*b.z)))))) AS angle
  FROM st a JOIN st b ON a.v = b.v AND a.n < b.n),
be AS (SELECT count(*) AS wedges, avg(180 - angle) AS straightness, avg(least(abs(90 - angle), 180 - angle)) AS rectangularity FROM an),
pd AS (SELECT sqrt(pow(a.x-b.x,2) + pow(a.y-b.y,2) + pow(a.z-b.z,2)) AS d FROM fx_mesh_vertices a JOIN fx_mesh_vertices b ON a.vertex_id < b.vertex_id),
vv AS (SELECT sum(ln(d / 0.25 + 1e-6)) AS magnetism, count(*) AS close_pairs FROM pd WHERE d < 0.25),
se AS (SELECT m.vertex_id, m.x, m.y, m.z, sg.*, {MAGNET_SEG} AS t FROM fx_mesh_vertices m JOIN sg ON m.vertex_id <> e0 AND m.vertex_id <> e1),
ne AS (SELECT vertex_id, min(sqrt(pow(x-x0-(x1-x0)*t,2) + pow(y-y0-(y1-y0)*t,2) + pow(z-z0-(z1-z0)*t,2))) AS d FROM se GROUP BY 1),
ve AS (SELECT sum(ln(d / 0.25 + 1e-6)) AS edge_magnetism, count(*) AS edge_attracted FROM ne WHERE d < 0.25),
{TRI_SQL.format(points="fx_mesh_vertices", tris="fx_normals")},
ow AS (SELECT DISTINCT unnest([v0, v1, v2]) AS vertex_id, polygon_id FROM fx_triangles),
nf AS (SELECT vertex_id, sqrt(min(d2)) AS d FROM td ANTI JOIN ow ON ow.vertex_id = td.vertex_id AND ow.polygon_id = td.polygon_id GROUP BY 1),
vf AS (SELECT sum(ln(d / 0.25 + 1e-6)) AS face_magnetism, count(*) AS face_attracted FROM nf WHERE d < 0.25)
SELECT {r('open_length')} AS open_length, {r('contour_length')} AS contour_length, wedges, {", ".join(f"{r(c, 4)} AS {c}" for c in REGULARITY)}, close_pairs, edge_attracted, face_attracted
FROM ln, pl, be, vv, ve, vf""")
def _(t):
    contour = mesh.edge_uses(t.triangles)
    out = M.layout_regularity(t.triangles, t.mesh_vertices, contour, mesh_planes(t), threshold=0.25)
    return out.select(*(r6(F.col(c)).alias(c) for c in ("open_length", "contour_length")), "wedges", *(r6(F.col(c), 4).alias(c) for c in REGULARITY),
                      "close_pairs", "edge_attracted", "face_attracted")
