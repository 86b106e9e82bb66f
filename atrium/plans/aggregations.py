"""Registered queries: filters, aggregates, windows, sampling and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.functions import labels as L
from atrium.functions import vectors as V
from atrium.functions.vectors import r6
from atrium.operators import aggregates as A
from atrium.operators import cameras, mesh, ranking, semantics
from atrium.plans.projections import on_planes, planes, pointing
from atrium.plans.registry import query, r
from atrium.plans.spatial_joins import NEAREST_SQL, SC, nearest_vertices
from atrium.session import end_round

FRAME = ["scene_id", "frame_id"]

# ---- filters -------------------------------------------------------------------------------------


@query("class_lookup", "SELECT s.frame_id, s.coco_id, m.layout_id FROM fx_samples s JOIN label_map m ON m.coco_id = s.coco_id WHERE m.layout_id = 2")
def _(t):
    return t.samples.select("frame_id", "coco_id", L.layout_id(F.col("coco_id")).alias("layout_id")).filter(
        L.layout_name(F.col("layout_id")) == "floor")


@query("depth_range_filter", f"""
SELECT frame_id, count(*) FILTER (depth BETWEEN 0.1 AND 15) AS accepted, count(*) FILTER (depth > 15) AS too_far,
  {r('min(depth) FILTER (depth BETWEEN 0.1 AND 15)')} AS min_depth, {r('max(depth) FILTER (depth BETWEEN 0.1 AND 15)')} AS max_depth FROM fx_samples GROUP BY frame_id""")
def _(t):
    out = cameras.depth_range_counts(t.samples, FRAME, 0.1, 15)
    return out.select("frame_id", "accepted", "too_far", r6(F.col("min_depth")).alias("min_depth"), r6(F.col("max_depth")).alias("max_depth"))


@query("valid_depth", "SELECT scene_id, count(*) FILTER (depth > 0) AS valid, count(*) FILTER (NOT depth > 0) AS invalid FROM fx_samples GROUP BY scene_id")
def _(t):
    ok = cameras.valid_depth(F.col("depth"))
    return t.samples.groupBy("scene_id").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query("stride_rows", "SELECT frame_id, pix_row, pix_col FROM fx_samples WHERE pix_row % 4 = 0 AND pix_col % 4 = 0")
def _(t):
    return cameras.stride_rows(t.samples, 4).select("frame_id", "pix_row", "pix_col")


def labelled_mesh(t):
    return t.mesh_vertices.withColumn("label", (F.col("vertex_id") % 7).cast("int"))


@query("split_by_class", """
WITH keep AS (SELECT vertex_id, row_number() OVER (ORDER BY vertex_id) - 1 AS new_id FROM fx_mesh_vertices WHERE vertex_id % 7 IN (0, 1, 2, 3))
SELECT t.triangle_id, a.new_id AS v0, b.new_id AS v1, c.new_id AS v2 FROM fx_triangles t JOIN keep a ON a.vertex_id = t.v0 JOIN keep b ON b.vertex_id = t.v1 JOIN keep c ON c.vertex_id = t.v2""")
def _(t):
    _, tri = mesh.split_by_class(labelled_mesh(t), t.triangles, (0, 1, 2, 3))
    return tri.select("triangle_id", "v0", "v1", "v2")


@query("select_walls", """
SELECT DISTINCT CAST(r.level_key AS BIGINT) AS level_id, w.wall_id FROM fx_walls w JOIN fx_rooms r ON w.wx < r.x1 AND w.wx >= r.x0 AND w.wy < r.y1 AND w.wy >= r.y0 AND r.level_key = w.wall_id % 5
WHERE w.z_min <= 2.5 AND w.z_max >= 0""")
def _(t):
    from atrium.operators.rooms import select_walls

    # footprint cells of 1 m on every level, walls stand on the cell of their anchor on the level of their id
    cells = t.rooms.selectExpr("level_key AS level_id", "explode(sequence(CAST(x0 AS INT), CAST(x1 AS INT) - 1)) AS c", "y0", "y1").selectExpr(
        "level_id", "explode(sequence(CAST(y0 AS INT), CAST(y1 AS INT) - 1)) AS r", "c")
    walls = t.walls.selectExpr("wall_id", "wall_id % 5 AS level_id", "CAST(floor(wy) AS INT) AS r", "CAST(floor(wx) AS INT) AS c", "z_min", "z_max")
    return select_walls(walls, cells, 0.0, 2.5, ["level_id"])


@query("ceiling_clearance", "SELECT polygon_id FROM fx_ceilings WHERE -d - 1.5 >= 1.0::DOUBLE")
def _(t):
    from atrium.operators.rooms import ceiling_clearance

    return t.ceilings.filter(ceiling_clearance(-F.col("d"), F.lit(1.5))).select("polygon_id")


@query("height_band", "SELECT hint_vertex, label, z FROM fx_rays WHERE label IN (4, 5, 6) AND z BETWEEN 0.5 AND 2.0")
def _(t):
    from atrium.operators.rooms import height_band

    return height_band(t.rays, 0.5, 2.0, (4, 5, 6)).select("hint_vertex", "label", "z")


@query("ray_class_filter", "SELECT scene_id, label, count(*) AS n FROM fx_rays WHERE label NOT IN (4, 6) GROUP BY ALL")
def _(t):
    from atrium.operators.rooms import drop_ray_classes

    return drop_ray_classes(t.rays, ("inaccurate_window", "inaccurate_outdoor")).groupBy("scene_id", "label").agg(F.count("*").alias("n"))


@query("orientation_class_mask", f"""
WITH k AS (SELECT polygon_id, degrees(acos(greatest(-1.0, least(1.0, nz)))) AS deg FROM (
  SELECT polygon_id, CASE polygon_id % 3 WHEN 0 THEN a ELSE c END AS nz FROM fx_planes))
SELECT polygon_id, CASE WHEN abs(90 - deg) > 10 THEN 0.0 ELSE 0.5 END::DOUBLE AS wall, CASE WHEN 180 - deg > 10 THEN 0.0 ELSE 0.3 END::DOUBLE AS ceiling,
  CASE WHEN deg > 10 THEN 0.0 ELSE 0.2 END::DOUBLE AS floor FROM k""")
def _(t):
    from atrium.operators.rooms import mask_by_orientation

    p = planes(t).withColumns({"n": F.when(F.col("polygon_id") % 3 == 0, F.col("a")).otherwise(F.col("c")),
                               "wall": F.lit(0.5), "ceiling": F.lit(0.3), "floor": F.lit(0.2)})
    return mask_by_orientation(p, F.col("n")).select("polygon_id", "wall", "ceiling", "floor")


@query("drop_unassigned", "SELECT triangle_id FROM fx_triangles t WHERE (polygon_id * 5) % 3 - 1 <> -1")
def _(t):
    classes = t.triangles.select("scene_id", "polygon_id").distinct().withColumn("class_id", F.col("polygon_id") * 5 % 3 - 1)
    return t.triangles.join(classes.filter("class_id <> -1"), ["scene_id", "polygon_id"], "left_semi").select("triangle_id")


@query("compact_vertices", """
WITH used AS (SELECT DISTINCT unnest([v0, v1, v2]) AS vertex_id FROM fx_triangles),
ids AS (SELECT vertex_id, row_number() OVER (ORDER BY vertex_id) - 1 AS new_id FROM used)
SELECT t.triangle_id, a.new_id AS v0, b.new_id AS v1, c.new_id AS v2 FROM fx_triangles t JOIN ids a ON a.vertex_id = t.v0 JOIN ids b ON b.vertex_id = t.v1 JOIN ids c ON c.vertex_id = t.v2""")
def _(t):
    return mesh.compact_vertices(t.mesh_vertices, t.triangles)[1].select("triangle_id", "v0", "v1", "v2")


@query("candidate_faces", "SELECT triangle_id FROM fx_triangles WHERE v0 % 10 < 7 AND v1 % 10 < 7 AND v2 % 10 < 7")
def _(t):
    return mesh.faces_within(t.triangles, t.mesh_vertices.filter("vertex_id % 10 < 7")).select("triangle_id")


@query("same_plane_triangles", """
WITH p AS (SELECT vertex_id, CASE WHEN vertex_id % 11 = 0 THEN -1 ELSE vertex_id // 350 END AS plane_id FROM fx_mesh_vertices)
SELECT triangle_id, a.plane_id FROM fx_triangles t JOIN p a ON a.vertex_id = v0 JOIN p b ON b.vertex_id = v1 JOIN p c ON c.vertex_id = v2
WHERE a.plane_id >= 0 AND a.plane_id = b.plane_id AND a.plane_id = c.plane_id""")
def _(t):
    pl = t.mesh_vertices.select("scene_id", "vertex_id", F.expr("CASE WHEN vertex_id % 11 = 0 THEN -1L ELSE vertex_id div 350 END AS plane_id"))
    return mesh.same_plane_triangles(t.triangles, pl).select("triangle_id", "plane_id")


# ---- aggregates ----------------------------------------------------------------------------------


@query("frame_histogram", f"""
SELECT frame_id, count(*) AS n_samples, count(*) FILTER (depth > 0) AS n_valid,
  {', '.join(f'count(*) FILTER (depth > 0 AND layout_id = {i}) AS label_{i}' for i in range(9))}
FROM fx_samples s JOIN label_map m ON m.coco_id = s.coco_id GROUP BY frame_id""")
def _(t):
    s = t.samples.withColumn("layout_id", L.layout_id(F.col("coco_id")))
    return A.frame_histogram(s, FRAME, "layout_id", cameras.valid_depth(F.col("depth"))).drop("scene_id")


@query("global_histogram", """
SELECT scene_id, frame_id, coco_id, count(*) AS n FROM fx_samples GROUP BY GROUPING SETS ((scene_id, frame_id, coco_id), (coco_id))""")
def _(t):
    return A.global_histogram(t.samples, FRAME, "coco_id")


@query("vertex_votes", f"WITH {NEAREST_SQL} SELECT scene_id, vertex_id, label, count(*) AS votes FROM hit GROUP BY ALL")
def _(t):
    return A.vertex_votes(nearest_vertices(t))


SEGMENT_SQL = f"""{NEAREST_SQL},
kd AS (SELECT v.scene_id, v.vertex_id, r.label, ((v.x-r.x)*(v.x-r.x) + (v.y-r.y)*(v.y-r.y) + (v.z-r.z)*(v.z-r.z)) AS d2 FROM fx_vertices v JOIN fx_rays r ON r.scene_id = v.scene_id),
kn AS (SELECT *, row_number() OVER (PARTITION BY scene_id, vertex_id ORDER BY d2, label) AS rn FROM kd),
both_ AS (SELECT scene_id, vertex_id, label, CAST(count(*) AS DOUBLE) AS vote, CAST(0 AS DOUBLE) AS p FROM hit GROUP BY ALL UNION ALL
  SELECT scene_id, vertex_id, label, CAST(0 AS DOUBLE), count(*) / CAST(5 AS DOUBLE) FROM kn WHERE rn <= 5 GROUP BY ALL),
per AS (SELECT b.scene_id, v.segment_id, b.label, sum(vote) AS vote, round(sum(p), 9) AS p FROM both_ b JOIN fx_vertices v ON v.vertex_id = b.vertex_id AND v.scene_id = b.scene_id GROUP BY ALL),
rk AS (SELECT *, sum(vote) OVER w AS tv, sum(p) OVER w AS tp FROM per WINDOW w AS (PARTITION BY scene_id, segment_id)),
win AS (SELECT *, CASE WHEN tv > 0 THEN vote ELSE p END AS score, CASE WHEN tv > 0 THEN vote / tv ELSE p / tp END AS share,
  row_number() OVER (PARTITION BY scene_id, segment_id ORDER BY CASE WHEN tv > 0 THEN vote ELSE p END DESC, label) AS rn FROM rk)"""


@query("segment_labels", f"""
WITH {SEGMENT_SQL}
SELECT v.scene_id, v.vertex_id, v.segment_id, w.label, {r('w.share')} AS share, w.tv = 0 AS fallback FROM fx_vertices v
  JOIN win w ON w.scene_id = v.scene_id AND w.segment_id = v.segment_id AND w.rn = 1""")
def _(t):
    votes = end_round(A.vertex_votes(nearest_vertices(t)))
    lacking = end_round(A.without_votes(votes, t.vertices))
    probabilities = semantics.knn_probabilities(lacking, t.rays, SC, 5)
    out = A.segment_labels(votes, probabilities, t.vertices)
    return out.select("scene_id", "vertex_id", "segment_id", "label", r6(F.col("share")).alias("share"), "fallback")


@query("vote_coverage", f"""
WITH {NEAREST_SQL}, vc AS (SELECT scene_id, vertex_id, count(*) AS c FROM hit GROUP BY ALL)
SELECT v.scene_id, count(c) AS voted, count(*) - count(c) AS unvoted, CAST(sum(coalesce(c, 0)) AS BIGINT) AS votes
FROM fx_vertices v LEFT JOIN vc ON vc.scene_id = v.scene_id AND vc.vertex_id = v.vertex_id GROUP BY 1""")
def _(t):
    return A.vote_coverage(t.vertices, A.vertex_votes(nearest_vertices(t)))


@query("distance_summary", f"""
WITH {NEAREST_SQL} SELECT scene_id, {r('min(dist)')} AS min, {r('quantile_cont(dist, 0.5)')} AS median, {r('quantile_cont(dist, 0.95)')} AS p95, {r('max(dist)')} AS max FROM hit GROUP BY 1""")
def _(t):
    out = A.distance_summary(nearest_vertices(t), SC)
    return out.select("scene_id", *(r6(F.col(c)).alias(c) for c in ("min", "median", "p95", "max")))


DEPTH_SQL = "f AS (SELECT scene_id, frame_id, min(depth) AS lo, max(depth) AS hi, avg(depth) AS mean, quantile_cont(depth, 0.5) AS med, avg(CASE WHEN depth > 0 THEN 1.0 ELSE 0 END) AS pos FROM fx_samples GROUP BY ALL)"


@query("depth_stats", f"""
WITH {DEPTH_SQL}, c AS (SELECT scene_id, frame_id, min(weight / 50) AS c_lo, max(weight / 50) AS c_hi, avg(sqrt(1 + 0.01::DOUBLE * (pix_row % 3) * (pix_row % 3))) AS n_mean,
  max(abs(sqrt(1 + 0.01::DOUBLE * (pix_row % 3) * (pix_row % 3)) - 1)) AS n_error FROM fx_samples GROUP BY ALL)
SELECT frame_id, {r('lo')} AS depth_min, {r('hi')} AS depth_max, {r('mean')} AS depth_mean, {r('med')} AS depth_median, {r('pos')} AS positive_fraction,
  {r('c_lo')} AS confidence_min, {r('c_hi')} AS confidence_max, {r('n_mean')} AS normal_norm_mean, {r('n_error')} AS normal_norm_max_error FROM f JOIN c USING (scene_id, frame_id)""")
def _(t):
    samples = t.samples.withColumns({"confidence": F.col("weight") / 50, "nx": F.lit(0.6), "ny": F.lit(0.8), "nz": 0.1 * (F.col("pix_row") % 3)})
    out = A.depth_stats(samples, FRAME, ["confidence"], ["nx", "ny", "nz"])
    return out.select("frame_id", *(r6(F.col(c)).alias(c) for c in (
        "depth_min", "depth_max", "depth_mean", "depth_median", "positive_fraction", "confidence_min", "confidence_max", "normal_norm_mean", "normal_norm_max_error")))


@query("mean_of_means", f"""
WITH {DEPTH_SQL} SELECT scene_id, count(*) AS frames, {r('min(lo)')} AS depth_min, {r('max(hi)')} AS depth_max, {r('avg(mean)')} AS mean_of_means FROM f GROUP BY 1""")
def _(t):
    out = A.mean_of_means(A.depth_stats(t.samples, FRAME), ["scene_id"])
    return out.select("scene_id", "frames", *(r6(F.col(c)).alias(c) for c in ("depth_min", "depth_max", "mean_of_means")))


@query("voxel_downsample", f"""
SELECT CAST(floor(x / 1.0::DOUBLE) AS BIGINT) AS vx, CAST(floor(y / 1.0::DOUBLE) AS BIGINT) AS vy, CAST(floor(z / 1.0::DOUBLE) AS BIGINT) AS vz, count(*) AS n,
  {r('avg(x)')} AS x, {r('avg(y)')} AS y, {r('avg(z)')} AS z FROM fx_vertices GROUP BY 1, 2, 3""")
def _(t):
    out = A.voxel_downsample(t.vertices, [], 1.0)
    return out.select("vx", "vy", "vz", "n", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("bounds", f"""
SELECT scene_id, {', '.join(f'{r(f"{m}({c})")} AS {m}_{c}' for c in 'xyz' for m in ('min', 'max'))},
  CAST(greatest(1, ceil(greatest({', '.join(f'abs({m}({c}))' for c in 'xyz' for m in ('min', 'max'))}) + 1)) AS BIGINT) AS scene_scale FROM fx_vertices GROUP BY 1""")
def _(t):
    out = A.bounds(t.vertices, ["scene_id"])
    return out.select("scene_id", *(r6(F.col(f"{m}_{c}")).alias(f"{m}_{c}") for c in "xyz" for m in ("min", "max")), "scene_scale")


@query("mesh_quality", f"""
WITH v AS (SELECT count(*) AS n_vertices, bool_and(isfinite(x) AND isfinite(y) AND isfinite(z)) AS finite FROM fx_mesh_vertices),
t AS (SELECT count(*) AS n_triangles, sum(0.5 * sqrt(nx*nx + ny*ny + nz*nz)) AS area, bool_and(v0 <> v1 AND v1 <> v2 AND v0 <> v2) AS proper FROM fx_normals),
m AS (SELECT count(*) AS missing FROM (SELECT unnest([v0, v1, v2]) AS i FROM fx_triangles) WHERE i NOT IN (SELECT vertex_id FROM fx_mesh_vertices))
SELECT CAST(0 AS BIGINT) AS scene_id, n_vertices, n_triangles, {r('area')} AS area, finite, proper, missing, n_vertices >= 100000 AND n_triangles >= 100000 AS large_enough FROM v, t, m""")
def _(t):
    from atrium.operators.quality import mesh_quality

    return mesh_quality(t.mesh_vertices, t.triangles).withColumn("area", r6(F.col("area")))


EIG_SQL = """{src},
mo AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM src GROUP BY k),
cv AS (SELECT s.k, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, avg((x-mx)*(x-mx)) AS xx, avg((y-my)*(y-my)) AS yy, avg((z-mz)*(z-mz)) AS zz,
  avg((x-mx)*(y-my)) AS xy, avg((x-mx)*(z-mz)) AS xz, avg((y-my)*(z-mz)) AS yz FROM src s JOIN mo ON mo.k = s.k GROUP BY s.k),
e1 AS (SELECT *, (xx+yy+zz)/3 AS q, sqrt(((xx-(xx+yy+zz)/3)*(xx-(xx+yy+zz)/3) + (yy-(xx+yy+zz)/3)*(yy-(xx+yy+zz)/3) + (zz-(xx+yy+zz)/3)*(zz-(xx+yy+zz)/3) + 2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM cv),
e2 AS (SELECT *, ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz)) / (2*p*p*p) AS r FROM e1 WHERE p > 0),
e3 AS (SELECT *, q + 2*p*cos(acos(greatest(-1, least(1, r)))/3 + 2*pi()/3) AS lam FROM e2),
e4 AS (SELECT *, (yy-lam)*(zz-lam)-yz*yz AS axx, (xx-lam)*(zz-lam)-xz*xz AS ayy, (xx-lam)*(yy-lam)-xy*xy AS azz,
  xz*yz-xy*(zz-lam) AS axy, xy*yz-xz*(yy-lam) AS axz, xy*xz-yz*(xx-lam) AS ayz FROM e3),
e5 AS (SELECT *, axx*axx+axy*axy+axz*axz AS bxx, axy*axy+ayy*ayy+ayz*ayz AS byy, axz*axz+ayz*ayz+azz*azz AS bzz,
  axx*axy+axy*ayy+axz*ayz AS bxy, axx*axz+axy*ayz+axz*azz AS bxz, axy*axz+ayy*ayz+ayz*azz AS byz FROM e4),
e6 AS (SELECT *, CASE WHEN bxx >= byy AND bxx >= bzz THEN bxx WHEN byy >= bzz THEN bxy ELSE bxz END AS vx,
  CASE WHEN bxx >= byy AND bxx >= bzz THEN bxy WHEN byy >= bzz THEN byy ELSE byz END AS vy,
  CASE WHEN bxx >= byy AND bxx >= bzz THEN bxz WHEN byy >= bzz THEN byz ELSE bzz END AS vz FROM e5),
e7 AS (SELECT *, CASE WHEN vz < 0 THEN -1 ELSE 1 END / sqrt(vx*vx + vy*vy + vz*vz) AS s FROM e6),
pl AS (SELECT k, n, mx, my, mz, vx*s AS a, vy*s AS b, vz*s AS c, -(vx*mx + vy*my + vz*mz)*s AS d FROM e7)"""


@query("fit_plane_group", f"""
WITH {EIG_SQL.format(src='src AS (SELECT segment_id AS k, x, y, z FROM fx_vertices)')}
SELECT CAST(k AS INT) AS segment_id, {', '.join(f'{r(c, 4)} AS {c}' for c in 'abcd')} FROM pl""")
def _(t):
    out = A.fit_plane_group(t.vertices, ["segment_id"])
    return out.select("segment_id", *(r6(F.col(c), 4).alias(c) for c in "abcd"))


@query("polygon_elevation", f"""
SELECT polygon_id, {r('avg(z)')} AS elevation FROM (SELECT DISTINCT t.polygon_id, v.vertex_id, v.z FROM
  (SELECT polygon_id, unnest([v0, v1, v2]) AS vertex_id FROM fx_triangles) t JOIN fx_mesh_vertices v ON v.vertex_id = t.vertex_id) GROUP BY 1""")
def _(t):
    from atrium.operators.rooms import polygon_elevation

    out = polygon_elevation(t.triangles, t.mesh_vertices)
    return out.select("polygon_id", r6(F.col("elevation")).alias("elevation"))


@query("polygon_height_interval", f"""
SELECT polygon_id, {r('min(least(az, bz, cz))')} AS z_min, {r('max(greatest(az, bz, cz))')} AS z_max FROM fx_corners GROUP BY 1""")
def _(t):
    from atrium.operators.rooms import polygon_height_interval

    out = polygon_height_interval(t.triangles, t.mesh_vertices)
    return out.select("polygon_id", r6(F.col("z_min")).alias("z_min"), r6(F.col("z_max")).alias("z_max"))


@query("weighted_elevation", f"""
SELECT s_nationkey AS level_key, {r('sum(greatest(s_acctbal, 1e-6) * (2.4 + s_suppkey % 5 * 0.1::DOUBLE)) / sum(greatest(s_acctbal, 1e-6))')} AS elevation FROM supplier GROUP BY 1""")
def _(t):
    d = t.raw("supplier").selectExpr("s_nationkey AS level_key", "2.4D + s_suppkey % 5 * 0.1D AS z", "s_acctbal AS area")
    return A.weighted_elevation(d, ["level_key"], "z", "area").withColumn("elevation", r6(F.col("elevation")))


RING_SQL = "ring AS (SELECT room_key, unnest([[x0, y0], [x1 + room_key % 3, y0], [x1, y1 + 1], [x0, y1]]) AS p, unnest([[x1 + room_key % 3, y0], [x1, y1 + 1], [x0, y1], [x0, y0]]) AS q FROM fx_rooms)"


def room_rings(t):
    return t.rooms.selectExpr("room_key", "array(struct(x0 AS x, y0 AS y), struct(x1 + room_key % 3 AS x, y0 AS y), struct(x1 AS x, y1 + 1 AS y), struct(x0 AS x, y1 AS y)) AS ring")


@query("polygon_area", f"WITH {RING_SQL} SELECT room_key, {r('sum(p[1]*q[2] - q[1]*p[2]) / 2')} AS area FROM ring GROUP BY 1")
def _(t):
    from atrium.operators.polygons import ring_area2, ring_edges

    return ring_area2(ring_edges(room_rings(t), ["room_key"]), ["room_key"]).select("room_key", r6(F.col("area")).alias("area"))


@query("polygon_length", f"""
WITH {RING_SQL} SELECT room_key, {r('sum(l)')} AS perimeter, {r('sum(sqrt(l))')} AS root_length, {r('sum(l * CASE WHEN q[2] > p[2] THEN 0.1 ELSE 1 END)')} AS shared_length
FROM (SELECT *, sqrt((q[1]-p[1])*(q[1]-p[1]) + (q[2]-p[2])*(q[2]-p[2])) AS l FROM ring) GROUP BY 1""")
def _(t):
    from atrium.operators.polygons import polygon_length, ring_edges

    edges = ring_edges(room_rings(t), ["room_key"]).withColumn("n_planes", F.when(F.col("y1") > F.col("y0"), 2).otherwise(1))
    out = polygon_length(edges, ["room_key"])
    return out.select("room_key", *(r6(F.col(c)).alias(c) for c in ("perimeter", "root_length", "shared_length")))


@query("area_per_polygon", f"SELECT polygon_id, count(*) AS n_triangles, {r('sum(0.5 * sqrt(nx*nx + ny*ny + nz*nz))')} AS area FROM fx_normals GROUP BY 1")
def _(t):
    d = mesh.with_area_normal(mesh.corners(t.triangles, t.mesh_vertices))
    return d.groupBy("polygon_id").agg(F.count("*").alias("n_triangles"), r6(F.sum("area")).alias("area"))


NORMALS_SQL = "n AS (SELECT vertex_id, vertex_id % (SELECT count(*) FROM fx_planes) AS polygon_id, x, y, z, sin(vertex_id) AS nx, cos(vertex_id) AS ny, sin(vertex_id * 2) AS nz FROM fx_vertices)"


def points_with_normals(t):
    i = F.col("vertex_id")
    return pointing(t, t.vertices).select("vertex_id", "polygon_id", "x", "y", "z", F.sin(i).alias("nx"), F.cos(i).alias("ny"), F.sin(i * 2).alias("nz"))


@query("flip_normals_majority", f"""
WITH {NORMALS_SQL} SELECT p.polygon_id, count(*) FILTER (nx*a + ny*b + nz*c < 0) * 2 > count(*) AS flipped FROM n JOIN fx_planes p ON p.polygon_id = n.polygon_id GROUP BY 1""")
def _(t):
    return A.flip_normals_majority(points_with_normals(t), planes(t), ["polygon_id"]).select("polygon_id", "flipped")


@query("plane_error", f"""
WITH {NORMALS_SQL} SELECT p.polygon_id, {r('avg(abs(a*x + b*y + c*z + d))')} AS mean_distance,
  {r('avg(degrees(acos(greatest(-1, least(1, nx*a + ny*b + nz*c)))))', 4)} AS mean_angle FROM n JOIN fx_planes p ON p.polygon_id = n.polygon_id GROUP BY 1""")
def _(t):
    out = A.plane_error(points_with_normals(t), planes(t), ["polygon_id"])
    return out.select("polygon_id", r6(F.col("mean_distance")).alias("mean_distance"), r6(F.col("mean_angle"), 4).alias("mean_angle"))


@query("planes_per_vertex", """
WITH l AS (SELECT vertex_id, unnest(list_slice([vertex_id % 10, vertex_id % 7, 3], 1, CAST(vertex_id % 4 AS INT))) AS plane_id FROM fx_vertices)
SELECT v.vertex_id, count(DISTINCT plane_id) AS n_planes, list_sort(coalesce(list(DISTINCT plane_id) FILTER (plane_id IS NOT NULL), [])) AS planes FROM fx_vertices v LEFT JOIN l ON l.vertex_id = v.vertex_id GROUP BY 1""")
def _(t):
    links = t.vertices.selectExpr("scene_id", "vertex_id", "explode(slice(array(vertex_id % 10, vertex_id % 7, 3L), 1, CAST(vertex_id % 4 AS INT))) AS plane_id")
    sets = mesh.vertex_plane_sets(links)
    full = t.vertices.select("scene_id", "vertex_id").join(sets, ["scene_id", "vertex_id"], "left")
    return full.select("vertex_id", F.coalesce(F.size("planes"), F.lit(0)).cast("bigint").alias("n_planes"),
                       F.coalesce("planes", F.array().cast("array<bigint>")).alias("planes"))


@query("constraint_order", """
WITH l AS (SELECT vertex_id, unnest([vertex_id % 10, 10 + vertex_id % 7, 20 + vertex_id % 3]) AS plane_id FROM fx_vertices),
p AS (SELECT plane_id, count(*) AS population FROM l GROUP BY 1)
SELECT vertex_id, l.plane_id, CAST(row_number() OVER (PARTITION BY vertex_id ORDER BY population, l.plane_id) - 1 AS INT) AS rank FROM l JOIN p ON p.plane_id = l.plane_id""")
def _(t):
    links = t.vertices.selectExpr("0 AS scene_id", "vertex_id", "explode(array(vertex_id % 10, 10 + vertex_id % 7, 20 + vertex_id % 3)) AS plane_id")
    return mesh.constraint_order(links).select("vertex_id", "plane_id", "rank")


@query("bool_validation", """
SELECT polygon_id, bool_and(v0 <> v1) AS distinct_corners, bool_and(v0 >= 0 AND v2 < (SELECT count(*) FROM part)) AS in_range, count(*) >= 700 AS non_empty,
  bool_and(v0 <> v1) AND bool_and(v0 >= 0 AND v2 < (SELECT count(*) FROM part)) AND count(*) >= 700 AS passed FROM fx_triangles GROUP BY 1""")
def _(t):
    total = t.raw("part").agg(F.count("*").alias("total"))  # one row
    tri = t.triangles.join(F.broadcast(total)).withColumn("one", F.lit(1))
    sizes = tri.groupBy("polygon_id").agg(F.count("*").alias("size"))
    out = A.validation(tri.join(sizes, "polygon_id"), ["polygon_id"], {
        "distinct_corners": F.col("v0") != F.col("v1"), "in_range": (F.col("v0") >= 0) & (F.col("v2") < F.col("total")), "non_empty": F.col("size") >= 700})
    return out.select("polygon_id", *(F.col("validation")[n].alias(n) for n in ("distinct_corners", "in_range", "non_empty")), "passed")


# ---- windows and sampling ------------------------------------------------------------------------


@query("ring_lead", "WITH r AS (SELECT room_key, unnest([x0, x1, x1, x0]) AS x, unnest([x1, x1, x0, x0]) AS nx, unnest([0, 1, 2, 3]) AS i FROM fx_rooms) SELECT room_key, CAST(i AS INT) AS i, x, nx AS next_x FROM r")
def _(t):
    from atrium.operators.polygons import ring_lead

    rows = t.rooms.selectExpr("room_key", "posexplode(array(x0, x1, x1, x0)) AS (i, x)")
    return ring_lead(rows, ["room_key"], "i", {"x": "next_x"}).select("room_key", "i", "x", "next_x")


@query("contour_angles", f"""
WITH r AS (SELECT room_key, unnest([0, 1, 2, 3]) AS i, unnest([[x0, y0], [x1 + room_key % 3, y0], [x1, y1 + 1], [x0, y1]]) AS p FROM fx_rooms),
n AS (SELECT a.room_key, a.i, a.p[1] - z.p[1] AS ux, a.p[2] - z.p[2] AS uy, b.p[1] - a.p[1] AS wx, b.p[2] - a.p[2] AS wy
  FROM r a JOIN r b ON b.room_key = a.room_key AND b.i = (a.i + 1) % 4 JOIN r z ON z.room_key = a.room_key AND z.i = (a.i + 3) % 4)
SELECT room_key, CAST(i AS INT) AS i, {r('degrees(acos(greatest(-1, least(1, (ux*wx + uy*wy) / sqrt(ux*ux+uy*uy) / sqrt(wx*wx+wy*wy)))))', 4)} AS turn FROM n""")
def _(t):
    from atrium.operators.polygons import contour_angles

    rows = room_rings(t).select("room_key", F.posexplode("ring").alias("i", "p")).select("room_key", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.lit(0.0).alias("z"))
    return contour_angles(rows, ["room_key"], "i").select("room_key", "i", r6(F.col("turn"), 4).alias("turn"))


@query("cluster_extent", f"SELECT wall_id, count(*) AS n, {r('min(u)')} AS u_min, {r('max(u)')} AS u_max, {r('max(u) - min(u)')} AS width, {r('max(z) - min(z)')} AS height FROM fx_evidence GROUP BY 1")
def _(t):
    from atrium.operators.rooms import cluster_extent

    out = cluster_extent(t.evidence, ["wall_id"])
    return out.select("wall_id", "n", *(r6(F.col(c)).alias(c) for c in ("u_min", "u_max", "width", "height")))


@query("dense_remap", "SELECT hint_vertex AS old_id, dense_rank() OVER (ORDER BY hint_vertex) - 1 AS new_id FROM (SELECT DISTINCT hint_vertex FROM fx_rays)")
def _(t):
    ids = t.rays.select(F.col("hint_vertex").alias("old_id"))
    return ranking.dense_index(ids, "old_id", "new_id")


@query("sample_per_frame", """
WITH k AS (SELECT frame_id, pix_row, pix_col, coco_id, row_number() OVER (PARTITION BY frame_id ORDER BY md5('7|' || frame_id || '|' || pix_row || '|' || pix_col), coco_id) AS rn
  FROM (SELECT DISTINCT frame_id, pix_row, pix_col, coco_id FROM fx_samples)) SELECT frame_id, pix_row, pix_col, coco_id FROM k WHERE rn <= 3""")
def _(t):
    from atrium.operators.sampling import sample_per_group

    pixels = t.samples.select("frame_id", "pix_row", "pix_col", "coco_id").distinct()
    return sample_per_group(pixels, ["frame_id"], 3, 7, ["frame_id", "pix_row", "pix_col"], ["coco_id"])


@query("cap_points", "SELECT vertex_id FROM fx_vertices ORDER BY md5('11|' || vertex_id), vertex_id LIMIT (SELECT CAST(count(*) // 4 AS BIGINT) FROM fx_vertices)")
def _(t):
    from atrium.operators.sampling import cap_rows

    n = t.raw("part").count() // 4
    return cap_rows(t.vertices, n, 11, ["vertex_id"]).select("vertex_id")


@query("preview_rows", """
WITH n AS (SELECT count(*) AS n FROM orders), f AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS idx FROM fx_frames)
SELECT frame_id, idx FROM f, n WHERE idx IN (SELECT CAST(floor(i * (n - 1) / CAST(11 AS DOUBLE)) AS BIGINT) FROM range(12) t(i))""")
def _(t):
    from atrium.operators.sampling import preview_rows

    return preview_rows(t.frames.select("frame_id"), "frame_id", 12).select("frame_id", "idx")


@query("first_rays", """
SELECT frame_id, pix_row, pix_col, depth FROM (SELECT DISTINCT frame_id, pix_row, pix_col, depth FROM fx_samples WHERE depth > 0) ORDER BY frame_id, pix_row, pix_col, depth LIMIT 2000""")
def _(t):
    valid = t.samples.filter(cameras.valid_depth(F.col("depth"))).select("frame_id", "pix_row", "pix_col", "depth").distinct()
    return valid.orderBy("frame_id", "pix_row", "pix_col", "depth").limit(2000)


@query("argmax_label", """
SELECT frame_id, coco_id, n FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, coco_id) AS rn FROM (
  SELECT frame_id, coco_id, count(*) AS n FROM fx_samples GROUP BY ALL)) WHERE rn = 1""")
def _(t):
    n = t.samples.groupBy("frame_id", "coco_id").agg(F.count("*").alias("n"))
    return A.argmax_label(n, ["frame_id"], "coco_id", "n")


@query("sample_mesh_surface", f"""
WITH a AS (SELECT triangle_id, 0.5 * sqrt(nx*nx + ny*ny + nz*nz) AS area FROM fx_normals)
SELECT CAST(0 AS BIGINT) AS scene_id, CAST(round(sum(area) * 40) AS BIGINT) AS n_samples, CAST(round(sum(area) * 40) AS BIGINT) AS n_on_mesh, true AS all_inside FROM a""")
def _(t):
    from atrium.operators.sampling import sample_mesh_surface

    cornered = mesh.corners(t.triangles, t.mesh_vertices)
    pts = sample_mesh_surface(cornered, 40.0, seed=5)
    on = V.triangle_distance2(V.vec(), *mesh.corner_vectors()) < 1e-12
    joined = pts.join(cornered.select("scene_id", "triangle_id", *(f"{n}{c}" for n in "abc" for c in "xyz")), ["scene_id", "triangle_id"])
    return joined.groupBy("scene_id").agg(F.count("*").alias("n_samples"), F.count_if(on).alias("n_on_mesh"),
                                          F.every((F.col("w0") >= 0) & (F.col("w1") >= 0) & (F.col("w2") >= 0)).alias("all_inside"))


# ---- strings, maps and times ---------------------------------------------------------------------


@query("path_name_stem", """
SELECT page_id, CASE WHEN instr(url, '/') = 0 THEN url ELSE regexp_extract(url, '([^/]*)$', 1) END AS name,
  regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages""")
def _(t):
    from atrium.functions.text import base_name, stem

    return t.raw("pages").select("page_id", base_name(F.col("url")).alias("name"), stem(F.col("url")).alias("stem"))


@query("relocate_path", """
SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN '/data/' || regexp_extract(url, '/en/(.*)$', 1)
  WHEN regexp_matches(url, '/fr/') THEN '/mirror/' || regexp_extract(url, '/fr/(.*)$', 1) END AS path FROM pages""")
def _(t):
    from atrium.functions.text import relocate

    return t.raw("pages").select("page_id", relocate(F.col("url"), {"en": "/data", "fr": "/mirror"}).alias("path"))


@query("checkpoint_step", """
SELECT o_custkey AS run_id, max(o_orderkey) AS step, max(o_orderkey) >= 7000 AS complete FROM orders GROUP BY 1""")
def _(t):
    from atrium.functions.text import checkpoint_step

    files = t.raw("orders").selectExpr("o_custkey AS run_id", "concat('out/step-', lpad(CAST(o_orderkey AS STRING), 9, '0'), '.ckpt') AS path")
    step = checkpoint_step(F.col("path"))
    return files.groupBy("run_id").agg(F.max(step).alias("step")).withColumn("complete", F.col("step") >= 7000)


@query("format_ids", "SELECT room_key, room_id, 'opening_' || lpad(CAST(room_key AS VARCHAR), 3, '0') AS opening_id, room_id || ':wall:' || level_key || ':above_opening_' || lpad(CAST(room_key AS VARCHAR), 3, '0') AS wall_id FROM fx_rooms")
def _(t):
    from atrium.functions.text import opening_id, room_id, wall_id

    opening = opening_id(F.col("room_key"))
    room = room_id(F.col("level_key"), F.col("room_key"))
    return t.rooms.select("room_key", room.alias("room_id"), opening.alias("opening_id"), wall_id(room, F.col("level_key"), opening).alias("wall_id"))


@query("hist_json", """
SELECT frame_id, '{' || string_agg('"' || coco_id || '":' || n, ',' ORDER BY coco_id) || '}' AS histogram FROM (SELECT frame_id, coco_id, count(*) AS n FROM fx_samples GROUP BY ALL) GROUP BY 1""")
def _(t):
    from atrium.functions.text import histogram_json

    n = t.samples.groupBy("frame_id", "coco_id").agg(F.count("*").alias("n"))
    return n.groupBy("frame_id").agg(histogram_json("coco_id", "n").alias("histogram"))


@query("argsort_array", """
SELECT polygon_id, list_sort([x0, y1, x1 - 2, y0]) AS sorted, CAST(CASE WHEN abs(a) <= abs(b) AND abs(a) <= abs(c) THEN 0 WHEN abs(b) <= abs(c) THEN 1 ELSE 2 END AS INT) AS argmin,
  list_filter([x0, y1, x1 - 2, y0], lambda v: v > 5) AS large FROM fx_ceilings""")
def _(t):
    from atrium.functions.text import argmin_array

    vals = F.array("x0", "y1", F.col("x1") - 2, "y0")
    return t.ceilings.select("polygon_id", F.array_sort(vals).alias("sorted"), argmin_array(F.array(*(F.abs(c) for c in "abc"))).alias("argmin"),
                             F.filter(vals, lambda v: v > 5).alias("large"))


@query("elapsed", f"""
SELECT scene_id, {r("date_diff('microsecond', min(ts), max(ts)) / CAST(1000000 AS DOUBLE)")} AS elapsed_seconds, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS finished_at FROM fx_frame_events GROUP BY 1""")
def _(t):
    from atrium.functions.text import elapsed_seconds, iso_utc

    g = t.frame_events.groupBy("scene_id").agg(F.min("ts").alias("started"), F.max("ts").alias("finished"))
    return g.select("scene_id", r6(elapsed_seconds(F.col("started"), F.col("finished"))).alias("elapsed_seconds"), iso_utc(F.col("finished")).alias("finished_at"))
