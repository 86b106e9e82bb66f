"""Registered queries: camera, plane, line, triangle and grid expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions import colors
from atrium.functions import labels as L
from atrium.functions import vectors as V
from atrium.functions.vectors import r6
from atrium.operators import cameras, grids, mesh
from atrium.plans.registry import query, r

FX = FY = 400.0
CX, CY = 400.0, 300.0


def planes(t) -> DataFrame:
    """Unit planes of the ceiling candidates."""
    l = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return t.ceilings.select("polygon_id", *((F.col(k) / l).alias(k) for k in "abcd"))


def pointing(t, rows: DataFrame) -> DataFrame:
    """Vertices with the id of one of all planes, by their own id modulo the number of planes."""
    total = t.ceilings.agg(F.count("*").alias("_planes"))  # one row
    return rows.join(F.broadcast(total)).withColumn("polygon_id", F.col("vertex_id") % F.col("_planes")).drop("_planes")


def on_planes(t) -> DataFrame:
    """Vertices with the plane their id points at; the shuffle key is the plane id."""
    return pointing(t, t.vertices).join(planes(t), "polygon_id")


def xyz(v: V.Vec, prefix: str = "") -> list:
    return [r6(c).alias(f"{prefix}{n}") for c, n in zip(v, "xyz")]


def rxyz(prefix: str, *exprs: str) -> str:
    return ", ".join(f"{r(e)} AS {prefix}{n}" for e, n in zip(exprs, "xyz"))


# ---- cameras -------------------------------------------------------------------------------------


@query("pinhole_intrinsics", f"""
WITH p AS (SELECT o_custkey AS scene_id, o_orderkey AS idx,
    CASE WHEN o_orderkey % 2 = 0 THEN 640 + o_custkey % 7 * 16 END AS w, CASE WHEN o_orderkey % 3 = 0 THEN 480 END AS h,
    CASE WHEN o_orderkey % 5 = 0 THEN 300 + o_orderkey % 100 END AS fx,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST(0.9 AS DOUBLE) END AS ax, CASE WHEN o_orderkey % 7 = 0 THEN 310.0 END AS cx
  FROM orders),
f AS (SELECT scene_id, arg_min(w, CASE WHEN w IS NOT NULL THEN idx END) AS w, arg_min(h, CASE WHEN h IS NOT NULL THEN idx END) AS h,
    arg_min(fx, CASE WHEN fx IS NOT NULL THEN idx END) AS fx, arg_min(ax, CASE WHEN ax IS NOT NULL THEN idx END) AS ax,
    arg_min(cx, CASE WHEN cx IS NOT NULL THEN idx END) AS cx FROM p GROUP BY scene_id),
g AS (SELECT scene_id, w, h, coalesce(CAST(fx AS DOUBLE), 0.5 * w / tan(0.5 * ax)) AS fx, coalesce(CAST(cx AS DOUBLE), w / 2.0) AS cx FROM f)
SELECT scene_id, CAST(w AS INT) AS width, CAST(h AS INT) AS height, {r('fx')} AS fx, {r('fx')} AS fy,
  {r('CAST(cx AS DOUBLE)')} AS cx, {r('h / CAST(2 AS DOUBLE)')} AS cy, coalesce(w > 0 AND h > 0 AND fx > 0, false) AS valid FROM g""")
def _(t):
    payloads = t.raw("orders").selectExpr(
        "o_custkey AS scene_id", "o_orderkey AS idx",
        "CASE WHEN o_orderkey % 2 = 0 THEN 640 + o_custkey % 7 * 16 END AS w",
        "CASE WHEN o_orderkey % 3 = 0 THEN 480 END AS height",
        "CASE WHEN o_orderkey % 5 = 0 THEN 300 + o_orderkey % 100 END AS fl_x",
        "CASE WHEN o_orderkey % 4 = 0 THEN 0.9D END AS camera_angle_x",
        "CASE WHEN o_orderkey % 7 = 0 THEN 310D END AS cx",
        "CAST(NULL AS DOUBLE) AS fy", "CAST(NULL AS DOUBLE) AS cy", "CAST(NULL AS DOUBLE) AS camera_angle_y",
    )
    out = cameras.pinhole_intrinsics(payloads, ["scene_id"], "idx")
    return out.select("scene_id", "width", "height", *(r6(F.col(c)).alias(c) for c in ("fx", "fy", "cx", "cy")), "valid")


@query("remap_labels", """
SELECT m.layout_id, s.coco_id, count(*) AS n FROM fx_samples s JOIN label_map m ON m.coco_id = s.coco_id GROUP BY ALL""")
def _(t):
    return t.samples.select("coco_id", L.layout_id(F.col("coco_id")).alias("layout_id")).groupBy(
        "layout_id", "coco_id").agg(F.count("*").alias("n"))


def vocabulary(t) -> DataFrame:
    """Panoptic names as the samples would report them: two wrong names, one id beyond the range."""
    expected = F.create_map(*(F.lit(x) for kv in L.EXPECTED_NAMES.items() for x in kv))
    ids = t.raw("lineitem").select((F.col("l_partkey") % 135).cast("int").alias("id")).distinct().filter("id <> 7 AND id <> 134")
    name = F.coalesce(F.try_element_at(expected, F.col("id")), F.concat(F.lit("class-"), F.col("id")))
    return ids.select("id", F.when(F.col("id").isin(93, 115), F.lit("odd")).otherwise(name).alias("name"))


EXPECTED_SQL = ", ".join(f"({i}, '{n}')" for i, n in L.EXPECTED_NAMES.items())
VOCABULARY_SQL = f"""expected(id, expected) AS (VALUES {EXPECTED_SQL}),
vocab AS (SELECT u.id, CASE WHEN u.id IN (93, 115) THEN 'odd' ELSE coalesce(e.expected, 'class-' || CAST(u.id AS VARCHAR)) END AS name
  FROM (SELECT DISTINCT CAST(l_partkey % 135 AS INT) AS id FROM lineitem) u LEFT JOIN expected e ON e.id = u.id WHERE u.id NOT IN (7, 134))"""


@query("label_contract", f"""
WITH {VOCABULARY_SQL},
req AS (SELECT CAST(range AS INT) AS id, expected FROM range(133) LEFT JOIN expected ON expected.id = range),
j AS (SELECT coalesce(v.id, q.id) AS id, q.expected, v.name AS actual,
  CASE WHEN v.id IS NULL THEN 'missing' WHEN q.id IS NULL THEN 'unexpected' WHEN q.expected <> v.name THEN 'renamed' END AS problem
  FROM vocab v FULL JOIN req q ON q.id = v.id)
SELECT * FROM j WHERE problem IS NOT NULL""")
def _(t):
    return L.check_vocabulary(vocabulary(t))


@query("layout_members", f"""
WITH {VOCABULARY_SQL}
SELECT coalesce(m.layout_id, 8) AS layout_id, list_sort(list(v.id)) AS coco_ids,
  ['wall','ceiling','floor','surface','inaccurate_window','inaccurate_mirror','inaccurate_outdoor','stairs','object'][coalesce(m.layout_id, 8) + 1] AS layout_name
FROM vocab v LEFT JOIN label_map m ON m.coco_id = v.id GROUP BY ALL""")
def _(t):
    return L.layout_members(vocabulary(t))


@query("metric_depth", f"""
WITH i AS (SELECT frame_id, pix_row, pix_col, depth, CAST(480 + frame_id % 5 * 120 AS DOUBLE) AS h, CAST(640 + frame_id % 7 * 160 AS DOUBLE) AS w FROM fx_samples),
s AS (SELECT *, least(616 / h, 1064 / w) AS s FROM i)
SELECT frame_id, pix_row, pix_col, {r('s')} AS resize_scale, CAST(floor(w * s) AS BIGINT) AS new_width, CAST(floor(h * s) AS BIGINT) AS new_height,
  CAST(floor((616 - floor(h * s)) / 2) AS BIGINT) AS pad_top, CAST(616 - floor(h * s) - floor((616 - floor(h * s)) / 2) AS BIGINT) AS pad_bottom,
  CAST(floor((1064 - floor(w * s)) / 2) AS BIGINT) AS pad_left, CAST(1064 - floor(w * s) - floor((1064 - floor(w * s)) / 2) AS BIGINT) AS pad_right,
  {r('greatest(0, least(300, depth * 400 * s / 1000))')} AS depth FROM s""")
def _(t):
    d = t.samples.selectExpr("frame_id", "pix_row", "pix_col", "depth",
                             "CAST(480 + frame_id % 5 * 120 AS DOUBLE) AS h", "CAST(640 + frame_id % 7 * 160 AS DOUBLE) AS w")
    box = cameras.letterbox(F.col("w"), F.col("h"))
    scale = box.pop("resize_scale")
    return d.withColumn("s", scale).select(
        "frame_id", "pix_row", "pix_col", r6(F.col("s")).alias("resize_scale"),
        *(c.cast("bigint").alias(n) for n, c in box.items()),
        r6(cameras.metric_depth(F.col("depth"), F.lit(FX), F.col("s"))).alias("depth"))


@query("unproject_depth", f"""
WITH p AS (SELECT s.*, f.cosy, f.siny, f.tx, f.ty, f.tz, (pix_col - 400.0::DOUBLE) * depth / 400 AS px, -((pix_row - 300.0::DOUBLE) * depth / 400) AS py, -depth AS pz
  FROM fx_samples s JOIN fx_frames f USING (scene_id, frame_id) WHERE pix_row % 2 = 0 AND pix_col % 2 = 0 AND depth BETWEEN 0.1 AND 30)
SELECT frame_id, pix_row, pix_col, {r('cosy*px - siny*py + 0*pz + tx')} AS x, {r('siny*px + cosy*py + 0*pz + ty')} AS y, {r('pz + tz')} AS z FROM p""")
def _(t):
    out = cameras.unproject_depth(t.samples, t.frames, FX, FY, CX, CY, stride=2)
    return out.select("frame_id", "pix_row", "pix_col", *xyz(V.vec()))


@query("backproject_samples", f"""
WITH p AS (SELECT s.*, f.cosy, f.siny, f.tx, f.ty, f.tz, CASE WHEN depth > 0 THEN depth ELSE 0.5 END AS dd FROM fx_samples s JOIN fx_frames f USING (scene_id, frame_id)),
q AS (SELECT *, (pix_col + 0.5::DOUBLE - 400) * dd / 400 AS px, -((pix_row + 0.5::DOUBLE - 300) * dd / 400) AS py, -dd AS pz FROM p)
SELECT frame_id, pix_row, pix_col, depth > 0 AS valid, tx AS ox, ty AS oy, tz AS oz,
  {r('cosy*px - siny*py + tx')} AS x, {r('siny*px + cosy*py + ty')} AS y, {r('pz + tz')} AS z FROM q""")
def _(t):
    flat = t.samples.withColumn("at", F.col("pix_row") * 800 + F.col("pix_col")).drop("pix_row", "pix_col")
    out = cameras.backproject_samples(flat, t.frames, FX, FY, CX, CY, flat="at", width=800)
    return out.select("frame_id", "pix_row", "pix_col", "valid", "ox", "oy", "oz", *xyz(V.vec()))


# ---- planes and lines ----------------------------------------------------------------------------

ON_PLANES = "v AS (SELECT v.*, p.polygon_id, p.a, p.b, p.c, p.d FROM fx_vertices v JOIN fx_planes p ON p.polygon_id = v.vertex_id % (SELECT count(*) FROM fx_planes))"
DIST = "(a*x + b*y + c*z + d)"


@query("plane_signed_distance", f"WITH {ON_PLANES} SELECT vertex_id, polygon_id, {r(DIST)} AS dist FROM v")
def _(t):
    return on_planes(t).select("vertex_id", "polygon_id", r6(V.plane().at(V.vec())).alias("dist"))


@query("project_to_plane", f"""
WITH {ON_PLANES} SELECT vertex_id, {rxyz('', f'x - {DIST}*a', f'y - {DIST}*b', f'z - {DIST}*c')}, {r(f'abs({DIST})')} AS dist FROM v""")
def _(t):
    foot, dist = V.project_to_plane(V.vec(), V.plane())
    return on_planes(t).select("vertex_id", *xyz(foot), r6(dist).alias("dist"))


@query("plane_basis_2d", f"""
WITH n AS (SELECT polygon_id, nx / l AS nx, ny / l AS ny, nz / l AS nz FROM (
    SELECT polygon_id, a + polygon_id % 3 AS nx, b - polygon_id % 2 AS ny, c AS nz,
      sqrt((a + polygon_id % 3)*(a + polygon_id % 3) + (b - polygon_id % 2)*(b - polygon_id % 2) + c*c) AS l FROM fx_ceilings)),
k AS (SELECT *, CASE WHEN abs(nx) <= abs(ny) AND abs(nx) <= abs(nz) THEN 0 WHEN abs(ny) <= abs(nz) THEN 1 ELSE 2 END AS k FROM n),
u AS (SELECT *, CASE k WHEN 0 THEN 0 WHEN 1 THEN -nz ELSE ny END AS ux0, CASE k WHEN 0 THEN nz WHEN 1 THEN 0 ELSE -nx END AS uy0,
  CASE k WHEN 0 THEN -ny WHEN 1 THEN nx ELSE 0 END AS uz0 FROM k),
w AS (SELECT *, sqrt(ux0*ux0 + uy0*uy0 + uz0*uz0) AS l FROM u),
e AS (SELECT polygon_id, nx, ny, nz, ux0/l AS ux, uy0/l AS uy, uz0/l AS uz FROM w)
SELECT polygon_id, {rxyz('u', 'ux', 'uy', 'uz')}, {rxyz('v', 'ny*uz - nz*uy', 'nz*ux - nx*uz', 'nx*uy - ny*ux')} FROM e""")
def _(t):
    n = V.Vec(F.col("a") + F.col("polygon_id") % 3, F.col("b") - F.col("polygon_id") % 2, F.col("c")).unit()
    u, v = V.plane_axes(V.vec("n"))
    return t.ceilings.select("polygon_id", *(c.alias(f"n{k}") for c, k in zip(n, "xyz"))).select(
        "polygon_id", *xyz(u, "u"), *xyz(v, "v"))


SLOPE = """n AS (SELECT vertex_id, x, y, z, a, b, c, d, 1 / l AS ex, -a / c / l AS ez FROM (SELECT *, sqrt(1 + (a/c)*(a/c)) AS l FROM v)),
m AS (SELECT *, b*ez AS fx0, c*ex - a*ez AS fy0, -b*ex AS fz0 FROM n), k AS (SELECT *, sqrt(fx0*fx0 + fy0*fy0 + fz0*fz0) AS fl FROM m),
s AS (SELECT *, x*ex + z*ez AS u, (x*fx0 + y*fy0 + z*fz0) / fl AS w FROM k)"""


@query("plane_to_2d", f"WITH {ON_PLANES}, {SLOPE} SELECT vertex_id, {r('u')} AS u, {r('w')} AS w FROM s")
def _(t):
    e1, e2 = V.slope_axes(V.plane().n)
    return on_planes(t).select("vertex_id", r6(V.vec().dot(e1)).alias("u"), r6(V.vec().dot(e2)).alias("w"))


@query("plane_from_2d", f"""
WITH {ON_PLANES}, {SLOPE}
SELECT vertex_id, {rxyz('', 'x - (a*x+b*y+c*z)*a - d*a', 'y - (a*x+b*y+c*z)*b - d*b', 'z - (a*x+b*y+c*z)*c - d*c')} FROM s""")
def _(t):
    pl = V.plane()
    e1, e2 = V.slope_axes(pl.n)
    flat = on_planes(t).withColumns({"u": V.vec().dot(e1), "w": V.vec().dot(e2)})
    back = e1.scale(F.col("u")) + e2.scale(F.col("w")) - pl.n.scale(pl.d)
    return flat.select("vertex_id", *xyz(back))


@query("line_projection", f"""
WITH l AS (SELECT v.vertex_id, v.x, v.y, v.z, p.a AS dx, p.b AS dy, p.c AS dz FROM fx_vertices v JOIN fx_planes p ON p.polygon_id = v.vertex_id % (SELECT count(*) FROM fx_planes)),
q AS (SELECT *, ((x-1)*dx + (y-2)*dy + (z-3)*dz) / (dx*dx+dy*dy+dz*dz) AS t FROM l)
SELECT vertex_id, {rxyz('', '1 + t*dx', '2 + t*dy', '3 + t*dz')},
  {r('sqrt((x-1-t*dx)*(x-1-t*dx) + (y-2-t*dy)*(y-2-t*dy) + (z-3-t*dz)*(z-3-t*dz))')} AS dist FROM q""")
def _(t):
    p1 = V.const(1, 2, 3)
    foot, dist = V.project_to_line(V.vec(), p1, p1 + V.plane().n)
    return on_planes(t).select("vertex_id", *xyz(foot), r6(dist).alias("dist"))


PAIRS_SQL = """pairs AS (SELECT p.polygon_id, p.a AS a1, p.b AS b1, p.c AS c1, p.d AS d1, q.a AS a2, q.b AS b2, q.c AS c2, q.d AS d2
  FROM fx_planes p JOIN fx_planes q ON q.polygon_id = p.polygon_id + 1)"""


def plane_pairs(t) -> DataFrame:
    one = planes(t).toDF("polygon_id", "a1", "b1", "c1", "d1")
    two = planes(t).toDF("polygon_id", "a2", "b2", "c2", "d2").withColumn("polygon_id", F.col("polygon_id") - 1)
    return one.join(two, "polygon_id")


@query("plane_plane_line", f"""
WITH {PAIRS_SQL},
k AS (SELECT *, b1*c2 - c1*b2 AS ux, c1*a2 - a1*c2 AS uy, a1*b2 - b1*a2 AS uz FROM pairs),
m AS (SELECT *, ux*ux + uy*uy + uz*uz AS det FROM k)
SELECT polygon_id, det >= 1e-8 AS crosses, {rxyz('d', 'ux', 'uy', 'uz')},
  CASE WHEN det >= 1e-8 THEN {r('(-d1*(b2*uz - c2*uy) - d2*(uy*c1 - uz*b1)) / det', 4)} END AS x,
  CASE WHEN det >= 1e-8 THEN {r('(-d1*(c2*ux - a2*uz) - d2*(uz*a1 - ux*c1)) / det', 4)} END AS y,
  CASE WHEN det >= 1e-8 THEN {r('(-d1*(a2*uy - b2*ux) - d2*(ux*b1 - uy*a1)) / det', 4)} END AS z FROM m""")
def _(t):
    point, d, ok = V.plane_plane_line(V.plane(suffix="1"), V.plane(suffix="2"))
    return plane_pairs(t).select("polygon_id", ok.alias("crosses"), *xyz(d, "d"),
                                 *(r6(c, 4).alias(n) for c, n in zip(point, "xyz")))


@query("line_plane_point", f"""
WITH {ON_PLANES}, q AS (SELECT *, -{DIST} / (0.5*a + 0.25*b + 2*c + 1e-8) AS t FROM v)
SELECT vertex_id, {rxyz('', 'x + 0.5*t', 'y + 0.25*t', 'z + 2*t')} FROM q""")
def _(t):
    hit = V.line_plane_point(V.vec(), V.vec() + V.const(0.5, 0.25, 2), V.plane())
    return on_planes(t).select("vertex_id", *xyz(hit))


@query("constrain_vertices", f"""
WITH e AS (SELECT v.vertex_id, v.x, v.y, v.z, v.vertex_id % 4 AS n, p.a, p.b, p.c, p.d FROM fx_vertices v LEFT JOIN fx_planes p ON p.polygon_id = v.vertex_id % (SELECT count(*) FROM fx_planes)),
g AS (SELECT *, a*x + b*y + c*z + d AS h, CAST(-(v.x * 0 + 1) AS DOUBLE) AS qd FROM e v),
o AS (SELECT *, CASE n WHEN 0 THEN x WHEN 1 THEN x - h*a ELSE 1 END AS px,
  CASE WHEN n = 0 THEN y WHEN n = 1 THEN y - h*b WHEN n = 2 THEN y - b*(a*(1-x) + h)/(b*b + c*c) ELSE 2 END AS py,
  CASE WHEN n = 0 THEN z WHEN n = 1 THEN z - h*c WHEN n = 2 THEN z - c*(a*(1-x) + h)/(b*b + c*c) ELSE -(a + 2*b + d)/c END AS pz FROM g)
SELECT vertex_id, CAST(n AS INT) AS n_planes, {rxyz('p', 'px', 'py', 'pz')}, {r('sqrt((px-x)*(px-x)+(py-y)*(py-y)+(pz-z)*(pz-z))')} AS displacement FROM o""")
def _(t):
    # planes -1 and -2 are x = 1 and y = 2; a vertex has vertex_id % 4 of (own plane, -1, -2)
    axis = t.ceilings.limit(1).selectExpr(
        "inline(array(struct(-1L AS polygon_id, 1D AS a, 0D AS b, 0D AS c, -1D AS d), struct(-2L AS polygon_id, 0D AS a, 1D AS b, 0D AS c, -2D AS d)))")
    all_planes = planes(t).unionByName(axis).withColumnRenamed("polygon_id", "plane_id").withColumn("scene_id", F.lit(0))
    v = t.vertices.withColumn("scene_id", F.lit(0)).select("scene_id", "vertex_id", "x", "y", "z")
    links = pointing(t, v).selectExpr("scene_id", "vertex_id", "posexplode(slice(array(polygon_id, -1L, -2L), 1, CAST(vertex_id % 4 AS INT))) AS (rank, plane_id)")
    return mesh.constrain_vertices(v, links, all_planes).select(
        "vertex_id", "n_planes", *xyz(V.vec("p"), "p"), r6(F.col("displacement")).alias("displacement"))


@query("point_segment_distance", f"""
WITH s AS (SELECT v.*, r.x0, r.y0, r.x1, r.y1 FROM fx_vertices v JOIN fx_rooms r ON r.room_key = v.vertex_id % 25),
q AS (SELECT *, greatest(0, least(1, ((x-x0)*(x1-x0) + (y-y0)*(y1-y0) + z*2) / ((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + 4))) AS t FROM s)
SELECT vertex_id, {r('(x-x0-t*(x1-x0))*(x-x0-t*(x1-x0)) + (y-y0-t*(y1-y0))*(y-y0-t*(y1-y0)) + (z-2*t)*(z-2*t)')} AS dist2 FROM q""")
def _(t):
    j = t.vertices.withColumn("room_key", (F.col("vertex_id") % 25).cast("int")).join(t.rooms, "room_key")
    a = V.Vec(F.col("x0"), F.col("y0"), F.lit(0.0))
    b = V.Vec(F.col("x1"), F.col("y1"), F.lit(2.0))
    return j.select("vertex_id", r6(V.segment_distance2(V.vec(), a, b)).alias("dist2"))


@query("point_ring_distance", f"""
WITH s AS (SELECT v.vertex_id, v.x, v.y, r.x0, r.y0, r.x1, r.y1 FROM fx_vertices v JOIN fx_rooms r ON r.room_key = v.vertex_id % 25),
d AS (SELECT *, greatest(x0 - x, 0, x - x1) AS ox, greatest(y0 - y, 0, y - y1) AS oy FROM s)
SELECT vertex_id, {r('CASE WHEN ox > 0 OR oy > 0 THEN ox*ox + oy*oy ELSE pow(least(x - x0, x1 - x, y - y0, y1 - y), 2) END')} AS dist2 FROM d""")
def _(t):
    from atrium.operators.polygons import ring_distance2

    rings = t.rooms.selectExpr("room_key", "array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y0 AS y), struct(x1 AS x, y1 AS y), struct(x0 AS x, y1 AS y)) AS ring")
    points = t.vertices.select("vertex_id", "x", "y", (F.col("vertex_id") % 25).cast("int").alias("room_key"))
    return ring_distance2(points, rings, ["vertex_id"], ["room_key"]).select("vertex_id", r6(F.col("dist2")).alias("dist2"))


def vertex_on_triangle(t) -> DataFrame:
    """Vertices paired with the corners of the triangle their id selects."""
    tri = mesh.corners(t.triangles, t.mesh_vertices).drop("scene_id")
    return t.vertices.withColumn("triangle_id", F.col("vertex_id") * 2 + F.col("vertex_id") % 2).join(tri, "triangle_id")


SEG2 = """((px-{a}x-{t}*({b}x-{a}x))*(px-{a}x-{t}*({b}x-{a}x)) + (py-{a}y-{t}*({b}y-{a}y))*(py-{a}y-{t}*({b}y-{a}y)) + (pz-{a}z-{t}*({b}z-{a}z))*(pz-{a}z-{t}*({b}z-{a}z)))"""
SEGT = """greatest(0, least(1, ((px-{a}x)*({b}x-{a}x) + (py-{a}y)*({b}y-{a}y) + (pz-{a}z)*({b}z-{a}z)) / (({b}x-{a}x)*({b}x-{a}x) + ({b}y-{a}y)*({b}y-{a}y) + ({b}z-{a}z)*({b}z-{a}z))))"""
ON_TRI = f"""q0 AS (SELECT v.vertex_id, v.x AS px, v.y AS py, v.z AS pz, t.* FROM fx_vertices v JOIN fx_normals t ON t.triangle_id = v.vertex_id * 2 + v.vertex_id % 2),
q AS (SELECT *, {SEGT.format(a='a', b='b')} AS t0, {SEGT.format(a='b', b='c')} AS t1, {SEGT.format(a='c', b='a')} AS t2 FROM q0),
e AS (SELECT *, {SEG2.format(a='a', b='b', t='t0')} AS s0, {SEG2.format(a='b', b='c', t='t1')} AS s1, {SEG2.format(a='c', b='a', t='t2')} AS s2 FROM q)"""


@query("triangle_edge_distances", f"WITH {ON_TRI} SELECT vertex_id, {r('s0')} AS s0, {r('s1')} AS s1, {r('s2')} AS s2 FROM e")
def _(t):
    p, (a, b, c) = V.vec(), mesh.corner_vectors()
    return vertex_on_triangle(t).select("vertex_id", *(
        r6(V.segment_distance2(p, u, w)).alias(f"s{i}") for i, (u, w) in enumerate(((a, b), (b, c), (c, a)))))


@query("point_triangle_closest", f"""
WITH {ON_TRI},
f AS (SELECT *, nx*nx + ny*ny + nz*nz AS n2, (px-ax)*nx + (py-ay)*ny + (pz-az)*nz AS h,
  ((py-ay)*(cz-az)-(pz-az)*(cy-ay))*nx + ((pz-az)*(cx-ax)-(px-ax)*(cz-az))*ny + ((px-ax)*(cy-ay)-(py-ay)*(cx-ax))*nz AS v,
  ((by-ay)*(pz-az)-(bz-az)*(py-ay))*nx + ((bz-az)*(px-ax)-(bx-ax)*(pz-az))*ny + ((bx-ax)*(py-ay)-(by-ay)*(px-ax))*nz AS w FROM e)
SELECT vertex_id, {r('sqrt(CASE WHEN v >= 0 AND w >= 0 AND v + w <= n2 THEN h*h/n2 ELSE least(s0, s1, s2) END)')} AS dist FROM f""")
def _(t):
    p, (a, b, c) = V.vec(), mesh.corner_vectors()
    placed = V.with_triangle_closest(vertex_on_triangle(t), p, a, b, c)
    return placed.select("vertex_id", r6((p - V.vec("q")).norm()).alias("dist"))


@query("plane_z", f"SELECT v.vertex_id, {r('-(a*x + b*y + d)/c')} AS z FROM fx_vertices v JOIN fx_planes p ON p.polygon_id = v.vertex_id % (SELECT count(*) FROM fx_planes)")
def _(t):
    return on_planes(t).select("vertex_id", r6(V.plane_z(V.plane(), F.col("x"), F.col("y"))).alias("z"))


@query("unit_plane", f"""
SELECT polygon_id, {', '.join(f"{r(f'{k} / l')} AS {k}" for k in 'abcd')} FROM (
  SELECT polygon_id, a*f AS a, b*f AS b, c*f AS c, d, sqrt(a*a*f*f + b*b*f*f + c*c*f*f) AS l FROM (SELECT *, polygon_id % 7 AS f FROM fx_ceilings)) WHERE l > 1e-12""")
def _(t):
    scaled = t.ceilings.withColumn("f", F.col("polygon_id") % 7).select("polygon_id", *((F.col(k) * F.col("f")).alias(k) for k in "abc"), "d")
    return unit_planes(scaled).select("polygon_id", *(r6(F.col(k)).alias(k) for k in "abcd"))


def unit_planes(df: DataFrame) -> DataFrame:
    """Normalise plane columns a..d and drop planes without a direction."""
    return df.withColumn("_l", V.plane().n.norm()).filter("_l > 1e-12").withColumns(
        {k: F.col(k) / F.nullif("_l", F.lit(0.0)) for k in "abcd"}).drop("_l")


@query("rigid_transform", f"SELECT vertex_id, {rxyz('', '(y/2 - 20)', '-(x/2 - 10)', '(z/2 - 3)')} FROM fx_mesh_vertices")
def _(t):
    from atrium.operators.transforms import undo_transform

    matrix = [[0, -1, 0, 10], [1, 0, 0, 20], [0, 0, 1, 3], [0, 0, 0, 1]]
    return undo_transform(t.mesh_vertices, matrix, scale=2.0).select("vertex_id", *xyz(V.vec()))


@query("triangle_area_normal", f"""
WITH k AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM fx_normals)
SELECT triangle_id, {r('0.5*l')} AS area, {rxyz('n', 'nx/greatest(l,1e-14)', 'ny/greatest(l,1e-14)', 'nz/greatest(l,1e-14)')} FROM k""")
def _(t):
    d = mesh.with_area_normal(mesh.corners(t.triangles, t.mesh_vertices))
    return d.select("triangle_id", r6(F.col("area")).alias("area"), *xyz(V.vec("n"), "n"))


@query("flip_misaligned", """
SELECT t.triangle_id, v0, CASE WHEN nx*p.a + ny*p.b + nz*p.c*s < 0 THEN v2 ELSE v1 END AS v1,
  CASE WHEN nx*p.a + ny*p.b + nz*p.c*s < 0 THEN v1 ELSE v2 END AS v2, nx*p.a + ny*p.b + nz*p.c*s < 0 AS flipped
FROM fx_normals t JOIN (SELECT *, CASE WHEN polygon_id % 2 = 0 THEN 1 ELSE -1 END AS s FROM fx_planes) p ON p.polygon_id = t.polygon_id""")
def _(t):
    pl = planes(t).withColumn("c", F.when(F.col("polygon_id") % 2 == 0, F.col("c")).otherwise(-F.col("c"))).withColumn("scene_id", F.lit(0).cast("bigint"))
    out = mesh.flip_misaligned(mesh.corners(t.triangles, t.mesh_vertices), pl)
    return out.select("triangle_id", "v0", "v1", "v2", "flipped")


@query("angle_to_axis", f"""
WITH {PAIRS_SQL}
SELECT polygon_id, {r('degrees(acos(greatest(-1.0, least(1.0, c1))))', 4)} AS to_up,
  {r('abs(90 - degrees(acos(greatest(-1.0, least(1.0, a1*a2 + b1*b2 + c1*c2)))))', 4)} AS to_orthogonal FROM pairs""")
def _(t):
    p, q = V.plane(suffix="1"), V.plane(suffix="2")
    return plane_pairs(t).select("polygon_id", r6(V.angle_degrees(p.n, V.const(0, 0, 1)), 4).alias("to_up"),
                                 r6(F.abs(90 - V.angle_degrees(p.n, q.n)), 4).alias("to_orthogonal"))


# ---- grid and keys -------------------------------------------------------------------------------


@query("grid_pixel", """
SELECT vertex_id, CAST(floor((x + 0.5) / CAST(0.05 AS DOUBLE)) AS BIGINT) AS grid_col, CAST(floor((y + 0.5) / CAST(0.05 AS DOUBLE)) AS BIGINT) AS grid_row FROM fx_vertices""")
def _(t):
    col, row = grids.pixel_of(F.col("x"), F.col("y"), -0.5, -0.5, 0.05)
    return t.vertices.select("vertex_id", col.alias("grid_col"), row.alias("grid_row"))


@query("grid_center", f"SELECT level_id, r, c, {r('(c + 0.5) * CAST(0.05 AS DOUBLE) - 0.5')} AS x, {r('(r + 0.5) * CAST(0.05 AS DOUBLE) - 0.5')} AS y FROM fx_cells")
def _(t):
    x, y = grids.center_of(F.col("c"), F.col("r"), -0.5, -0.5, 0.05)
    return t.cells.select("level_id", "r", "c", r6(x).alias("x"), r6(y).alias("y"))


@query("build_grid", f"""
WITH g AS (SELECT level_key, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM fx_rooms GROUP BY 1)
SELECT level_key, {r('x0 - 10 * CAST(0.05 AS DOUBLE)')} AS origin_x, {r('y0 - 10 * CAST(0.05 AS DOUBLE)')} AS origin_y,
  CAST(ceil((y1 - y0 + 20 * CAST(0.05 AS DOUBLE)) / CAST(0.05 AS DOUBLE)) + 1 AS BIGINT) AS n_rows,
  CAST(ceil((x1 - x0 + 20 * CAST(0.05 AS DOUBLE)) / CAST(0.05 AS DOUBLE)) + 1 AS BIGINT) AS n_cols FROM g""")
def _(t):
    out = grids.build_grid(t.rooms, ["level_key"], "x0", "y0", "x1", "y1")
    return out.select("level_key", r6(F.col("origin_x")).alias("origin_x"), r6(F.col("origin_y")).alias("origin_y"), "n_rows", "n_cols")


@query("edge_key", """
WITH p AS (SELECT room_key, CAST(round_even(x1 / 3 * 1e6, 0) AS BIGINT) AS xa, CAST(round_even(y0 * 1e6, 0) AS BIGINT) AS ya,
  CAST(round_even(x0 / 7 * 1e6, 0) AS BIGINT) AS xb, CAST(round_even(y1 * 1e6, 0) AS BIGINT) AS yb FROM fx_rooms)
SELECT room_key, CASE WHEN (xa, ya) <= (xb, yb) THEN xa ELSE xb END AS kx0, CASE WHEN (xa, ya) <= (xb, yb) THEN ya ELSE yb END AS ky0,
  CASE WHEN (xa, ya) <= (xb, yb) THEN xb ELSE xa END AS kx1, CASE WHEN (xa, ya) <= (xb, yb) THEN yb ELSE ya END AS ky1 FROM p""")
def _(t):
    key = grids.edge_key(F.col("x1") / 3, F.col("y0"), F.col("x0") / 7, F.col("y1"))
    return t.rooms.select("room_key", key.alias("k")).select(
        "room_key", *(F.col("k")[i][c].alias(f"k{c}{i}") for i in (0, 1) for c in "xy"))


@query("segment_midpoint", f"SELECT room_key, {r('(x0 + x1) / 2')} AS x, {r('(y0 + y1) / 2')} AS y FROM fx_rooms")
def _(t):
    return t.rooms.select("room_key", r6((F.col("x0") + F.col("x1")) / 2).alias("x"), r6((F.col("y0") + F.col("y1")) / 2).alias("y"))


@query("triangle_centroid", f"SELECT triangle_id, {rxyz('', '(ax+bx+cx)/3', '(ay+by+cy)/3', '(az+bz+cz)/3')} FROM fx_corners")
def _(t):
    a, b, c = mesh.corner_vectors()
    return mesh.corners(t.triangles, t.mesh_vertices).select("triangle_id", *xyz((a + b + c).over(F.lit(3))))


def hsv_sql(id_expr: str, s: float, v: float) -> str:
    return f"""h AS (SELECT id, ({id_expr}) * CAST(0.6180339887498949 AS DOUBLE) - floor(({id_expr}) * CAST(0.6180339887498949 AS DOUBLE)) AS h FROM ids),
k AS (SELECT id, CAST(floor(h * 6) AS INT) AS i, h * 6 - floor(h * 6) AS f FROM h),
m AS (SELECT id, i, CAST({v} AS DOUBLE) AS v, CAST({v} AS DOUBLE) * (1 - CAST({s} AS DOUBLE)) AS p, CAST({v} AS DOUBLE) * (1 - CAST({s} AS DOUBLE) * f) AS q,
  CAST({v} AS DOUBLE) * (1 - CAST({s} AS DOUBLE) * (1 - f)) AS t FROM k),
rgb AS (SELECT id, CAST(round_even(255 * CASE i WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END, 0) AS INT) AS red,
  CAST(round_even(255 * CASE i WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END, 0) AS INT) AS green,
  CAST(round_even(255 * CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END, 0) AS INT) AS blue FROM m)"""


@query("id_color", f"""
WITH ids AS (SELECT p_partkey AS id FROM part), {hsv_sql('id + 1', 0.62, 0.95)}
SELECT id, red, green, blue, CAST(((id + 1) * 2654435761) & 16777215 AS BIGINT) AS hashed,
  CAST(round_even(179 * (id * CAST(0.6180339887498949 AS DOUBLE) - floor(id * CAST(0.6180339887498949 AS DOUBLE))), 0) AS INT) AS room_hue FROM rgb""")
def _(t):
    ids = t.raw("part").select(F.col("p_partkey").alias("id"))
    red, green, blue = colors.candidate_color(F.col("id"))
    return ids.select("id", red.alias("red"), green.alias("green"), blue.alias("blue"),
                      colors.hashed_color(F.col("id")).alias("hashed"), colors.room_hue(F.col("id")).alias("room_hue"))


@query("plane_color", f"WITH ids AS (SELECT p_partkey AS id FROM part), {hsv_sql('id', 0.72, 0.95)} SELECT id, red, green, blue FROM rgb")
def _(t):
    ids = t.raw("part").select(F.col("p_partkey").alias("id"))
    return ids.select("id", *(c.alias(n) for c, n in zip(colors.plane_color(F.col("id")), ("red", "green", "blue"))))


@query("color_instance_codec", """
SELECT id, CAST(id % 256 AS INT) AS red, CAST((id // 256) % 256 AS INT) AS green, CAST((id // 65536) % 256 AS INT) AS blue, id AS back
FROM (SELECT p_partkey * 7919 % 16777216 AS id FROM part)""")
def _(t):
    ids = t.raw("part").select((F.col("p_partkey") * 7919 % 16777216).alias("id"))
    coded = ids.select("id", *(c.alias(n) for c, n in zip(colors.color_of_instance(F.col("id")), ("red", "green", "blue"))))
    return coded.withColumn("back", colors.instance_of_color(F.col("red"), F.col("green"), F.col("blue")))


# ---- first slice: samples to labelled world points per frame ---------------------------------------


@query("frame_label_points", f"""
WITH p AS (SELECT s.scene_id, s.frame_id, m.layout_id, depth, depth > 0 AS valid, f.tz - depth AS z FROM fx_samples s
  JOIN fx_frames f USING (scene_id, frame_id) JOIN label_map m ON m.coco_id = s.coco_id)
SELECT scene_id, frame_id, layout_id, count(*) AS n_samples, count(*) FILTER (valid) AS n_valid, {r('avg(z) FILTER (valid)')} AS mean_z FROM p GROUP BY ALL""")
def _(t):
    rays = cameras.backproject_samples(t.samples, t.frames, FX, FY, CX, CY)
    return rays.withColumn("layout_id", L.layout_id(F.col("coco_id"))).groupBy("scene_id", "frame_id", "layout_id").agg(
        F.count("*").alias("n_samples"), F.count_if("valid").alias("n_valid"),
        r6(F.avg(F.when(F.col("valid"), F.col("z")))).alias("mean_z"))
