"""Registered queries: floorplan rasters, openings, components and rooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions.vectors import r6
from atrium.operators import polygons, raster
from atrium.plans.registry import query, r

LV = ["level_id"]


def room_edges(t, source=None):
    rings = (source or t.rooms).selectExpr("room_key", "array(struct(x0 AS x, y0 AS y), struct(x1 AS x, y0 + 1 AS y), struct(x1 + 1 AS x, y1 AS y), struct(x0 AS x, y1 AS y)) AS ring")
    return polygons.ring_edges(rings, ["room_key"])


QUAD = """room_e AS (SELECT room_key, unnest([[x0,y0,x1,y0+1],[x1,y0+1,x1+1,y1],[x1+1,y1,x0,y1],[x0,y1,x0,y0]]) AS e FROM fx_rooms),
gridc AS (SELECT room_key, c, r, (c + 0.5) * 0.25::DOUBLE AS cx0, (r + 0.5) * 0.25::DOUBLE AS cy0 FROM fx_rooms, range(0, 100) a(c), range(0, 100) b(r)),
hitc AS (SELECT g.room_key, g.r, g.c FROM gridc g JOIN room_e USING (room_key) WHERE (e[2] > cy0) <> (e[4] > cy0) AND cx0 < (e[3]-e[1])*(cy0-e[2])/(e[4]-e[2]) + e[1] GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query("rasterize_polygons", f"WITH {QUAD} SELECT room_key, r, c FROM hitc")
def _(t):
    return raster.rasterize_polygons(room_edges(t), ["room_key"], 0.25).select("room_key", "r", "c")


@query("footprint_union", f"WITH {QUAD} SELECT r.level_key, count(DISTINCT (h.r, c)) AS n_cells, {r('count(DISTINCT (h.r, c)) * 0.0625::DOUBLE')} AS area FROM hitc h JOIN fx_rooms r ON r.room_key = h.room_key GROUP BY 1")
def _(t):
    cells = raster.rasterize_polygons(room_edges(t), ["room_key"], 0.25).join(t.rooms.select("room_key", "level_key"), "room_key")
    return raster.covered_area(cells, ["level_key"], 0.25).withColumn("area", r6(F.col("area")))


@query("triangles_union", f"""
WITH te AS (SELECT triangle_id, polygon_id, ax, ay, bx, by, cx, cy FROM fx_corners),
k AS (SELECT t.*, c, r, (c + 0.5) * 0.03::DOUBLE AS px, (r + 0.5) * 0.03::DOUBLE AS py FROM te t,
  LATERAL (SELECT unnest(range(CAST(floor(least(ax,bx,cx)/0.03) AS BIGINT) - 1, CAST(ceil(greatest(ax,bx,cx)/0.03) AS BIGINT) + 1)) AS c) x,
  LATERAL (SELECT unnest(range(CAST(floor(least(ay,by,cy)/0.03) AS BIGINT) - 1, CAST(ceil(greatest(ay,by,cy)/0.03) AS BIGINT) + 1)) AS r) y),
i AS (SELECT DISTINCT polygon_id, r, c FROM k WHERE
  CAST((ay > py) <> (by > py) AND px < (bx-ax)*(py-ay)/(by-ay) + ax AS INT) + CAST((by > py) <> (cy > py) AND px < (cx-bx)*(py-by)/(cy-by) + bx AS INT)
  + CAST((cy > py) <> (ay > py) AND px < (ax-cx)*(py-cy)/(ay-cy) + cx AS INT) = 1)
SELECT polygon_id, abs(count(*) - 0) >= 11 AS large FROM i GROUP BY 1 HAVING count(*) * 0.0009 >= 0.01""")
def _(t):
    from atrium.operators import mesh

    cornered = mesh.corners(t.triangles, t.mesh_vertices)
    e = lambda p, q: F.struct(F.col(f"{p}x").alias("x0"), F.col(f"{p}y").alias("y0"), F.col(f"{q}x").alias("x1"), F.col(f"{q}y").alias("y1"))
    edges = cornered.select("polygon_id", "triangle_id", F.inline(F.array(e("a", "b"), e("b", "c"), e("c", "a"))))
    cells = raster.rasterize_polygons(edges, ["polygon_id", "triangle_id"], 0.03)
    out = raster.covered_area(cells, ["polygon_id"], 0.03, 0.01)
    return out.select("polygon_id", (F.col("n_cells") >= 11).alias("large"))


def wall_segments(t):
    return t.rooms.selectExpr("level_key AS level_id", "inline(array(struct(x0 AS x0, y0 AS y0, x1 AS x1, y0 AS y1), struct(x0 AS x0, y0 AS y0, x0 AS x1, y1 AS y1), struct(x0 AS x0, y0 AS y0, x1 AS x1, y1 AS y1)))")


SEG = """seg AS (SELECT level_key AS level_id, unnest([[x0,y0,x1,y0],[x0,y0,x0,y1],[x0,y0,x1,y1]]) AS s FROM fx_rooms),
gc AS (SELECT level_id, s, c, r, (c + 0.5) * 0.1::DOUBLE AS px, (r + 0.5) * 0.1::DOUBLE AS py FROM seg, range(-2, 205) a(c), range(-2, 205) b(r)
  WHERE (c + 0.5) * 0.1 BETWEEN s[1] - 0.2 AND s[3] + 0.2 AND (r + 0.5) * 0.1 BETWEEN s[2] - 0.2 AND s[4] + 0.2),
gt AS (SELECT *, greatest(0, least(1, ((px-s[1])*(s[3]-s[1]) + (py-s[2])*(s[4]-s[2])) / ((s[3]-s[1])*(s[3]-s[1]) + (s[4]-s[2])*(s[4]-s[2])))) AS t FROM gc),
dr AS (SELECT DISTINCT level_id, r, c FROM gt WHERE (px-s[1]-t*(s[3]-s[1]))*(px-s[1]-t*(s[3]-s[1])) + (py-s[2]-t*(s[4]-s[2]))*(py-s[2]-t*(s[4]-s[2])) <= 0.0036::DOUBLE + 1e-12)"""


@query("draw_segments", f"WITH {SEG} SELECT level_id, r, c FROM dr")
def _(t):
    return raster.draw_segments(wall_segments(t), LV, 0.06, 0.1).select("level_id", "r", "c")


@query("rasterize_walls", f"""
WITH {SEG.replace("0.0036", "0.0025")}, fl AS (SELECT level_key AS level_id, r, c FROM fx_rooms, range(0, 205) a(c), range(0, 205) b(r)
  WHERE (c + 0.5) * 0.1 > x0 + 1.02 AND (c + 0.5) * 0.1 < x0 + 1.52 AND (r + 0.5) * 0.1 > y0 + 2.02 AND (r + 0.5) * 0.1 < y0 + 2.62),
dw AS (SELECT level_id, r, c FROM dr UNION SELECT level_id, r, c FROM fl),
kk AS (SELECT d, exp(-d*d/2.0::DOUBLE) / (1 + 2*exp(-0.5::DOUBLE) + 2*exp(-2.0::DOUBLE)) AS k FROM range(-2, 3) t(d)),
bl AS (SELECT level_id, r + a.d AS r, c + b.d AS c, sum(a.k * b.k) AS v FROM dw, kk a, kk b GROUP BY ALL),
th AS (SELECT level_id, r, c FROM (SELECT *, max(v) OVER (PARTITION BY level_id) AS peak FROM bl) WHERE v > 0.25 * peak + 1e-12),
cr(y, x) AS (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)),
gr AS (SELECT DISTINCT level_id, r + y AS r, c + x AS c FROM th, cr)
SELECT level_id, r + y AS r, c + x AS c FROM gr, cr GROUP BY ALL HAVING count(*) = 5""")
def _(t):
    solid = t.rooms.selectExpr("level_key AS level_id", "room_key AS polygon_id", "array(struct(x0 + 1.02D AS x, y0 + 2.02D AS y), struct(x0 + 1.52D AS x, y0 + 2.02D AS y), "
                               "struct(x0 + 1.52D AS x, y0 + 2.62D AS y), struct(x0 + 1.02D AS x, y0 + 2.62D AS y)) AS ring")
    return raster.rasterize_walls(wall_segments(t), polygons.ring_edges(solid, ["level_id", "polygon_id"]), LV, resolution=0.1).select("level_id", "r", "c")


@query("cell_difference", """
SELECT a.level_id, count(*) FILTER (w.r IS NULL) AS free, count(*) FILTER (w.r IS NOT NULL) AS walls FROM fx_cells a
LEFT JOIN (SELECT * FROM fx_cells WHERE c % 3 = 0) w ON w.level_id = a.level_id AND w.r = a.r AND w.c = a.c GROUP BY 1""")
def _(t):
    support = t.cells.select("level_id", "r", "c")
    free, walls = raster.cell_difference(support, support.filter("c % 3 = 0"))
    n = free.groupBy("level_id").agg(F.count("*").alias("free"))
    return n.join(walls.groupBy("level_id").agg(F.count("*").alias("walls")), "level_id")


NB = """nbp AS (SELECT a.level_id, least(a.label, b.label) AS label_a, greatest(a.label, b.label) AS label_b, (a.r + b.r) / CAST(2 AS DOUBLE) AS mr, (a.c + b.c) / CAST(2 AS DOUBLE) AS mc
  FROM fx_cells a JOIN fx_cells b ON a.level_id = b.level_id AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c))
  WHERE a.label > 0 AND b.label > 0 AND a.label <> b.label)"""


@query("grid_neighbors", f"WITH {NB} SELECT * FROM nbp")
def _(t):
    return raster.grid_neighbors(t.cells).select("level_id", "label_a", "label_b", "mr", "mc")


@query("opening_edges", f"""
WITH {NB}, op AS (SELECT level_id, label_a, label_b, (mc + 0.5) * 0.1::DOUBLE AS x, (mr + 0.5) * 0.1::DOUBLE AS y FROM nbp),
mo AS (SELECT level_id, label_a, label_b, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy FROM op GROUP BY ALL),
ax AS (SELECT *, cos(0.5 * atan2(2 * cxy, vx - vy)) AS ux, sin(0.5 * atan2(2 * cxy, vx - vy)) AS uy, row_number() OVER (PARTITION BY level_id ORDER BY label_a, label_b) - 1 AS k FROM mo),
pj AS (SELECT a.level_id, a.label_a, a.label_b, any_value(k) AS k, any_value(n) AS n, greatest(max((x-mx)*ux + (y-my)*uy) - min((x-mx)*ux + (y-my)*uy), 0.1::DOUBLE) AS w
  FROM op JOIN ax a ON a.level_id = op.level_id AND a.label_a = op.label_a AND a.label_b = op.label_b GROUP BY ALL)
SELECT level_id, label_a, label_b, 'opening_' || lpad(CAST(k AS VARCHAR), 3, '0') AS edge_id, CASE WHEN w < 1.5 THEN 'door' ELSE 'opening' END AS kind, {r('w')} AS width_meters, n AS boundary_sample_count FROM pj""")
def _(t):
    out = raster.opening_edges(t.cells, resolution=0.1)
    return out.select("level_id", "label_a", "label_b", "edge_id", "kind", r6(F.col("width_meters")).alias("width_meters"), "boundary_sample_count")


@query("distance_transform", f"""
WITH nbc AS (SELECT DISTINCT level_id, r + i AS r, c + j AS c FROM fx_cells, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
bg AS (SELECT level_id, r, c FROM fx_cells WHERE NOT free UNION ALL SELECT n.level_id, n.r, n.c FROM nbc n ANTI JOIN fx_cells f ON f.level_id = n.level_id AND f.r = n.r AND f.c = n.c)
SELECT a.level_id, a.r, a.c, {r('sqrt(min((a.r-b.r)*(a.r-b.r) + (a.c-b.c)*(a.c-b.c))) * 0.05::DOUBLE')} AS distance FROM fx_cells a JOIN bg b ON a.level_id = b.level_id AND a.free GROUP BY ALL""")
def _(t):
    return raster.distance_transform(t.cells).select("level_id", "r", "c", r6(F.col("distance")).alias("distance"))


RUNS = """ri AS (SELECT level_id, r, c, label, c - row_number() OVER (PARTITION BY level_id, r, label ORDER BY c) AS i FROM fx_cells WHERE label > 0),
runs AS (SELECT level_id, r, label, CAST(min(c) AS INT) AS c0, CAST(max(c) AS INT) AS c1 FROM ri GROUP BY level_id, r, label, i)"""


@query("cell_runs", f"WITH {RUNS} SELECT * FROM runs")
def _(t):
    return raster.cell_runs(t.cells)


@query("run_triangles", f"""
WITH {RUNS} SELECT level_id, label, {r('sum(c1 - c0 + 1) * 0.0025::DOUBLE')} AS area, CAST(sum((SELECT count(DISTINCT k) + 1 FROM (SELECT unnest([c0, c1 + 1]) AS k FROM runs q WHERE q.level_id = u.level_id AND q.label = u.label) WHERE k > u.c0 AND k < u.c1 + 1) * 2) AS BIGINT) AS n_triangles
FROM runs u GROUP BY level_id, label""")
def _(t):
    tri = raster.run_triangles(raster.cell_runs(t.cells))
    area = F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))) / 2
    return tri.groupBy("level_id", "label").agg(r6(F.sum(area)).alias("area"), F.count("*").alias("n_triangles"))


@query("grid_components", """
WITH f AS (SELECT level_id, r, c, CAST(r AS BIGINT) * 4294967296 + c AS id FROM fx_cells WHERE free),
nb AS (SELECT a.level_id, a.id AS v, b.id AS n FROM f a JOIN f b ON a.level_id = b.level_id AND ((a.r = b.r AND abs(a.c - b.c) = 1) OR (a.c = b.c AND abs(a.r - b.r) = 1))),
cc(v, component) USING KEY (v) AS (SELECT id, id FROM f UNION
  SELECT nb.n, min(c.component) FROM cc c JOIN nb ON nb.v = c.v JOIN recurring.cc o ON o.v = nb.n WHERE c.component < o.component GROUP BY nb.n)
SELECT f.level_id, f.r, f.c, cc.component FROM f JOIN cc ON cc.v = f.id""")
def _(t):
    return raster.grid_components(t.cells.filter("free")).select("level_id", "r", "c", "component")


@query("floorplan_stats", "SELECT level_id, count(*) AS support, count(*) FILTER (free) AS free, count(*) FILTER (NOT free) AS walls, max(r) - min(r) + 1 AS n_rows, max(c) - min(c) + 1 AS n_cols FROM fx_cells GROUP BY 1")
def _(t):
    return raster.floorplan_stats(t.cells)


@query("room_stats", f"""
SELECT level_id, label, count(*) AS n_cells, {r('count(*) * 0.0025::DOUBLE')} AS area, {r('(avg(c) + 0.5) * 0.05::DOUBLE')} AS x, {r('(avg(r) + 0.5) * 0.05::DOUBLE')} AS y FROM fx_cells WHERE label > 0 GROUP BY ALL""")
def _(t):
    out = raster.room_stats(t.cells)
    return out.select("level_id", "label", "n_cells", *(r6(F.col(c)).alias(c) for c in ("area", "x", "y")))


@query("room_boundary", """
WITH b AS (SELECT level_id, label, r, c FROM fx_cells WHERE label > 0),
s AS (SELECT level_id, label, r::BIGINT * 16777216 + c AS e0, r::BIGINT * 16777216 + c + 1 AS e1 FROM b UNION ALL SELECT level_id, label, (r::BIGINT + 1) * 16777216 + c, (r::BIGINT + 1) * 16777216 + c + 1 FROM b
  UNION ALL SELECT level_id, label, r::BIGINT * 16777216 + c, (r::BIGINT + 1) * 16777216 + c FROM b UNION ALL SELECT level_id, label, r::BIGINT * 16777216 + c + 1, (r::BIGINT + 1) * 16777216 + c + 1 FROM b)
SELECT level_id, label, e0, e1 FROM s GROUP BY ALL HAVING count(*) = 1""")
def _(t):
    return raster.room_boundary(t.cells)


def distance_sql(resolution: float) -> str:
    """CTE ``dt``: free cells with id ``r * 2**32 + c`` and their distance to what is not free."""
    return f"""nbc AS (SELECT DISTINCT level_id, r + i AS r, c + j AS c FROM fx_cells, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
bg AS (SELECT level_id, r, c FROM fx_cells WHERE NOT free UNION ALL SELECT n.level_id, n.r, n.c FROM nbc n ANTI JOIN fx_cells f ON f.level_id = n.level_id AND f.r = n.r AND f.c = n.c),
dt AS MATERIALIZED (SELECT a.level_id, a.r, a.c, CAST(a.r AS BIGINT) * 4294967296 + a.c AS id, sqrt(CAST(min((a.r-b.r)*(a.r-b.r) + (a.c-b.c)*(a.c-b.c)) AS DOUBLE)) * {resolution}::DOUBLE AS h
  FROM fx_cells a JOIN bg b ON a.level_id = b.level_id AND a.free GROUP BY ALL),
nb AS MATERIALIZED (SELECT a.level_id, a.id AS a, b.id AS b, least(a.h, b.h) AS h FROM dt a JOIN dt b ON a.level_id = b.level_id AND ((a.r = b.r AND abs(a.c - b.c) = 1) OR (a.c = b.c AND abs(a.r - b.r) = 1)))"""


# the highest pass between what has a label and what has none gives the next cell its label
FLOOD = """pass AS MATERIALIZED (SELECT level_id, a, b, row_number() OVER (PARTITION BY level_id ORDER BY h DESC, least(a, b), greatest(a, b)) AS k FROM nb),
lab(level_id, id, label) USING KEY (level_id, id) AS (SELECT level_id, id, marker FROM marked WHERE marker > 0 UNION
  SELECT level_id, b, label FROM (SELECT e.level_id, e.b, l.label, row_number() OVER (PARTITION BY e.level_id ORDER BY e.k) AS n
    FROM pass e JOIN recurring.lab l ON l.level_id = e.level_id AND l.id = e.a ANTI JOIN recurring.lab x ON x.level_id = e.level_id AND x.id = e.b WHERE EXISTS (SELECT 1 FROM lab)) WHERE n = 1)"""


@query("watershed_flood", f"""
WITH {distance_sql(0.05)}, marked AS (SELECT level_id, id, CASE WHEN r % 9 = 4 AND c % 11 = 5 THEN CAST(r // 9 * 10 + c // 11 + 1 AS BIGINT) ELSE 0 END AS marker FROM dt),
{FLOOD} SELECT dt.level_id, dt.r, dt.c, coalesce(lab.label, 0) AS label FROM dt LEFT JOIN lab ON lab.level_id = dt.level_id AND lab.id = dt.id""")
def _(t):
    dist = raster.distance_transform(t.cells)
    seeds = t.cells.selectExpr("level_id", "r", "c", "CASE WHEN r % 9 = 4 AND c % 11 = 5 THEN r div 9 * 10 + c div 11 + 1 ELSE 0 END AS marker")
    return raster.watershed_flood(dist.join(seeds, ["level_id", "r", "c"])).select("level_id", "r", "c", "label")


def components_sql(name: str, least: float) -> str:
    """CTE ``name``: component of the cells at least this far from walls."""
    return f"""{name}_n AS MATERIALIZED (SELECT * FROM nb WHERE h >= {least}),
{name}(level_id, id, comp) USING KEY (level_id, id) AS (SELECT level_id, id, id FROM dt WHERE h >= {least} UNION
  SELECT n.level_id, n.b, min(c.comp) FROM {name} c JOIN {name}_n n ON n.level_id = c.level_id AND n.a = c.id
    JOIN recurring.{name} o ON o.level_id = n.level_id AND o.id = n.b WHERE c.comp < o.comp GROUP BY n.level_id, n.b)"""


@query("room_segmentation", f"""
WITH {distance_sql(0.5)}, {components_sql('wide', 1.25)}, {components_sql('narrow', 0.75)}, {components_sql('every', 0)},
w AS (SELECT level_id, comp, row_number() OVER (PARTITION BY level_id ORDER BY comp) AS marker FROM wide GROUP BY level_id, comp HAVING count(*) >= 2),
m1 AS (SELECT wide.level_id, id, marker FROM wide JOIN w ON w.level_id = wide.level_id AND w.comp = wide.comp),
st AS (SELECT n.level_id, n.comp, min(marker) AS lo, max(marker) AS hi FROM narrow n LEFT JOIN m1 ON m1.level_id = n.level_id AND m1.id = n.id GROUP BY ALL HAVING count(*) >= 2),
top AS (SELECT level_id, max(marker) AS base FROM m1 GROUP BY 1),
nw AS (SELECT st.level_id, comp, row_number() OVER (PARTITION BY st.level_id ORDER BY comp) + coalesce(base, 0) AS marker FROM st LEFT JOIN top ON top.level_id = st.level_id WHERE lo IS NULL
  UNION ALL SELECT level_id, comp, lo FROM st WHERE lo = hi),
m2 AS (SELECT n.level_id, id, marker FROM narrow n JOIN nw ON nw.level_id = n.level_id AND nw.comp = n.comp),
marked AS (SELECT * FROM m2 UNION ALL SELECT m1.* FROM m1 ANTI JOIN m2 ON m2.level_id = m1.level_id AND m2.id = m1.id), {FLOOD},
kept AS (SELECT level_id, label, row_number() OVER (PARTITION BY level_id ORDER BY label) AS room FROM lab GROUP BY level_id, label HAVING count(*) >= 4)
SELECT dt.level_id, dt.r, dt.c, CAST(CASE WHEN dt.level_id NOT IN (SELECT level_id FROM marked) THEN (SELECT count(DISTINCT o.comp) FROM every o WHERE o.level_id = dt.level_id AND o.comp <= every.comp)
  WHEN dt.level_id NOT IN (SELECT level_id FROM kept) THEN 1 ELSE coalesce(kept.room, 0) END AS BIGINT) AS label
FROM dt JOIN every ON every.level_id = dt.level_id AND every.id = dt.id LEFT JOIN lab ON lab.level_id = dt.level_id AND lab.id = dt.id
  LEFT JOIN kept ON kept.level_id = lab.level_id AND kept.label = lab.label""")
def _(t):
    out = raster.segment_rooms(t.cells, resolution=0.5, widths=(2.5, 1.5))
    return out.select("level_id", "r", "c", F.col("label").cast("bigint").alias("label"))
