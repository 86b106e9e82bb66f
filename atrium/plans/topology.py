"""Registered queries: mesh topology, components, loops and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from atrium.functions import vectors as V
from atrium.functions.vectors import r6
from atrium.operators import graphs, mesh
from atrium.plans.registry import query, r

SC = ["scene_id"]
PLANES_SQL = "vp AS (SELECT vertex_id, list_sort(list_distinct([vertex_id // 300, 100 + vertex_id % 50 // 13, 200 + vertex_id % 50 // 29])) AS planes FROM fx_mesh_vertices)"
USES_SQL = "us AS (SELECT e0, e1, count(*) AS uses FROM fx_edges GROUP BY ALL)"
CONTOUR_SQL = f"""{PLANES_SQL}, {USES_SQL},
ct AS (SELECT us.* FROM us JOIN vp a ON a.vertex_id = e0 JOIN vp b ON b.vertex_id = e1 WHERE uses = 1 OR len(list_intersect(a.planes, b.planes)) >= 2)"""


def plane_links(t):
    return t.mesh_vertices.selectExpr("scene_id", "vertex_id", "explode(array_distinct(array(vertex_id div 300, 100 + vertex_id % 50 div 13, 200 + vertex_id % 50 div 29))) AS plane_id")


def contours(t):
    return mesh.contour_edges(t.triangles, mesh.vertex_plane_sets(plane_links(t)))


@query("boundary_edges", "SELECT e0, e1 FROM fx_edges GROUP BY ALL HAVING count(*) = 1")
def _(t):
    return mesh.boundary_edges(t.triangles).select("e0", "e1")


@query("watertight_edges", "SELECT e0, e1 FROM fx_edges GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return mesh.watertight_edges(t.triangles).select("e0", "e1")


@query("contour_edges", f"WITH {CONTOUR_SQL} SELECT e0, e1, uses FROM ct")
def _(t):
    return contours(t).select("e0", "e1", "uses")


@query("inner_edges", f"WITH {CONTOUR_SQL} SELECT e0, e1 FROM us WHERE (e0, e1) NOT IN (SELECT (e0, e1) FROM ct)")
def _(t):
    return mesh.inner_edges(t.triangles, contours(t)).select("e0", "e1")


@query("inner_edge_mask", f"""
WITH {CONTOUR_SQL}, c2 AS (SELECT e0, e1 FROM ct)
SELECT triangle_id, NOT EXISTS (FROM c2 WHERE e0 = least(v0, v1) AND e1 = greatest(v0, v1)) AS inner_0,
  NOT EXISTS (FROM c2 WHERE e0 = least(v1, v2) AND e1 = greatest(v1, v2)) AS inner_1, NOT EXISTS (FROM c2 WHERE e0 = least(v2, v0) AND e1 = greatest(v2, v0)) AS inner_2 FROM fx_triangles""")
def _(t):
    return mesh.inner_edge_mask(t.triangles, contours(t)).select("triangle_id", "inner_0", "inner_1", "inner_2")


@query("mesh_adjacency", "SELECT e0 AS vertex_id, e1 AS neighbor_id FROM fx_edges UNION SELECT e1, e0 FROM fx_edges")
def _(t):
    return mesh.vertex_neighbors(t.triangles).select("vertex_id", "neighbor_id")


@query("triangle_adjacency", """
WITH p AS (SELECT e0, e1, min(triangle_id) AS lo, max(triangle_id) AS hi FROM fx_edges GROUP BY ALL HAVING count(*) = 2)
SELECT lo AS triangle_id, hi AS neighbor_id FROM p UNION SELECT hi, lo FROM p""")
def _(t):
    return mesh.triangle_neighbors(t.triangles).select("triangle_id", "neighbor_id")


@query("edge_wedges", """
WITH n AS (SELECT e0 AS v, e1 AS n FROM fx_edges UNION SELECT e1, e0 FROM fx_edges),
k AS (SELECT * FROM n)
SELECT a.v AS vertex_id, a.n AS n1, b.n AS n2 FROM k a JOIN k b ON a.v = b.v AND a.n < b.n""")
def _(t):
    return mesh.edge_wedges(mesh.vertex_neighbors(t.triangles)).select("vertex_id", "n1", "n2")


@query("dedupe_edges", "SELECT DISTINCT e0, e1 FROM fx_edges")
def _(t):
    return mesh.edge_rows(t.triangles).select("e0", "e1").distinct()


@query("convex_contour_vertices", """
WITH b AS (SELECT unnest([e0, e1]) AS v, e0, e1 FROM fx_edges GROUP BY e0, e1 HAVING count(*) = 1), bv AS (SELECT DISTINCT v FROM b),
n AS (SELECT e0 AS v, e1 AS n FROM fx_edges UNION SELECT e1, e0 FROM fx_edges)
SELECT DISTINCT bv.v AS vertex_id FROM bv JOIN n ON n.v = bv.v JOIN fx_mesh_vertices m ON m.vertex_id = n.n JOIN fx_planes p ON p.polygon_id = bv.v // 500
WHERE a*x + b*y + c*z + d + 1.8 < -0.0025::DOUBLE""")
def _(t):
    from atrium.operators.maintenance import convex_contour_vertices
    from atrium.plans.projections import planes

    ends = mesh.boundary_edges(t.triangles).select("scene_id", F.explode(F.array("e0", "e1")).alias("vertex_id")).distinct()
    contour = ends.withColumn("polygon_id", F.floor(F.col("vertex_id") / 500))
    pl = planes(t).withColumns({"d": F.col("d") + 1.8, "scene_id": F.lit(0).cast("bigint")})
    return convex_contour_vertices(contour, mesh.vertex_neighbors(t.triangles), t.mesh_vertices, pl).select("vertex_id")


def triangle_components(t):
    """Triangles linked over shared edges."""
    return graphs.connected_components(mesh.triangle_neighbors(t.triangles), t.triangles, SC, "triangle_id", "triangle_id", "neighbor_id")


TCC_SQL = """pr AS (SELECT min(triangle_id) AS lo, max(triangle_id) AS hi FROM fx_edges GROUP BY e0, e1 HAVING count(*) = 2),
nb AS (SELECT lo AS v, hi AS n FROM pr UNION SELECT hi, lo FROM pr),
cc(v, component) USING KEY (v) AS (SELECT triangle_id, triangle_id FROM fx_triangles UNION
  SELECT nb.n, min(c.component) FROM cc c JOIN nb ON nb.v = c.v JOIN recurring.cc o ON o.v = nb.n WHERE c.component < o.component GROUP BY nb.n)"""


@query("mesh_components", f"""
WITH {TCC_SQL} SELECT component, count(*) AS n_triangles, {r('sum(0.5 * sqrt(nx*nx + ny*ny + nz*nz))')} AS area FROM cc JOIN fx_normals t ON t.triangle_id = cc.v GROUP BY 1""")
def _(t):
    area = mesh.with_area_normal(mesh.corners(t.triangles, t.mesh_vertices)).select("scene_id", "triangle_id", "area")
    return triangle_components(t).join(area, ["scene_id", "triangle_id"]).groupBy("component").agg(
        F.count("*").alias("n_triangles"), r6(F.sum("area")).alias("area"))


@query("drop_small_components", f"""
WITH {TCC_SQL}, ar AS (SELECT component, sum(0.5 * sqrt(nx*nx + ny*ny + nz*nz)) AS area FROM cc JOIN fx_normals t ON t.triangle_id = cc.v GROUP BY 1)
SELECT cc.v AS triangle_id FROM cc JOIN ar ON ar.component = cc.component WHERE area >= 0.02""")
def _(t):
    from atrium.operators.maintenance import drop_small_components

    return drop_small_components(t.triangles, t.mesh_vertices, 0.02).select("triangle_id")


@query("largest_component", f"""
WITH {TCC_SQL}, n AS (SELECT component, count(*) AS c FROM cc GROUP BY 1), best AS (SELECT component FROM n ORDER BY c DESC, component LIMIT 1)
SELECT v AS triangle_id FROM cc WHERE component = (SELECT component FROM best)""")
def _(t):
    from atrium.operators.maintenance import largest_component

    return largest_component(triangle_components(t), SC).select("triangle_id")


@query("greedy_pairs", """
WITH RECURSIVE p AS (SELECT DISTINCT e0, e1, (e0 * 7919 + e1 * 104729) % 1000003 AS cost FROM fx_edges),
k AS (SELECT *, row_number() OVER (ORDER BY cost, md5('7|' || e0 || '|' || e1), e0, e1) AS rn FROM p),
g(rn, used, e0, e1, cost, took) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false
  UNION ALL SELECT k.rn, CASE WHEN list_contains(g.used, k.e0) OR list_contains(g.used, k.e1) THEN g.used ELSE g.used || [k.e0, k.e1] END, k.e0, k.e1, k.cost,
    NOT (list_contains(g.used, k.e0) OR list_contains(g.used, k.e1)) FROM g JOIN k ON k.rn = g.rn + 1)
SELECT e0, e1, cost FROM g WHERE took""")
def _(t):
    pairs = mesh.edge_rows(t.triangles).select("scene_id", "e0", "e1").distinct().withColumn("cost", (F.col("e0") * 7919 + F.col("e1") * 104729) % 1000003)
    return graphs.greedy_pairs(pairs, SC, "e0", "e1", "cost").select("e0", "e1", "cost")


@query("trace_loops")
def _(t):
    out = graphs.trace_faces(mesh.boundary_edges(t.triangles), t.mesh_vertices, SC)
    return out.select("loop_id.a", "loop_id.b", "pos", "vertex_id", r6(F.col("area")).alias("area"))


@query("branching_vertices", """
WITH b AS (SELECT e0, e1 FROM fx_edges GROUP BY ALL HAVING count(*) = 1), v AS (SELECT unnest([e0, e1]) AS vertex_id FROM b)
SELECT vertex_id, count(*) AS degree FROM v GROUP BY 1 HAVING count(*) <> 2""")
def _(t):
    return graphs.branching_vertices(mesh.boundary_edges(t.triangles), SC).select("vertex_id", "degree")
