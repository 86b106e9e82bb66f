"""DuckDB text of the derived scene tables, used as CTEs of the oracle queries."""

VIEWS = {
    "fx_frames": """
SELECT o_orderkey % 4 AS scene_id, o_orderkey AS frame_id,
  'frame_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.png' AS name,
  CAST(o_custkey % 20 AS DOUBLE) AS tx, CAST(floor(o_custkey / 20.0) AS DOUBLE) AS ty, CAST(1.5 AS DOUBLE) AS tz,
  CAST(o_orderkey % 4 AS INT) AS yaw_quarter, o_orderdate AS captured_at,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS DOUBLE) AS cosy,
  CAST(CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS DOUBLE) AS siny
FROM orders""",
    "fx_samples": """
SELECT l_orderkey % 4 AS scene_id, l_orderkey AS frame_id,
  CAST(l_linenumber * 60 + l_suppkey % 60 AS INT) AS pix_row, CAST(l_partkey % 800 AS INT) AS pix_col,
  CASE WHEN l_discount = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / 5000 END AS depth,
  CAST(l_partkey % 133 AS INT) AS coco_id, l_quantity AS weight
FROM lineitem""",
    "fx_vertices": """
SELECT p_partkey % 2 AS scene_id, p_partkey AS vertex_id, p_size * CAST(0.4 AS DOUBLE) AS x,
  (p_retailprice - 900) * CAST(0.2 AS DOUBLE) AS y, (p_partkey % 30) * CAST(0.1 AS DOUBLE) AS z,
  CAST(p_partkey % 97 AS INT) AS segment_id
FROM part""",
    "fx_rays": """
SELECT l_suppkey % 2 AS scene_id, l_partkey AS hint_vertex, l_quantity * CAST(0.4 AS DOUBLE) AS x,
  l_extendedprice / 5250 AS y, l_discount * 30 AS z, CAST(l_suppkey % 9 AS INT) AS label
FROM lineitem""",
    "fx_quads": """
SELECT p_partkey AS v FROM part
WHERE p_partkey % 50 < 49 AND p_partkey + 50 < (SELECT count(*) FROM part) AND p_size > 5""",
    "fx_triangles": """
SELECT CAST(0 AS BIGINT) AS scene_id, v * 2 AS triangle_id, v AS v0, v + 1 AS v1, v + 50 AS v2, CAST(floor(v / 500.0) AS INT) AS polygon_id FROM fx_quads
UNION ALL SELECT 0, v * 2 + 1, v + 1, v + 51, v + 50, CAST(floor(v / 500.0) AS INT) FROM fx_quads""",
    "fx_mesh_vertices": """
SELECT CAST(0 AS BIGINT) AS scene_id, p_partkey AS vertex_id, (p_partkey % 50) * CAST(0.1 AS DOUBLE) AS x,
  floor(p_partkey / 50.0) * CAST(0.1 AS DOUBLE) AS y, floor(p_partkey / 500.0) * CAST(0.5 AS DOUBLE) AS z FROM part""",
    "fx_corners": """
SELECT t.scene_id, t.triangle_id, t.polygon_id, t.v0, t.v1, t.v2, a.x AS ax, a.y AS ay, a.z AS az,
  b.x AS bx, b.y AS by, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
FROM fx_triangles t JOIN fx_mesh_vertices a ON a.vertex_id = t.v0
  JOIN fx_mesh_vertices b ON b.vertex_id = t.v1 JOIN fx_mesh_vertices c ON c.vertex_id = t.v2""",
    "fx_normals": """
SELECT *, (by-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny,
  (bx-ax)*(cy-ay)-(by-ay)*(cx-ax) AS nz FROM fx_corners""",
    "fx_edges": """
SELECT scene_id, polygon_id, triangle_id, least(v0,v1) AS e0, greatest(v0,v1) AS e1 FROM fx_triangles
UNION ALL SELECT scene_id, polygon_id, triangle_id, least(v1,v2), greatest(v1,v2) FROM fx_triangles
UNION ALL SELECT scene_id, polygon_id, triangle_id, least(v2,v0), greatest(v2,v0) FROM fx_triangles""",
    "fx_cells": """
SELECT CAST(floor(p_partkey / 1000.0) AS INT) AS level_id, CAST(floor(p_partkey / 50.0) AS INT) AS r,
  CAST(p_partkey % 50 AS INT) AS c, p_size > 8 AS free,
  CASE WHEN p_size > 8 THEN CAST(1 + floor((p_partkey % 50) / 13.0) + 4 * floor(p_partkey / 500.0) AS INT) ELSE 0 END AS label
FROM part""",
    "fx_rooms": """
SELECT n_nationkey AS room_key, n_regionkey AS level_key,
  'level_' || CAST(n_regionkey AS VARCHAR) || '_room_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS room_id,
  CAST(n_nationkey % 5 AS DOUBLE) * 4 AS x0, CAST(floor(n_nationkey / 5.0) AS DOUBLE) * 4 AS y0,
  CAST(n_nationkey % 5 AS DOUBLE) * 4 + 4 AS x1, CAST(floor(n_nationkey / 5.0) AS DOUBLE) * 4 + 4 AS y1 FROM nation""",
    "fx_ceilings": """
SELECT s_suppkey AS polygon_id, CAST(s_suppkey % 10 AS DOUBLE) * 2 AS x0, CAST(floor((s_suppkey % 100) / 10.0) AS DOUBLE) * 2 AS y0,
  CAST(s_suppkey % 10 AS DOUBLE) * 2 + 3 AS x1, CAST(floor((s_suppkey % 100) / 10.0) AS DOUBLE) * 2 + 3 AS y1,
  (s_suppkey % 3) * CAST(0.02 AS DOUBLE) AS a, (s_suppkey % 4) * CAST(0.01 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS c,
  -(CAST(2.4 AS DOUBLE) + (s_nationkey % 5) * CAST(0.1 AS DOUBLE)) AS d FROM supplier""",
    "fx_walls": """
SELECT c_custkey AS wall_id, CAST(c_nationkey % 5 AS DOUBLE) * 4 AS wx, CAST(floor(c_nationkey / 5.0) AS DOUBLE) * 4 AS wy,
  c_acctbal / 5000 AS z_min, c_acctbal / 5000 + CAST(1.5 AS DOUBLE) AS z_max FROM customer""",
    "fx_evidence": """
SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS u, CAST(embedding[2] AS DOUBLE) AS z, label AS wall_id FROM embeddings""",
    "fx_frame_events": """
SELECT event_id AS record_index, ts, user_id AS scene_id, event_type AS layout_name, value AS depth_mean FROM events""",
    "fx_planes": """
SELECT polygon_id, a / l AS a, b / l AS b, c / l AS c, d / l AS d FROM (
  SELECT *, sqrt(a*a + b*b + c*c) AS l FROM fx_ceilings)""",
    "label_map": """
SELECT CAST(range AS INT) AS coco_id, CASE
  WHEN range IN (109, 110, 111, 112, 131) THEN 0 WHEN range IN (118) THEN 1 WHEN range IN (87, 122, 132) THEN 2
  WHEN range IN (85, 86, 114, 120) THEN 3 WHEN range IN (115) THEN 4 WHEN range IN (93) THEN 5
  WHEN range IN (90, 116, 119, 123, 125, 126) THEN 6 WHEN range IN (106) THEN 7 ELSE 8 END AS layout_id
FROM range(133)""",
}

NEEDS = {
    "fx_triangles": ["fx_quads"],
    "fx_corners": ["fx_triangles", "fx_mesh_vertices"],
    "fx_normals": ["fx_corners"],
    "fx_edges": ["fx_triangles"],
    "fx_planes": ["fx_ceilings"],
}
