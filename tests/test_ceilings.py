"""Ceilings over points and rooms: copies of a candidate and rooms that cannot change cost nothing more."""

from pyspark.sql import functions as F

from atrium.operators import layout, matching
from atrium.operators.polygons import ring_edges

BOX = "array(struct(0D AS x, 0D AS y), struct(4D AS x, 0D AS y), struct(4D AS x, 4D AS y), struct(0D AS x, 4D AS y)) AS ring"


def test_copies_of_a_ceiling_do_not_multiply_points(spark, monkeypatch):
    # ids 0..59 in two planes; the copies differ in nothing but the id
    ceilings = spark.range(60).selectExpr("0 AS level_id", "id AS polygon_id", "0D AS a", "0D AS b", "1D AS c", "-2.4D - (id + 1) % 2 AS d", BOX)
    points = spark.range(3).selectExpr("0 AS level_id", "id AS vertex_id", "id * 3D AS x", "1D AS y")
    met = []
    plain = matching.points_in_polygons

    def counting(p, edges, *args, **kw):
        met.append(edges.select("polygon_id").distinct().count())
        return plain(p, edges, *args, **kw)

    monkeypatch.setattr(matching, "points_in_polygons", counting)
    out = matching.assign_ceiling(points, ceilings, ring_edges(ceilings, ["level_id", "polygon_id"]), ["level_id"], ["vertex_id"], 0.0, 2.7)
    got = {r.vertex_id: (r.polygon_id, r.is_fallback, r.ceiling_z) for r in out.collect()}
    assert got == {0: (1, False, 2.4), 1: (1, False, 2.4), 2: (None, True, 2.7)}
    assert met == [2]


def test_rooms_that_cannot_change_stay_out_of_the_rounds(spark, monkeypatch):
    # room 1: a plane at triangle 0, the others take it one after another; rooms 2..9 have none
    rows = spark.range(36).selectExpr("id div 4 + 1 AS label", "id % 4 AS triangle_id", "1D AS x", "1D AS y", "IF(id = 0, 7L, NULL) AS polygon_id",
                                      "id > 0 AS is_fallback", "0D AS a", "0D AS b", "1D AS c", "IF(id = 0, -2.5D, -2.7D) AS d", "IF(id = 0, 2.5D, 2.7D) AS ceiling_z")
    links = rows.filter("triangle_id < 3").select("label", F.inline(F.expr("array(struct(triangle_id, triangle_id + 1 AS neighbor_id), struct(triangle_id + 1 AS triangle_id, triangle_id AS neighbor_id))")))
    sizes = []
    plain = layout.cut_lineage

    def counting(df):
        sizes.append(df.count())
        return plain(df)

    monkeypatch.setattr(layout, "cut_lineage", counting)
    got = {(r.label, r.triangle_id): (r.polygon_id, r.ceiling_z) for r in layout.propagate_ceilings(rows, links, ["label"], 0.0).collect()}
    assert got == {(k, i): (7, 2.5) if k == 1 else (None, 2.7) for k in range(1, 10) for i in range(4)}
    assert sizes[0] == 36 and max(sizes[1:]) <= 6


def test_within_measures_only_targets_whose_box_is_near(spark):
    from atrium.operators import spatial as S

    # eight long walls in one leaf; one of them is near the point, the metric of the others must not be asked for
    walls = spark.range(8).selectExpr("0 AS level_id", "id AS wall_id", "0D AS x0", "id * 10D AS y0", "80D AS x1", "id * 10D AS y1")
    points = spark.createDataFrame([(0, 40.0, 10.2), (0, 40.0, 49.9)], "level_id int, x double, y double")
    tree = S.shape_tree(walls, ["level_id"], "wall_id", [matching.flat("x0", "y0"), matching.flat("x1", "y1")], k=None)

    def strict(q, g):
        far = F.abs(q.y - g["a"]["y"]) > 5
        return F.when(far, F.raise_error(F.lit("asked for a far wall")).cast("double")).otherwise(S.segment_metric(q, g))

    got = sorted((r.tid, round(r.dist, 6)) for r in S.within(points, tree, matching.flat(), 0.35, strict).collect())
    assert got == [(1, 0.2), (5, 0.1)]
