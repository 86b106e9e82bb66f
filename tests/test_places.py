"""Queries at one place are searched once and all get its answer."""

import pytest
from pyspark.sql import functions as F

from atrium.functions.vectors import vec
from atrium.operators import spatial as S

SC = ["scene_id"]


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_copies_of_a_query_are_searched_once(spark, monkeypatch, k, how):
    points = spark.range(300).selectExpr("0 AS scene_id", "id AS tid_", "CAST(id * 7 % 31 AS DOUBLE) AS x", "CAST(id * 5 % 23 AS DOUBLE) AS y", "0D AS z")
    places = spark.range(20).selectExpr("CAST(id % 2 AS INT) AS scene_id", "id * 1.7D AS x", "id * 0.9D - 3 AS y", "CASE WHEN id % 5 <> 0 THEN 0.5D END AS z")
    queries = places.crossJoin(spark.range(50).withColumnRenamed("id", "copy"))
    searched, group_queries = [], S.group_queries
    monkeypatch.setattr(S, "group_queries", lambda queries, *rest: searched.append(queries.count()) or group_queries(queries, *rest))
    tree = S.point_tree(points, SC, "tid_", vec(), k)
    copied = S.knn(queries, tree, vec(), k=k, how=how)
    single = S.knn(places, tree, vec(), k=k, how=how)
    assert searched == [20, 20]
    rows = lambda df: sorted(map(str, df.select("scene_id", "x", "y", "z", "hits").collect()))
    assert copied.columns == [*queries.columns, "hits"]
    assert rows(copied.groupBy("scene_id", "x", "y", "z", F.col("hits").alias("hits")).count().filter("count = 50")) == rows(single)


def test_far_leaves_of_a_list_are_not_measured(spark):
    leaf = lambda x: f"named_struct('lx', {x}D, 'ly', 0D, 'lz', 0D, 'hx', {x + 1}D, 'hy', 1D, 'hz', 0D, 'members', transform(sequence(0, 2), i -> struct(i + {x} AS tid, struct(i * 0.5D + {x} AS x, 0D AS y, 0D AS z) AS geom)))"
    rows = spark.range(1).selectExpr("0.1D AS x", "0D AS y", "0D AS z", f"array({leaf(50)}, {leaf(0)}) AS leaves")
    near_only = lambda q, g: F.when(g["x"] >= 50, F.raise_error(F.lit("measured a far target")).cast("double")).otherwise(S.point_metric(q, g))
    found = rows.select(S.scan_leaves(vec(), F.col("leaves"), near_only, 3, None).alias("hits")).first().hits
    assert [h.tid for h in found] == [0, 1, 2]


def test_listed_segments_measure_alike(spark):
    rows = spark.range(200).selectExpr("sin(id) AS x", "cos(id * 3) AS y", "sin(id * 7) AS z", "named_struct('a', named_struct('x', cos(id), 'y', sin(id * 2), 'z', 0.2D), 'b', named_struct('x', IF(id % 5 = 0, cos(id), cos(id * 4)), 'y', sin(id * 2), 'z', 0.2D)) AS g")
    out = rows.select(S.segment_metric(vec(), F.col("g")).alias("p"), S.listed_segment_metric(vec(), F.col("g")).alias("q")).collect()
    assert all(r.p == r.q for r in out)


def test_upper_levels_of_a_large_tree_are_broadcast(spark, monkeypatch):
    points = spark.range(2000).selectExpr("0 AS scene_id", "id AS tid_", "rand(1) AS x", "rand(2) AS y", "rand(3) AS z")
    tree = S.point_tree(points, SC, "tid_", vec())
    assert tree.levels >= 2 and tree.cells > 64
    monkeypatch.setattr(S, "BROADCAST_CELLS", 64)
    assert tree.is_small(1) and not tree.is_small(2)
    placed, groups = S.group_queries(points, tree, vec())
    walk = S.descend(S.spread_groups(groups, [*SC, *S.GROUP], 7), tree, 1, None, False, 7)
    assert "REPARTITION_BY_NUM" in walk._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[0]
    near = S.nearest(points, tree, vec(), tid="found")
    assert near.filter("found = tid_ AND dist = 0").count() == 2000


def test_queries_at_places_of_their_own_are_not_stored(spark, monkeypatch):
    points = spark.range(300).selectExpr("0 AS scene_id", "id AS tid_", "CAST(id * 7 % 31 AS DOUBLE) AS x", "CAST(id * 5 % 23 AS DOUBLE) AS y", "0D AS z")
    tree = S.point_tree(points, SC, "tid_", vec())
    queries = spark.range(5000).selectExpr("0 AS scene_id", "id AS qid", "id * 0.006D AS x", "id * 0.004D AS y", "0D AS z")
    stored, cut = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: stored.append(df.count()) or cut(df))
    assert S.nearest(queries, tree, vec()).count() == 5000
    assert max(stored) < 5000


def test_neighbours_are_sought_for_segments_without_votes_only(spark, monkeypatch):
    from types import SimpleNamespace

    from atrium.operators import semantics
    from atrium.plans.registry import REGISTRY
    import atrium.plans  # noqa: F401

    vertices = spark.createDataFrame([(k, 10 * k + i, float(i), 0.0, 0.0, 2 * k + (i == 3)) for k in (0, 1) for i in range(4)], "scene_id bigint, vertex_id bigint, x double, y double, z double, segment_id int")
    # no ray of scene 0 is next to its vertex 3, a segment of its own
    rays = spark.createDataFrame([(k, i / 10, 0.0, 0.0, 1 + k + (i > 6)) for k in (0, 1) for i in range(20)] + [(1, 3.0, 0.0, 0.0, 7)], "scene_id bigint, x double, y double, z double, label int")
    asked, knn = [], S.knn
    monkeypatch.setattr(S, "knn", lambda queries, tree, *a, **b: (asked.append((queries.count(), tree.rows.count())) if b.get("k") == 5 else None) or knn(queries, tree, *a, **b))
    out = REGISTRY["segment_labels"].run(SimpleNamespace(vertices=vertices, rays=rays, spark=spark))
    got = {r.vertex_id: (r.label, r.share, r.fallback) for r in out.collect()}
    assert asked == [(1, 20)] and semantics.S is S
    assert got == {**{i: (2, 0.65, False) for i in range(3)}, 3: (2, 1.0, True), **{10 + i: (3, 0.65, False) for i in range(3)}, 13: (7, 1.0, False)}
