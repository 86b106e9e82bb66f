"""Loops keep the estimated size of their tables: a number with twice the digits each round stalls the driver."""

from pyspark.sql import functions as F

from atrium.operators import graphs
from atrium.session import end_round

SC = ["scene_id"]


def digits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimate_of_a_round_is_that_of_its_rows(spark):
    df = spark.range(10).selectExpr("id", "id + 1 AS next")
    for _ in range(6):
        df = end_round(df.join(df.select(F.col("id").alias("next"), F.col("next").alias("then")), "next", "left").select("id", F.coalesce("then", "next").alias("next")))
    assert df.count() == 10 and digits(df) < 64


def test_loops_of_a_ring_keep_their_estimate(spark):
    n = 64
    points = spark.range(n).selectExpr("0 AS scene_id", "id AS vertex_id", f"cos(id * 2 * pi() / {n}) AS x", f"sin(id * 2 * pi() / {n}) AS y")
    edges = spark.range(n).selectExpr("0 AS scene_id", f"least(id, (id + 1) % {n}) AS e0", f"greatest(id, (id + 1) % {n}) AS e1")
    loops = graphs.trace_faces(edges, points, SC)
    assert sorted(r.pos for r in loops.collect()) == list(range(n))
    assert digits(loops) < 1000
    parts = graphs.connected_components(edges, points, SC, "vertex_id", "e0", "e1")
    assert {r.component for r in parts.collect()} == {0} and digits(parts) < 1000


def test_seeds_tried_at_once_give_the_planes_of_one_at_a_time(spark, monkeypatch):
    from atrium.operators import fitting

    # segments cut across three levels and a slope, so that seeds take vertices of later ones and are picked again
    v = spark.range(400).selectExpr("id % 2 AS scene_id", "id div 2 AS vertex_id", "(id div 2) % 20 * 1D AS x", "(id div 40) * 1D AS y").selectExpr(
        "*", "CASE WHEN x < 8 THEN 0D WHEN x < 13 THEN 1D ELSE y * (0.5D + scene_id) END AS z", "CAST(pmod(CAST(x AS INT) div 6 + 3 * (CAST(y AS INT) div 4) + scene_id, 7) AS INT) AS segment_id")
    t = v.filter("x < 19 AND y < 9").selectExpr("scene_id", "inline(array(struct(vertex_id * 2 AS triangle_id, vertex_id AS v0, vertex_id + 1 AS v1, vertex_id + 20 AS v2),"
                                                " struct(vertex_id * 2 + 1 AS triangle_id, vertex_id + 1 AS v0, vertex_id + 21 AS v1, vertex_id + 20 AS v2)))")
    found = []
    for most in (1, 256):
        monkeypatch.setattr(fitting, "MOST_AHEAD", most)
        state, planes = fitting.plane_extraction(v, t, SC, min_seed=8, iterations=8, ahead=most)
        found.append((sorted((r.scene_id, r.vertex_id, r.polygon_id) for r in state.collect()), sorted(tuple(r) for r in planes.collect())))
    assert found[0] == found[1] and len(found[0][1]) > 6


def test_seeds_apart_take_one_round(spark, monkeypatch):
    from atrium.operators import fitting

    v = spark.range(48).selectExpr("0 AS scene_id", "id AS vertex_id", "id % 4 * 1D AS x", "id div 4 * 1D AS y", "id div 8 * 1D AS z", "CAST(id div 8 AS INT) AS segment_id")
    t = spark.range(44).filter("id % 4 < 3").selectExpr("0 AS scene_id", "id AS triangle_id", "id AS v0", "id + 1 AS v1", "id + 4 AS v2")
    rounds, plain = [], fitting.ransac_plane
    monkeypatch.setattr(fitting, "ransac_plane", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    state, planes = fitting.plane_extraction(v, t, SC, min_seed=5, iterations=8)
    assert {(r.vertex_id // 8, r.polygon_id) for r in state.filter("vertex_id < 47").collect()} == {(i, i) for i in range(6)}
    assert {(r.polygon_id, round(-r.d / r.c, 6)) for r in planes.collect()} == {(i, float(i)) for i in range(6)}
    assert len(rounds) == 1
