"""Nearest, range and ray joins against brute force, with crowded and copied points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.functions.vectors import vec
from atrium.operators import matching, polygons
from atrium.operators import spatial as S
from atrium.operators.semantics import knn_probabilities


def cloud(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 10, (n, 3))
    p[: n // 3] = [5.0, 5.0, 5.0]  # a third are copies of one place
    p[n // 3: 2 * n // 3] = 2.0 + rng.normal(0, 1e-3, (2 * n // 3 - n // 3, 3))  # a third crowd together
    rows = [(int(i % 2), int(i), *map(float, q)) for i, q in enumerate(p)]
    return p, spark.createDataFrame(rows, f"scene_id int, {name} int, x double, y double, z double")


@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("leaves", [S.LEAVES_PER_ROW, 2])
def test_knn_equals_brute_force(spark, monkeypatch, k, leaves):
    monkeypatch.setattr(S, "LEAVES_PER_ROW", leaves)
    a, targets = cloud(spark, 300, 1, "tid_")
    b, queries = cloud(spark, 200, 2, "qid")
    tree = S.point_tree(targets, ["scene_id"], "tid_", vec(), k)
    got = {r.qid: [(h.d2, h.tid) for h in r.hits] for r in S.knn(queries, tree, vec(), k=k).collect()}
    assert len(got) == 200
    for i, q in enumerate(b):
        mine = [j for j in range(300) if j % 2 == i % 2]
        want = sorted((float(((q - a[j]) ** 2).sum()), j) for j in mine)[:k]
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want])
        assert [j for _, j in got[i]] == [j for _, j in want]


def test_within_and_max_dist(spark):
    a, targets = cloud(spark, 200, 3, "tid_")
    b, queries = cloud(spark, 100, 4, "qid")
    tree = S.point_tree(targets, ["scene_id"], "tid_", vec(), None)
    got = {(r.qid, r.tid) for r in S.within(queries, tree, vec(), 1.5).collect()}
    want = {(i, j) for i in range(100) for j in range(200) if i % 2 == j % 2 and ((b[i] - a[j]) ** 2).sum() <= 1.5**2}
    assert got == want
    near = S.nearest(queries, tree, vec(), max_dist=0.5, how="left").filter("tid IS NULL").count()
    assert near == sum(1 for i in range(100) if not any(i % 2 == j % 2 and ((b[i] - a[j]) ** 2).sum() <= 0.25 for j in range(200)))


def test_wall_ray(spark):
    tri = spark.createDataFrame([(0, 7, 0., -1., -1., 0., 2., -1., 0., -1., 2.)], "scene_id int, triangle_id int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    rays = spark.createDataFrame([
        (0, 1, -1., 0., 0., 1., 0., 0.), (0, 2, -1., 0., 0., -0.5, 0., 0.), (0, 3, -1., 0., 0., -1., 1., 0.), (0, 4, -1., 0., 0., 0.01, 0., 0.)],
        "scene_id int, ray_id int, ox double, oy double, oz double, ex double, ey double, ez double")
    tree = S.shape_tree(tri, ["scene_id"], "triangle_id", [vec(c) for c in "abc"])
    hits = S.ray_hits(rays, tree, ["ray_id"], vec("o"), vec("e"), 0.05).collect()
    assert [(r.ray_id, r.tid) for r in hits] == [(1, 7)]
    assert hits[0].t == pytest.approx(0.5)


def test_point_in_polygon_l_shape(spark):
    ring = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    rings = spark.createDataFrame([(0, 1, [{"x": float(x), "y": float(y)} for x, y in ring])], "level_id int, polygon_id int, ring array<struct<x: double, y: double>>")
    edges = polygons.ring_edges(rings, ["level_id", "polygon_id"])
    pts = spark.createDataFrame([(0, 0, 0.5, 3.5), (0, 1, 3.5, 0.5), (0, 2, 2., 2.), (0, 3, 4., 0.5), (0, 4, -1., 0.5)], "level_id int, pid int, x double, y double")
    inside = lambda **kw: sorted(r.pid for r in polygons.points_in_polygons(pts, edges, ["level_id"], ["pid"], **kw).collect())
    assert inside() == [0, 1]
    assert inside(boundary=1e-8) == [0, 1, 3]


def test_knn_probabilities_sum_to_one(spark):
    _, v = cloud(spark, 60, 5, "vertex_id")
    _, r = cloud(spark, 90, 6, "rid")
    out = knn_probabilities(v, r.withColumn("label", F.col("rid") % 4), ["scene_id"], 5)
    sums = out.groupBy("scene_id", "vertex_id").agg(F.sum("p").alias("p")).collect()
    assert len(sums) == 60 and all(abs(s.p - 1) < 1e-12 for s in sums)


def test_interval_overlap_counts_each_pair_once(spark):
    left = spark.createDataFrame([(0, 1, -0.5, 3.2), (0, 2, 5.0, 5.0)], "k int, wall_id int, z_min double, z_max double")
    right = spark.createDataFrame([(0, 9, 0.1, 6.0), (0, 8, -2.0, -0.6)], "k int, level int, low double, high double")
    got = sorted((r.wall_id, r.level) for r in matching.interval_overlap(left, right, ["k"]).collect())
    assert got == [(1, 9), (2, 9)]


def leaf_sizes(tree):
    rows = tree.rows.groupBy("scene_id", S.node_id(S.DEPTH).alias("node")).agg(F.count("*").alias("n"), F.first("leaf").alias("leaf")).collect()
    out = {}
    for r in rows:
        out.setdefault(r.scene_id, []).append((r.leaf, r.n))
    return {k: sorted(v) for k, v in out.items()}


def test_every_scene_has_its_own_octree(spark):
    rng = np.random.default_rng(5)
    points = rng.random((60, 3)) * [1, 1, 0.2]
    scene = lambda k: [(k, i, *(float(c) for c in p * 1.5**(k % 40) - k)) for i, p in enumerate(points)]
    schema = "scene_id int, id int, x double, y double, z double"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    alone = leaf_sizes(S.point_tree(frame(scene(0)), ["scene_id"], "id", vec()))
    many = leaf_sizes(S.point_tree(frame([r for k in range(1000) for r in scene(k)]), ["scene_id"], "id", vec()))
    mean = lambda sizes: sum(n for _, n in sizes) / len(sizes)
    assert len(many) == 1000 and all(0.5 <= mean(sizes) / mean(alone[0]) <= 2 for sizes in many.values())


def test_a_crowded_scene_leaves_the_others_as_they_were(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, *map(float, rng.random(3))) for k in range(4) for i in range(300)]
    crowd = [(1, 1000 + i, *(0.5 + 1e-4 * float(c) for c in rng.random(3))) for i in range(3000)] + [(2, 5000 + i, 0.25, 0.25, 0.25) for i in range(500)]
    frame = lambda rows: spark.createDataFrame(rows, "scene_id int, id int, x double, y double, z double")
    before, tree = leaf_sizes(S.point_tree(frame(rows), ["scene_id"], "id", vec())), S.point_tree(frame(rows + crowd), ["scene_id"], "id", vec())
    after = leaf_sizes(tree)
    assert after[0] == before[0] and after[3] == before[3] and max(n for _, n in after[1]) <= 16
    assert sum(n for _, n in after[2]) == 301  # copies of one place are one target
    assert max(leaf for leaf, _ in after[1]) > max(leaf for leaf, _ in before[1])
    queries = frame([(k, i, *map(float, rng.random(3) * 1.4 - 0.2)) for k in (0, 1, 2, 7) for i in range(40)])
    got = {(r.scene_id, r.id): [(h.tid, h.d2) for h in r.hits] for r in S.knn(queries, tree, vec(), k=1).collect()}
    known = {k: [(t[1], np.array(t[2:])) for t in rows + crowd if t[0] == k] for k in (0, 1, 2)}
    for q in queries.collect():
        if q.scene_id == 7:  # a scene without targets
            assert (7, q.id) not in got
            continue
        best = min((float(((p - np.array([q.x, q.y, q.z])) ** 2).sum()), i) for i, p in known[q.scene_id])
        assert got[q.scene_id, q.id][0][1] == pytest.approx(best[0])


def test_codes_interleave_their_bits(spark):
    rng = np.random.default_rng(7)
    cells = [tuple(int(v) for v in rng.integers(0, 1 << 20, 3)) for _ in range(50)] + [(0, 0, 0), ((1 << 20) - 1,) * 3]
    df = spark.createDataFrame(cells, "x long, y long, z long").select("x", "y", "z", S.morton([F.col(c) for c in "xyz"]).alias("m"))
    for r in df.collect():
        assert r.m == sum(((c >> b) & 1) << (3 * b + a) for a, c in enumerate((r.x, r.y, r.z)) for b in range(20))


def test_nearest_of_those_below_a_limit(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, i, *map(float, rng.random(3) * [4, 4, 1]), float(rng.integers(0, 6))) for k in (0, 1) for i in range(250)]
    targets = spark.createDataFrame(rows, "scene_id int, id int, x double, y double, z double, v double")
    asked = [(k, i, *map(float, rng.random(3) * [5, 5, 2] - 0.5), float(rng.integers(-1, 7))) for k in (0, 1) for i in range(60)]
    queries = spark.createDataFrame(asked, "scene_id int, id int, x double, y double, z double, t double")
    p = vec()
    tree = S.build_tree(targets, ["scene_id"], "id", p.struct(), p, p, value=F.col("v"))
    for leaves in (S.LEAVES_PER_ROW, 3):
        monkeypatch.setattr(S, "LEAVES_PER_ROW", leaves)
        got = {(r.scene_id, r.id): (r.tid, r.dist) for r in S.nearest(queries, tree, p, how="left", max_dist=2.5, below=F.col("t")).collect()}
        assert len(got) == len(asked)
        for k, i, x, y, z, t in asked:
            best = min(((((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2) ** 0.5, j) for s, j, a, b, c, v in rows if s == k and v < t), default=None)
            if best is None or best[0] > 2.5:
                assert got[k, i][0] is None
            else:
                assert got[k, i][0] == best[1] and got[k, i][1] == pytest.approx(best[0])


def test_ray_packets_equal_every_triangle(spark, monkeypatch):
    rng = np.random.default_rng(9)
    corners = rng.random((2, 150, 1, 3)) * 6 + rng.normal(0, 0.5, (2, 150, 3, 3))
    corners[1, :3] = corners[1, 0]  # three equal triangles: the least id counts
    tris = [(k, i, *map(float, corners[k, i].ravel())) for k in (0, 1) for i in range(150)]
    tri = spark.createDataFrame(tris, "scene_id int, triangle_id int, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz"))
    lines = [(k, i, *map(float, rng.random(3) * 6), *map(float, rng.random(3) * 8 - 1)) for k in (0, 1, 2) for i in range(120)]
    lines += [(0, 200 + i, 3.0, 3.0, 3.0, *map(float, 3 + s * np.eye(3)[a] * 4)) for i, (a, s) in enumerate((a, s) for a in range(3) for s in (-1, 1))]  # along the axes
    lines += [(1, 300, *map(float, corners[1, 0].mean(axis=0) + [0, 0, 3]), *map(float, corners[1, 0].mean(axis=0) - [0, 0, 3])), (0, 301, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    rays = spark.createDataFrame(lines, "scene_id int, ray_id int, " + ", ".join(f"{n}{c} double" for n in "oe" for c in "xyz"))
    want = {}
    for k, i, *p in lines:
        if k == 2:
            continue
        o, d = np.array(p[:3]), np.array(p[3:]) - p[:3]
        a, u, v = corners[k, :, 0], corners[k, :, 1] - corners[k, :, 0], corners[k, :, 2] - corners[k, :, 0]
        h = np.cross(d, v)
        det = (u * h).sum(axis=1)
        with np.errstate(all="ignore"):
            s, q = o - a, np.cross(o - a, u)
            b, c, t = (s * h).sum(axis=1) / det, (d * q).sum(axis=1) / det, (v * q).sum(axis=1) / det
            hit = (np.abs(det) > 1e-12) & (b >= 0) & (c >= 0) & (b + c <= 1) & (t >= 0) & (t < 1)
        if hit.any():
            j = min(np.flatnonzero(hit), key=lambda j: (t[j], j))
            want[k, i] = (j, t[j])
    tree = S.shape_tree(tri, ["scene_id"], "triangle_id", [vec(c) for c in "abc"])
    for leaves in (S.LEAVES_PER_ROW, 3):
        monkeypatch.setattr(S, "LEAVES_PER_ROW", leaves)
        got = {(r.scene_id, r.ray_id): r for r in S.ray_hits(rays, tree, ["ray_id"], vec("o"), vec("e"), counted=True).collect()}
        assert set(got) == set(want) and all(got[k].tid == j and got[k].t == pytest.approx(t) for k, (j, t) in want.items())


def test_rays_look_into_few_leaves(tables):
    from atrium.plans.spatial_joins import cornered, room_rays
    from atrium.operators import maintenance as M

    out = S.ray_hits(room_rays(tables), M.triangle_tree(cornered(tables)), ["vertex_id"], vec("o"), vec("e"), 0.05, counted=True)
    tested = [r.tested for r in out.select("tested").collect()]
    assert tested and max(tested) < 10


def test_rays_along_a_slope_list_few_leaves(spark, monkeypatch):
    """A long flight of steps seen along its slope: packets list the leaves they enter first, in rounds until the first hit."""
    corner = lambda x, y: (0.25 * x, 0.25 * y, 0.5 * (y // 4))
    quads = [(x, y) for x in range(4) for y in range(240) if (x * 7 + y * 3) % 11]
    shapes = [(corner(x, y), corner(x + 1, y), corner(x, y + 1)) for x, y in quads] + [(corner(x + 1, y), corner(x + 1, y + 1), corner(x, y + 1)) for x, y in quads]
    tri = spark.createDataFrame([(i, *(float(v) for p in t for v in p)) for i, t in enumerate(shapes)], "triangle_id int, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz"))
    ends = [(0.25 * x + 0.03, 0.25 * y + 0.04, 0.5 * (y // 4) - 0.4) for x in range(4) for y in range(8, 240, 3)]
    origin = np.array([0.5, 0.5, 2.0])
    rays = spark.createDataFrame([(i, *map(float, origin), *map(float, p)) for i, p in enumerate(ends)], "ray_id int, " + ", ".join(f"{n}{c} double" for n in "oe" for c in "xyz"))
    p = np.array(shapes)
    a, u, v = p[:, 0], p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    want = {}
    for i, end in enumerate(ends):
        d = np.array(end) - origin
        h = np.cross(d, v)
        det = (u * h).sum(axis=1)
        with np.errstate(all="ignore"):
            s, q = origin - a, np.cross(origin - a, u)
            b, c, t = (s * h).sum(axis=1) / det, (d * q).sum(axis=1) / det, (v * q).sum(axis=1) / det
            hit = (np.abs(det) > 1e-12) & (b >= 0) & (c >= 0) & (b + c <= 1) & (t >= 0) & (t < 1)
        if hit.any():
            want[i] = t[hit].min()
    walked = []
    walk = S.walk_packets

    def watched(live, tree, most):
        out = walk(live, tree, most)
        listed = out.filter("node >= 0").groupBy(*S.PACKET).count().agg(F.max("count")).first()[0]
        walked.append((most, listed))
        return out

    monkeypatch.setattr(S, "walk_packets", watched)
    monkeypatch.setattr(S, "FIRST_NODES", 1)
    tree = S.shape_tree(tri, [], "triangle_id", [vec(c) for c in "abc"])
    got = {r.ray_id: r.t for r in S.ray_hits(rays, tree, ["ray_id"], vec("o"), vec("e")).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(t) for k, t in want.items())
    assert len(walked) > 1 and all(listed is None or listed <= most for most, listed in walked)


def test_leaves_listed_do_not_grow_with_the_length_of_rays(spark, monkeypatch):
    """Rays down onto long stairs list few leaves each, however many steps they pass before the first hit."""
    corner = lambda x, y: (0.25 * x, 0.25 * y, 0.5 * (y // 4))
    shapes = [t for x in range(4) for y in range(1600) if (x * 7 + y * 3) % 11
              for t in ((corner(x, y), corner(x + 1, y), corner(x, y + 1)), (corner(x + 1, y), corner(x + 1, y + 1), corner(x, y + 1)))]
    tri = spark.createDataFrame([(i, *(float(v) for p in t for v in p)) for i, t in enumerate(shapes)], "triangle_id int, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz"))
    ends = [(0.25 * x + 0.03, 0.25 * y + 0.04, 0.5 * (y // 4) - 0.4) for x in range(4) for y in range(1200, 1600)]
    rays = spark.createDataFrame([(i, 0.5, 0.5, 2.0, *p) for i, p in enumerate(ends)], "ray_id int, " + ", ".join(f"{n}{c} double" for n in "oe" for c in "xyz"))
    listed, walk = [], S.walk_packets

    def watched(live, tree, most):
        out = walk(live, tree, most)
        listed.append(out.filter("node >= 0").count())
        return out

    monkeypatch.setattr(S, "walk_packets", watched)
    tree = S.shape_tree(tri, [], "triangle_id", [vec(c) for c in "abc"])
    assert S.ray_hits(rays, tree, ["ray_id"], vec("o"), vec("e")).count() > 1000
    assert len(listed) <= 3 and sum(listed) <= 6 * len(ends), listed


def test_codes_are_listed_in_bounded_tasks(spark, monkeypatch):
    """The list of a code's cells on all levels is spread by count, however small the codes are in a shuffle."""
    monkeypatch.setattr(S, "CODES_PER_TASK", 100)
    monkeypatch.setattr(S, "GROUPS_PER_TASK", 50)
    rows = spark.range(1000).selectExpr("id", f"id + {1 << 60} AS code")
    spread = []
    method = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda df, n, *on: spread.append(n) or method(df, n, *on))
    assert S.with_leaf_levels(rows, [], (), 16).filter("leaf > 0").count() == 1000
    assert S.spread_groups(rows, ["code"]).count() == 1000
    assert spread == [10, 20]
