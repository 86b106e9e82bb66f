"""Topology, loops, planes and graphs on small scenes with known answers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.functions.vectors import const
from atrium.operators import aggregates, fitting, graphs, mesh, ranking
from atrium.operators import maintenance as M

SC = ["scene_id"]


def grid_mesh(spark, n, m, hole=(), z=1.0):
    quads = [(r, c) for r in range(n) for c in range(m) if (r, c) not in hole]
    vid = lambda r, c: r * (m + 1) + c
    tris = []
    for r, c in quads:
        tris += [(vid(r, c), vid(r, c + 1), vid(r + 1, c + 1)), (vid(r, c), vid(r + 1, c + 1), vid(r + 1, c))]
    v = [(0, vid(r, c), float(c), float(r), z) for r in range(n + 1) for c in range(m + 1)]
    return (spark.createDataFrame(v, "scene_id int, vertex_id int, x double, y double, z double"),
            spark.createDataFrame([(0, i, *t, 0) for i, t in enumerate(tris)], "scene_id int, triangle_id int, v0 int, v1 int, v2 int, polygon_id int"))


def cube(spark):
    v = [(0, i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)]
    faces = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    t = [tri for i, (a, b, c, d) in enumerate(faces) for tri in ((a, b, c, i), (a, c, d, i))]
    return (spark.createDataFrame(v, "scene_id int, vertex_id int, x double, y double, z double"),
            spark.createDataFrame([(0, i, *x) for i, x in enumerate(t)], "scene_id int, triangle_id int, v0 int, v1 int, v2 int, polygon_id int"))


def test_cube(spark):
    v, t = cube(spark)
    area = mesh.with_area_normal(mesh.corners(t, v, SC)).agg(F.sum("area")).first()[0]
    assert area == pytest.approx(6)
    assert mesh.boundary_edges(t, SC).count() == 0
    assert mesh.watertight_edges(t, SC).count() == 18
    assert graphs.connected_components(mesh.triangle_neighbors(t, SC), t, SC, "triangle_id", "triangle_id", "neighbor_id").select("component").distinct().count() == 1


def test_cube_vertices_are_fixed_points(spark):
    v, _ = cube(spark)
    planes = spark.createDataFrame([(0, a * 2 + s, *(1.0 if i == a else 0.0 for i in range(3)), -float(s)) for a in range(3) for s in (0, 1)], "scene_id int, plane_id int, a double, b double, c double, d double")
    links = v.select("scene_id", "vertex_id", F.posexplode(F.array(*(F.col(c).cast("int") + 2 * i for i, c in enumerate("xyz")))).alias("rank", "plane_id"))
    moved = v.withColumns({c: F.col(c) + 0.25 for c in "xyz"})
    out = mesh.constrain_vertices(moved, links, planes, SC).collect()
    assert all(r.n_planes == 3 and r.displacement == pytest.approx(0.25 * 3**0.5) for r in out)


def test_open_square(spark):
    v, t = grid_mesh(spark, 2, 2)
    loops = graphs.trace_faces(mesh.boundary_edges(t, SC), v, SC).collect()
    assert len(loops) == 8 and {r.area for r in loops} == {4.0}
    assert sorted(r.pos for r in loops) == list(range(8))
    plane = aggregates.fit_plane_group(v, SC).first()
    assert (plane.a, plane.b, plane.c, plane.d) == pytest.approx((0, 0, 1, -1))


def test_ring_with_hole(spark):
    v, t = grid_mesh(spark, 3, 3, hole={(1, 1)})
    edges = mesh.boundary_edges(t, SC)
    assert edges.count() == 16
    loops = graphs.trace_faces(edges, v, SC)
    rings = loops.groupBy("scene_id", F.col("loop_id.a").alias("ring_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    nested = {r.ring_id: r for r in fitting.contour_nesting(rings, SC).collect()}
    outer, hole = sorted(nested.values(), key=lambda r: -r.area)
    assert (outer.area, outer.is_outer, hole.area, hole.is_outer, hole.parent_id) == (9.0, True, 1.0, False, outer.ring_id)


def test_loops_that_share_a_vertex(spark):
    v, t = grid_mesh(spark, 2, 2, hole={(0, 1), (1, 0)})
    edges = mesh.boundary_edges(t, SC)
    loops = graphs.trace_faces(edges, v, SC).groupBy("loop_id").agg(F.count("*").alias("n"), F.first("area").alias("a")).collect()
    assert sorted((r.n, r.a) for r in loops) == [(4, 1.0), (4, 1.0)]
    assert [(r.vertex_id, r.degree) for r in graphs.branching_vertices(edges, SC).collect()] == [(4, 4)]


def test_compact_vertices(spark):
    v, t = grid_mesh(spark, 2, 2, hole={(0, 0), (0, 1)})
    kept, tri = mesh.compact_vertices(v, t, SC)
    assert sorted(r.vertex_id for r in kept.collect()) == list(range(6))
    assert tri.agg(F.max("v1")).first()[0] <= 5


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(0, int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(0, 200, int(i)) for i in range(201, 240)] + [(1, i, i + 1) for i in range(60)]
    parent = {(s, i): (s, i) for s, a, b in pairs for i in (a, b)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s, a, b in pairs:
        ra, rb = find((s, a)), find((s, b))
        parent[max(ra, rb)] = min(ra, rb)
    edges = spark.createDataFrame(pairs, "scene_id int, a int, b int")
    nodes = spark.createDataFrame(list(parent), "scene_id int, node int")
    got = {(r.scene_id, r.node): r.component for r in graphs.connected_components(edges, nodes, SC, "node", "a", "b").collect()}
    assert got == {k: find(k)[1] for k in parent}


def test_greedy_equals_sequential(spark):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 40, (120, 2)) if a != b})
    cost = {p: float(rng.integers(0, 10)) for p in pairs}
    used, want = set(), set()
    for _, _, a, b in sorted((cost[p], md5_order(*p), *p) for p in pairs):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    df = spark.createDataFrame([(0, a, b, cost[a, b]) for a, b in pairs], "scene_id int, a int, b int, cost double")
    assert {(r.a, r.b) for r in graphs.greedy_pairs(df, SC, "a", "b", "cost").collect()} == want


def md5_order(*ids):
    return hashlib.md5("|".join(map(str, (7, *ids))).encode()).hexdigest()


def test_independent_set_follows_the_seeded_order(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(12)], "scene_id int, node int")
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(11)], "scene_id int, a int, b int")
    got = graphs.independent_set(nodes, edges, SC, "node", "a", "b").collect()
    want = set()
    for i in sorted(range(12), key=md5_order):
        if not {i - 1, i + 1} & want:
            want.add(i)
    assert {r.node for r in got} == want


def test_paths_of_consecutive_ids_end_in_few_rounds(spark, monkeypatch):
    calls = []
    cut = graphs.cut_lineage
    monkeypatch.setattr(graphs, "cut_lineage", lambda df: calls.append(1) or cut(df))
    pairs = spark.range(10_000).selectExpr("0 AS scene_id", "id AS a", "id + 1 AS b", "1 AS cost")
    taken = graphs.greedy_pairs(pairs, SC, "a", "b", "cost").selectExpr("explode(array(a, b)) AS n").collect()
    used = {r.n for r in taken}
    assert len(used) == len(taken) and all(i in used or i + 1 in used for i in range(10_000))
    assert len(calls) <= 2 * 40


def test_noisy_plane(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 5, (250, 2))
    z = 0.3 * xy[:, 0] + 0.1 * xy[:, 1] + 2
    z[:50] += rng.uniform(1, 3, 50)
    pts = spark.createDataFrame([(0, i, float(x), float(y), float(h)) for i, ((x, y), h) in enumerate(zip(xy, z))], "g int, vertex_id int, x double, y double, z double")
    p = fitting.ransac_plane(pts, ["g"], "vertex_id", preferred=const(0, 0, 1)).first()
    n = np.array([-0.3, -0.1, 1.0])
    assert np.allclose([p.a, p.b, p.c], n / np.linalg.norm(n), atol=1e-6)


def test_plane_extraction_of_two_steps(spark):
    v0, t0 = grid_mesh(spark, 6, 6, z=0.0)
    v1, t1 = grid_mesh(spark, 6, 6, z=1.0)
    shift = lambda df, cols, by: df.withColumns({c: F.col(c) + by for c in cols})
    v = v0.unionByName(shift(v1, ["vertex_id"], 49)).withColumn("segment_id", F.floor(F.col("vertex_id") / 49).cast("int"))
    t = t0.unionByName(shift(t1, ["v0", "v1", "v2"], 49).withColumn("triangle_id", F.col("triangle_id") + 72))
    state, planes = fitting.plane_extraction(v, t, SC, min_seed=20, iterations=16)
    assert sorted(r["count"] for r in state.groupBy("polygon_id").count().collect()) == [49, 49]
    assert sorted(round(-r.d / r.c, 6) for r in planes.collect()) == [0.0, 1.0]


def rdp(points, eps):
    def cut(lo, hi):
        a, b = points[lo], points[hi % n]
        best, at = -1.0, None
        for i in range(lo + 1, hi):
            d, p = b - a, points[i] - a
            l = np.hypot(*d)
            h = abs(d[0] * p[1] - d[1] * p[0]) / l if l > 1e-12 else np.hypot(*p)
            if h > best:
                best, at = h, i
        return cut(lo, at) | {at} | cut(at, hi) if best > eps else set()

    n = len(points)
    far = int(np.argmax(((points - points[0]) ** 2).sum(1)))
    return {0, far} | cut(0, far) | cut(far, n)


def test_rdp_equals_recursion(spark):
    rng = np.random.default_rng(5)
    angle = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    pts = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(2, 3, (60, 1))
    rows = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(pts)], "ring_id int, pos int, x double, y double")
    got = {r.pos for r in fitting.rdp_simplify(rows, ["ring_id"], "pos", 0.4).collect() if r.kept}
    assert got == rdp(pts, 0.4)


def test_prefix_counts_over_wide_ids(spark):
    rng = np.random.default_rng(7)
    ids = sorted(int(i) for i in set(rng.integers(0, 2**46, 200)) | set(range(5)) | {2**16 - 1, 2**16, 2**32})
    got = {r.id: r.k for r in ranking.dense_index(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id", "k").collect()}
    assert got == {i: k for k, i in enumerate(ids)}


def test_merge_cost_prefers_coplanar_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = []
    for poly, (slope, lift) in enumerate([(0.0, 0.0), (0.0, 0.001), (0.5, 3.0)]):
        for x, y in rng.uniform(0, 2, (80, 2)):
            rows.append((0, poly, float(x), float(y), float(slope * x + lift + rng.normal(0, 1e-3)), 0.0, 0.0, 1.0))
    pts = spark.createDataFrame(rows, "scene_id int, polygon_id int, x double, y double, z double, nx double, ny double, nz double")
    pairs = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "scene_id int, p int, q int")
    got = {(r.p, r.q): r.accepted for r in M.plane_merge_cost(pts, pairs, SC).collect()}
    assert got == {(0, 1): True, (1, 2): False}


def test_merge_pairs_reach_every_polygon(spark):
    from atrium.plans.upkeep import neighbor_pairs, noisy_points
    from atrium.sources.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.1")
    ids = {r.polygon_id for r in noisy_points(t).select("polygon_id").distinct().collect()}
    assert len(ids) > 26
    assert sorted((r.p, r.q) for r in neighbor_pairs(t).collect()) == [(p, p + 1) for p in sorted(ids) if p + 1 in ids]


def test_regularity_counts_all_close_pairs(spark):
    at = np.random.default_rng(3).uniform(-0.15, 0.15, (40, 3))
    rows = [(0, i, *map(float, p)) for i, p in enumerate(at)]
    vertices = spark.createDataFrame(rows, "scene_id int, vertex_id int, x double, y double, z double")
    triangles = spark.createDataFrame([(0, 0, 0, 1, 2)], "scene_id int, triangle_id int, v0 int, v1 int, v2 int")
    flat = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, 0.0)], "scene_id int, polygon_id int, a double, b double, c double, d double")
    out = M.layout_regularity(triangles, vertices, mesh.edge_uses(triangles), flat).first()
    dist = [d for j in range(40) for i in range(j) if (d := float(np.linalg.norm(at[i] - at[j]))) < 0.2]
    assert out.close_pairs == len(dist) and abs(out.magnetism - sum(np.log(d / 0.2 + 1e-6) for d in dist)) < 1e-6


def test_regularity_finds_nearest_foreign_edges_and_faces(spark):
    at = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0.5, 0.02, 0.05), (0.2, 0.9, 0.1), (0.3, 0.3, 0.4), (5, 5, 5)], float)
    vertices = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(at)], "scene_id int, vertex_id int, x double, y double, z double")
    triangles = spark.createDataFrame([(0, 0, 7, 0, 1, 2), (0, 1, 8, 3, 4, 5)], "scene_id int, triangle_id int, polygon_id int, v0 int, v1 int, v2 int")
    flat = spark.createDataFrame([(0, 7, 0.0, 0.0, 1.0, 0.0)], "scene_id int, polygon_id int, a double, b double, c double, d double")
    out = M.layout_regularity(triangles, vertices, mesh.edge_uses(triangles), flat).first()

    def to_segment(p, a, b):
        t = min(1.0, max(0.0, float((p - a) @ (b - a) / ((b - a) @ (b - a)))))
        return float(np.linalg.norm(p - a - t * (b - a)))

    def log_sum(least):
        return sum(np.log(d / 0.2 + 1e-6) for d in least if d < 0.2)

    edges = [(a, b) for f in ((0, 1, 2), (3, 4, 5)) for a, b in zip(f, f[1:] + f[:1])]
    by_edge = [min(to_segment(p, at[a], at[b]) for a, b in edges if i not in (a, b)) for i, p in enumerate(at)]
    steps = np.linspace(0, 1, 401)
    u, w = (g.ravel() for g in np.meshgrid(steps, steps))
    inside = u + w <= 1
    filled = {f: at[f[0]] + u[inside, None] * (at[f[1]] - at[f[0]]) + w[inside, None] * (at[f[2]] - at[f[0]]) for f in ((0, 1, 2), (3, 4, 5))}
    by_face = [min(float(np.linalg.norm(p - q, axis=1).min()) for f, q in filled.items() if i not in f) for i, p in enumerate(at)]
    assert out.edge_attracted == sum(d < 0.2 for d in by_edge) > 0 and abs(out.edge_magnetism - log_sum(by_edge)) < 1e-6
    assert out.face_attracted == sum(d < 0.2 for d in by_face) > 0 and abs(out.face_magnetism - log_sum(by_face)) < 0.02


def test_zero_vote_segment(spark):
    seg = spark.createDataFrame([(0, 1, 10), (0, 2, 10), (0, 3, 20)], "scene_id int, vertex_id int, segment_id int")
    votes = spark.createDataFrame([(0, 1, 2, 3), (0, 2, 1, 3)], "scene_id int, vertex_id int, label int, votes bigint")
    probs = spark.createDataFrame([(0, 3, 4, 0.6), (0, 3, 5, 0.4), (0, 1, 7, 1.0)], "scene_id int, vertex_id int, label int, p double")
    got = {r.vertex_id: (r.label, round(r.share, 6), r.fallback) for r in aggregates.segment_labels(votes, probs, seg).collect()}
    assert got == {1: (1, 0.5, False), 2: (1, 0.5, False), 3: (4, 0.6, True)}


def test_percentiles_by_selection(spark):
    rng = np.random.default_rng(9)
    values = {0: np.concatenate([rng.normal(0, 1, 700), np.full(400, 0.25), [1e9]]), 1: rng.uniform(0, 1, 30), 2: np.full(500, 3.0)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "scene_id int, v double")
    got = {r.scene_id: r for r in aggregates.percentiles(rows, SC, "v", {"median": 0.5, "p95": 0.95}, limit=40).collect()}
    for k, vs in values.items():
        assert (got[k].median, got[k].p95) == pytest.approx((np.quantile(vs, 0.5), np.quantile(vs, 0.95)))


def test_extraction_without_a_seed_has_no_planes(spark):
    vertices = spark.createDataFrame([(0, i, 0, float(i), float(i * i), 0.0) for i in range(6)], "scene_id int, vertex_id int, segment_id int, x double, y double, z double")
    triangles = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 3, 4, 5)], "scene_id int, triangle_id int, v0 int, v1 int, v2 int")
    state, planes = fitting.plane_extraction(vertices, triangles, SC, min_seed=10)
    assert planes.count() == 0 and planes.columns == ["scene_id", "polygon_id", "a", "b", "c", "d"]
    assert {r.polygon_id for r in state.collect()} == {fitting.UNASSIGNED}


@pytest.mark.parametrize("below", [False, True])
def test_walls_reach_the_floor_they_find(spark, below):
    # per scene: lean of the wall, height of its lower edge, edge on two planes, crossed by rays; what is expected
    cases = [(0.0, 1.0, False, False, True), (0.1, 1.0, False, True, False), (0.5, 1.0, False, False, None), (0.0, 3.5, False, False, None), (0.0, 1.0, True, False, None)]
    corners = [(-1.0, -1.0), (3.0, -1.0), (3.0, 3.0), (-1.0, 3.0)]
    tris = [(0, 0, 1, 2, 5), (1, 1, 3, 2, 5), (2, 4, 5, 6, 7), (3, 4, 6, 7, 7), (4, 4, 6, 7, 9)]
    v, t, pl, links, rays = [], [], [], [], []
    for k, (lean, gap, shared, crossed, _) in enumerate(cases):
        v += [(k, i, x, 0.0, gap + h) for i, (x, h) in enumerate(((0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (2.0, 2.0)))] + [(k, 4 + i, *p, 0.0) for i, p in enumerate(corners)]
        t += [(k, *x) for x in tris]
        pl += [(k, 5, 0.0, 1.0, lean, -lean * gap), (k, 7, 0.0, 0.0, 2.0, 0.0), (k, 9, 0.0, 1.0, 1.0, 0.0)]
        links += [(k, i, p) for i in (0, 1) for p in ((5, 8) if shared else (5,))]
        rays += [(k, i, 0.5 + i / 4, 1.0, 0.4, 0.5 + i / 4, -1.0, 0.4) for i in range(3) if crossed]
    make = lambda rows, cols: spark.createDataFrame(rows, "scene_id int, " + cols)
    scenes = range(len(cases))
    vertices = make(v, "vertex_id int, x double, y double, z double")
    cornered = mesh.corners(make(t, "triangle_id int, v0 int, v1 int, v2 int, polygon_id int"), vertices)
    planes = make(pl, "polygon_id int, a double, b double, c double, d double")
    classes = make([(k, *c) for k in scenes for c in ((5, 1), (7, 2), (9, 2))], "polygon_id int, class_id int")  # 9 is too steep for a floor
    lower = make([(k, 5, 0, 1) for k in scenes], "polygon_id int, e0 int, e1 int")
    targets = M.wall_targets(lower, vertices, cornered, planes, classes, 2, must_be_below=below).collect()
    assert {r.scene_id: r.target_id for r in targets} == {k: 7 if c[1] < 3 else -1 for k, c in enumerate(cases)}
    if below:
        return
    out = M.extend_walls(
        lower, vertices, planes, spark.createDataFrame(targets), make(rays, "ray_id int, ox double, oy double, oz double, ex double, ey double, ez double"),
        make([(k, 5, 1.0) for k in scenes], "polygon_id int, max_hits_per_area double"), assignments=make(links, "vertex_id int, plane_id int")).collect()
    assert {r.scene_id: r.accepted for r in out} == {k: c[4] for k, c in enumerate(cases) if c[4] is not None}
    assert {r.scene_id: r.area for r in out} == pytest.approx({0: 2.0, 1: 2 * 1.01**0.5})


def test_simplified_polygons_attach_vertices_to_the_edges_left(spark):
    at = {1: (0, 0, 0), 2: (0, 2, 0), 3: (2, 0, 0), 4: (0, 1, 2), 5: (0.004, 1, 0.003), 6: (1, 1, 1), 7: (-1, 1, 1), 8: (1, 1, 0), 9: (1.5, 0.5, 0.005), 11: (2, -1, 0), 12: (1.5, 1.5, 1), 13: (1.5, -0.5, 1)}
    on = {1: (1, 2), 2: (1, 2), 3: (1,), 4: (2,), 5: (3,), 6: (3,), 7: (3,), 8: (1,), 9: (4,), 11: (1,), 12: (4,), 13: (4,)}
    faces = [(1, 2, 8, 1), (1, 8, 3, 1), (1, 3, 11, 1), (1, 2, 4, 2), (5, 6, 7, 3), (9, 12, 13, 4)]
    vertices = spark.createDataFrame([(0, v, *map(float, p)) for v, p in at.items()], "scene_id int, vertex_id int, x double, y double, z double")
    triangles = spark.createDataFrame([(0, i, *f) for i, f in enumerate(faces)], "scene_id int, triangle_id int, v0 int, v1 int, v2 int, polygon_id int")
    links = spark.createDataFrame([(0, v, p) for v, ps in on.items() for p in ps], "scene_id int, vertex_id int, plane_id int")
    planes = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0, 0.0), (0, 2, 1.0, 0.0, 0.0, 0.0), (0, 3, 0.0, 1.0, 0.0, -1.0), (0, 4, 1.0, 0.0, 0.0, -1.5)], "scene_id int, plane_id int, a double, b double, c double, d double")
    moved, gained = M.simplify_polygons(vertices, triangles, links, planes)
    got = {r.vertex_id: r for r in moved.collect()}
    assert {v for v, r in got.items() if r.removed} == {8}
    # 5 lies on the edge of the first two polygons, 9 on the edge that is left where 8 is gone
    assert {r.vertex_id: r.joint for r in gained.collect()} == {5: [1, 2, 3], 9: [1, 4]}
    want = {**at, 5: (0, 1, 0), 9: (1.5, 0.5, 0)}
    assert all((r.x, r.y, r.z) == pytest.approx(want[v], abs=1e-7) for v, r in got.items())
    assert {v for v, r in got.items() if r.attached} == {5, 9}
