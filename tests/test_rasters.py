"""Floorplans, rooms, clusters and layouts on small scenes."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.functions.vectors import vec
from atrium.operators import cameras, clusters, layout, raster, sampling
from atrium.operators.rooms import polygon_elevation  # noqa: F401

LV = ["level_id"]
CELL = "level_id int, r int, c int"


def two_rooms(spark):
    rows = []
    for r in range(20):
        for c in range(41):
            gap = c == 20 and 5 <= r < 15
            free = c != 20 or gap
            rows.append((0, r, c, free, 0 if not free else (1 if c <= 20 else 2)))
    return spark.createDataFrame(rows, f"{CELL}, free boolean, label int")


def test_two_rooms_have_one_door(spark):
    (door,) = raster.opening_edges(two_rooms(spark), resolution=0.1).collect()
    assert (door.label_a, door.label_b, door.boundary_sample_count, door.kind) == (1, 2, 10, "door")
    assert door.width_meters == pytest.approx(0.9)


def test_two_rooms_are_segmented(spark):
    out = raster.segment_rooms(two_rooms(spark).drop("label"), resolution=0.1, widths=(1.5, 1.2))
    sizes = sorted(r["count"] for r in out.groupBy("label").count().collect())
    assert len(sizes) == 2 and sum(sizes) == 20 * 40 + 10
    sides = out.groupBy("label").agg(F.countDistinct(F.col("c") < 20).alias("n")).filter("n > 1").count()
    assert sides <= 1  # only the room that takes the gap's cells may touch both sides


def test_room_without_seed_falls_back_to_components(spark):
    cells = spark.createDataFrame([(0, r, c, c != 2) for r in range(2) for c in range(5)], f"{CELL}, free boolean")
    out = raster.segment_rooms(cells, resolution=0.1)
    assert sorted((r.label, r["count"]) for r in out.groupBy("label").count().collect()) == [(1, 4), (2, 4)]


def test_watershed_equals_flooding_by_best_path(spark):
    rng = np.random.default_rng(2)
    h = rng.permutation(12 * 12).reshape(12, 12).astype(float)
    marks = {(1, 1): 1, (10, 9): 2, (3, 10): 3}
    best, heap = {}, [(-h[p], m, p) for p, m in marks.items()]
    heapq.heapify(heap)
    while heap:  # widest path first
        key, m, (r, c) = heapq.heappop(heap)
        if (r, c) in best:
            continue
        best[r, c] = m
        for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= q[0] < 12 and 0 <= q[1] < 12 and q not in best:
                heapq.heappush(heap, (max(key, -h[q]), m, q))
    rows = [(0, r, c, float(h[r, c]), marks.get((r, c), 0)) for r in range(12) for c in range(12)]
    cells = spark.createDataFrame(rows, f"{CELL}, distance double, marker int")
    got = {(r.r, r.c): r.label for r in raster.watershed_flood(cells).collect()}
    width = lambda p, m: _widest(h, p, [q for q, k in marks.items() if k == m][0])
    for p, label in got.items():
        assert width(p, label) == max(width(p, m) for m in (1, 2, 3))


@pytest.mark.parametrize("seed", range(2))
def test_levels_of_any_size_give_the_same_rows(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    rows = [(level, r, c, float(rng.integers(0, 4)), int(rng.choice([0] * 30 + [1, 2, 3]))) for level in range(3) for r in range(9) for c in range(11) if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, f"{CELL}, distance double, marker int")
    found = {}
    for bound in (10**6, 0, 70):  # one task a level, rounds for all, either
        monkeypatch.setattr(raster, "LEVEL_CELLS", bound)
        found[bound] = [sorted(map(tuple, df.collect())) for df in (
            raster.watershed_flood(cells).select("level_id", "r", "c", "label"), raster.grid_components(cells).select("level_id", "r", "c", "component"))]
    assert found[0] == found[10**6] == found[70] and len(found[0][0]) == len(rows)
    labels = {r[:3]: r[3] for r in found[0][0]}
    assert all(labels[r[:3]] == r[4] for r in rows if r[4])


def test_empty_floorplans(spark):
    none = spark.createDataFrame([], f"{CELL}, distance double, marker int, free boolean")
    assert raster.watershed_flood(none).count() == 0 and raster.grid_components(none).count() == 0
    assert raster.segment_rooms(none.select("level_id", "r", "c", "free")).count() == 0


def _widest(h, src, dst):
    seen, heap = set(), [(-h[src], src)]
    while heap:
        key, p = heapq.heappop(heap)
        if p == dst:
            return -key
        if p in seen:
            continue
        seen.add(p)
        for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
            if 0 <= q[0] < h.shape[0] and 0 <= q[1] < h.shape[1] and q not in seen:
                heapq.heappush(heap, (max(key, -h[q]), q))


def test_distance_transform_counts_the_outside_as_background(spark):
    support = {(level, r, c) for level in (0, 1) for r in range(9) for c in range(12) if not (r > 5 and c > 7)}
    walls = {(0, 0, 0), (0, 4, 5)}  # level 1 has none
    cells = spark.createDataFrame([(*p, p not in walls) for p in support], f"{CELL}, free boolean")
    got = {(r.level_id, r.r, r.c): r.distance for r in raster.distance_transform(cells, resolution=1.0).collect()}
    outside = {(level, r, c) for level in (0, 1) for r in range(-1, 10) for c in range(-1, 13)} - support
    assert set(got) == support - walls
    for (level, r, c), d in got.items():
        assert d == pytest.approx(min(((r - y) ** 2 + (c - x) ** 2) ** 0.5 for at, y, x in outside | walls if at == level))


def test_room_triangles_conserve_area_and_meet_on_edges(spark):
    cells = spark.createDataFrame([(0, r, c, 1) for r in range(6) for c in range(6) if not (r > 2 and c > 3)], f"{CELL}, label int")
    tri = raster.run_triangles(raster.cell_runs(cells), resolution=1.0)
    area = tri.agg(F.sum(F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))) / 2)).first()[0]
    assert area == pytest.approx(cells.count())
    rooms = layout.room_triangles(cells, resolution=1.0)
    from atrium.operators import mesh

    rim = mesh.edge_uses(rooms, ["level_id", "label"]).filter("uses = 1").count()
    # rim of the L in pieces: cut at column 4 above and below, one piece per row left and right
    assert rim == 2 + 1 + 1 + 12


def test_step_ceiling(spark):
    planes = {0: -2.0, 1: -2.5}
    rows = [(0, 1, i, *v, i, 0.0, 0.0, 1.0, planes[i]) for i, v in enumerate([(0, 1, (1 << 24) + 1), (0, (1 << 24) + 1, 1 << 24)])]
    rooms = spark.createDataFrame(rows, "level_id int, label int, triangle_id bigint, v0 bigint, v1 bigint, v2 bigint, polygon_id int, a double, b double, c double, d double")
    edges = layout.room_edges(rooms, LV, "label", 1.0)
    walls = layout.ceiling_step_walls(edges, F.lit("room")).collect()
    assert len(walls) == 1 and {p.z for p in walls[0].vertices} == {2.0, 2.5}


def test_walls_and_lintel(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1)], f"{CELL}, label int")
    tri = layout.room_triangles(cells, resolution=2.0)
    rooms = tri.withColumns({"polygon_id": F.lit(5), "a": F.lit(0.0), "b": F.lit(0.0), "c": F.lit(1.0), "d": F.lit(-3.0)})
    edges = layout.room_edges(rooms, LV, "label", 2.0)
    openings = spark.createDataFrame([(0, 0, "opening_000", "door", ["room"], 0.5, 0.0, 1.4, 0.0)], "level_id int, edge_index int, edge_id string, kind string, room_ids array<string>, xa double, ya double, xb double, yb double")
    walls = layout.boundary_walls(edges, openings, F.lit("room"), 0.0).collect()
    assert len(walls) == 4
    (lintel,) = [w for w in walls if w.source_edge_id]
    assert min(p.z for p in lintel.vertices) == pytest.approx(2.1) and max(p.z for p in lintel.vertices) == 3.0


def test_pinhole(spark):
    frames = spark.createDataFrame([(0, 0, np.eye(4).tolist())], "scene_id int, frame_id int, c2w array<array<double>>")
    px = spark.createDataFrame([(0, 0, r, c, 2.0) for r in range(4) for c in range(4)], "scene_id int, frame_id int, pix_row int, pix_col int, depth double")
    ray = cameras.backproject_samples(px, frames, 2, 2, 2, 2).filter("pix_row = 0 AND pix_col = 0").first()
    assert (ray.x, ray.y, ray.z) == (-1.5, 1.5, -2.0)
    pt = cameras.unproject_depth(px, frames, 2, 2, 2, 2, stride=1).filter("pix_row = 0 AND pix_col = 0").first()
    assert (pt.x, pt.y, pt.z) == (-2.0, 2.0, -2.0)


def test_dbscan_with_crowded_place(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([np.full((60, 2), 1.0), rng.normal(2, 0.15, (60, 2)), rng.uniform(0, 6, (60, 2))])
    eps, k = 0.2, 5
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= k
    label = np.full(len(p), -1)
    number = 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], number
            while stack:
                j = stack.pop()
                for q in np.flatnonzero(near[j] & core & (label < 0)):
                    label[q] = number
                    stack.append(q)
            number += 1
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    rows = spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(p)], "wall_id int, point_id int, u double, z double")
    got = {r.point_id: (r.is_core, r.cluster) for r in clusters.dbscan(rows, ["wall_id"], "point_id", eps=eps, min_samples=k).collect()}
    assert got == {i: (bool(core[i]), int(label[i])) for i in range(len(p))}


def test_min_rectangle_of_turned_box(spark):
    t = 0.4
    rot = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    pts = np.random.default_rng(0).uniform(-1, 1, (300, 2)) * [3, 1]
    pts[:4] = [[-3, -1], [3, -1], [3, 1], [-3, 1]]
    rows = spark.createDataFrame([(1, *map(float, rot @ q)) for q in pts], "g int, x double, y double")
    assert clusters.min_rectangles(rows, ["g"], chunk=50).first().area == pytest.approx(12.0)


def test_hull_keeps_every_corner_and_nothing_else():
    rng = np.random.default_rng(5)
    for pts in (rng.normal(size=(400, 2)), rng.integers(0, 4, (60, 2)).astype(float), np.array([[0, 0], [1, 1], [2, 2], [3, 3.0]])):
        corners = {tuple(c) for c in clusters.hull(pts)}
        kinds = np.unique(pts, axis=0)
        outer = set()
        for p in kinds:
            away = kinds[(kinds != p).any(1)] - p
            angle = np.sort(np.arctan2(away[:, 1], away[:, 0]))
            if np.diff(np.r_[angle, angle[0] + 2 * np.pi]).max() > np.pi + 1e-9:  # the others lie within less than half a turn
                outer.add(tuple(p))
        assert corners == outer


def test_stair_regions_carry_number_area_and_rooms(spark):
    rows, tris = [], []
    for s, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)]):
        base = s * 100
        rows += [(0, base + 2 * i + j, x + i * 0.5, y + j * 1.0, i * 0.2) for i in range(6) for j in range(2)]
        steps = range(5 if s != 1 else 2)
        tris += [(0, base + 2 * i + h, *((base + 2 * i, base + 2 * i + 1, base + 2 * i + 2) if h == 0 else (base + 2 * i + 1, base + 2 * i + 3, base + 2 * i + 2)))
                 for i in steps for h in range(2)]
    vertices = spark.createDataFrame(rows, "scene_id int, vertex_id int, x double, y double, z double")
    triangles = spark.createDataFrame(tris, "scene_id int, triangle_id int, v0 int, v1 int, v2 int")
    rooms = spark.createDataFrame([(0, "a", 0.0, 0.0, 1.2, 1.0), (0, "b", 1.6, 0.0, 4.0, 1.0), (0, "c", 30.0, 0.0, 31.0, 1.0)], "scene_id int, room_id string, x0 double, y0 double, x1 double, y1 double")
    got = {r.component: r for r in clusters.stair_regions(triangles, vertices, ["scene_id"], rooms=rooms).collect()}
    assert {k: (r.status, r.stair_region_id, r.room_ids) for k, r in got.items()} == {
        0: ("accepted", "stair_region_000", ["a", "b"]), 100: ("rejected_too_few_triangles", None, None), 200: ("accepted", "stair_region_001", ["c"])}
    assert got[0].area == pytest.approx(2.5) and got[200].maximum_z == pytest.approx(1.0)


def test_cap_and_sample_are_exact(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 5))
    kept = sampling.cap_rows(df, 777, 3, ["id"])
    assert kept.count() == 777 == kept.distinct().count()
    sizes = sampling.sample_per_group(df, ["g"], 50, 1, ["id"]).groupBy("g").count().collect()
    assert all(r["count"] == 50 for r in sizes)
    with pytest.raises(ValueError):
        sampling.cap_rows(df, 10, 3, ["id"], at_least=10_000)


def test_surface_samples_follow_area(spark):
    tri = spark.createDataFrame([(0, 0, 0., 0., 0., 1., 0., 0., 0., 1., 0.), (0, 1, 0., 0., 1., 3., 0., 1., 0., 3., 1.)],
                                "scene_id int, triangle_id int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    got = {r.triangle_id: r["count"] for r in sampling.sample_mesh_surface(tri, 100.0, 1).groupBy("triangle_id").count().collect()}
    assert got == {0: 50, 1: 450}
    assert vec("a") is not None


def test_overlapping_fills_add_up(spark):
    ring = [(0.0, 0.0), (0.6, 0.0), (0.6, 0.6), (0.0, 0.6)]
    rows = [(0, p, *ring[i], *ring[(i + 1) % 4]) for p in (1, 2) for i in range(4)]
    fills = spark.createDataFrame(rows, "level_id int, polygon_id int, x0 double, y0 double, x1 double, y1 double")
    line = spark.createDataFrame([(0, 0.0, 0.0, 0.6, 0.0)], "level_id int, x0 double, y0 double, x1 double, y1 double")
    twice = {(r.r, r.c) for r in raster.rasterize_walls(line, fills).collect()}
    once = {(r.r, r.c) for r in raster.rasterize_walls(line, fills.filter("polygon_id = 1")).collect()}
    assert twice == once and (6, 6) in twice
