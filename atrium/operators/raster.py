"""Floorplan rasters as sparse cell tables ``(keys, r, c, ...)``."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.functions.vectors import Vec, segment_distance2
from atrium.operators import graphs
from atrium.operators.grids import RESOLUTION
from atrium.operators.ranking import dense_index, top_k
from atrium.session import end_round as cut_lineage

LEVEL = ("level_id",)

# Wall drawing and room segmentation parameters in metres and square metres.
WALL_WIDTH = 0.12
BLUR_SIGMA, BLUR_RADIUS, WALL_SHARE = 1.0, 2, 0.25
BOTTLENECKS = (2.5, 1.5)
MIN_SEED_AREA, MIN_ROOM_AREA = 0.5, 1.0

LEVEL_CELLS = 1_000_000  # cells of a level that one task labels or floods; larger levels take the way in rounds
ROWS_AT_ONCE = 32
DOOR_MAX_WIDTH = 1.5


def rasterize_polygons(edges: DataFrame, keys: Sequence[str], resolution: float = RESOLUTION, origin=(0.0, 0.0)) -> DataFrame:
    """Cells whose centre lies strictly inside a polygon given by its edge rows ``x0, y0, x1, y1``.

    Scan lines: each edge is spread over the cell rows it crosses, crossings of one row are paired
    from left to right (even-odd rule), and each pair becomes a run of columns.
    """
    ox, oy = map(float, origin)
    row_of = lambda y: (y - F.lit(oy)) / resolution - 0.5  # row whose centre is at y
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(row_of(lo)), F.ceil(row_of(hi)) - 1  # half open: lo <= centre < hi
    slanted = edges.filter("y0 <> y1").withColumns({"_a": first, "_b": last}).filter("_a <= _b")
    crossing = slanted.select(*keys, "x0", "y0", "x1", "y1", F.explode(F.sequence("_a", "_b")).alias("r")).withColumn(
        "_x", (F.col("x1") - F.col("x0")) * ((F.col("r") + 0.5) * resolution + F.lit(oy) - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    w = W.partitionBy(*keys, "r").orderBy("_x")
    paired = crossing.select(*keys, "r", "_x", F.lead("_x").over(w).alias("_end"), F.row_number().over(w).alias("_n")).filter("_n % 2 = 1 AND _end IS NOT NULL")
    col_of = lambda x: (x - F.lit(ox)) / resolution - 0.5
    spans = paired.withColumns({"_a": F.floor(col_of(F.col("_x"))) + 1, "_b": F.ceil(col_of(F.col("_end"))) - 1}).filter("_a <= _b")
    cells = spans.select(*keys, F.col("r"), F.explode(F.sequence("_a", "_b")).alias("c")).distinct()
    # centres on a horizontal edge are on the boundary, hence not strictly inside
    flat = edges.filter("y0 = y1").withColumn("_r", row_of(F.col("y0"))).filter("_r = floor(_r)").withColumns(
        {"_a": F.ceil(col_of(F.least("x0", "x1"))), "_b": F.floor(col_of(F.greatest("x0", "x1")))}).filter("_a <= _b")
    on_edge = flat.select(*keys, F.floor("_r").alias("r"), F.explode(F.sequence("_a", "_b")).alias("c"))
    return cells.join(on_edge, [*keys, "r", "c"], "left_anti")


def covered_area(cells: DataFrame, keys: Sequence[str], resolution: float = RESOLUTION, min_area: float = 0.0) -> DataFrame:
    """Area of the union of cell sets per key."""
    out = cells.select(*keys, "r", "c").distinct().groupBy(*keys).agg(
        F.count("*").alias("n_cells"), (F.count("*") * F.lit(resolution**2)).alias("area"))
    return out.filter(F.col("area") >= min_area) if min_area else out


def draw_segments(segments: DataFrame, keys: Sequence[str], half_width: float, resolution: float = RESOLUTION, origin=(0.0, 0.0)) -> DataFrame:
    """Cells whose centre is within ``half_width`` of a segment ``x0, y0, x1, y1``.

    Per cell row only the stretch of the segment near that row is expanded, so a long slanted
    segment costs its length, not the area of its bounding box.
    """
    ox, oy = map(float, origin)
    low, high = F.least("y0", "y1") - half_width, F.greatest("y0", "y1") + half_width
    first, last = F.ceil((low - oy) / resolution - 0.5 - 1e-9), F.floor((high - oy) / resolution - 0.5 + 1e-9)  # rows at the very edge stay
    rows = F.sequence(first, last)
    per_row = segments.filter(first <= last).select(*keys, "x0", "y0", "x1", "y1", F.explode(rows).alias("r"))
    y = (F.col("r") + 0.5) * resolution + oy
    dy = F.col("y1") - F.col("y0")
    at = lambda level: F.when(F.abs(dy) < 1e-12, None).otherwise((level - F.col("y0")) / dy)
    t1, t2 = at(y - half_width), at(y + half_width)
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    level = F.abs(dy) < 1e-12  # a horizontal segment is near the row along its whole length
    ta, tb = F.when(level, 0.0).otherwise(clip(F.least(t1, t2))), F.when(level, 1.0).otherwise(clip(F.greatest(t1, t2)))
    xa, xb = (F.col("x0") + (F.col("x1") - F.col("x0")) * t for t in (ta, tb))
    near = per_row.withColumns({
        "_a": F.floor((F.least(xa, xb) - half_width - ox) / resolution - 0.5),
        "_b": F.ceil((F.greatest(xa, xb) + half_width - ox) / resolution - 0.5)})
    cells = near.select(*keys, "x0", "y0", "x1", "y1", "r", F.explode(F.sequence("_a", "_b")).alias("c"))
    zero = F.lit(0.0)
    center = Vec((F.col("c") + 0.5) * resolution + ox, (F.col("r") + 0.5) * resolution + oy, zero)
    d2 = segment_distance2(center, Vec(F.col("x0"), F.col("y0"), zero), Vec(F.col("x1"), F.col("y1"), zero), 1e-18)
    return cells.filter(d2 <= half_width**2 + 1e-12).select(*keys, "r", "c").distinct()


CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def shifted(cells: DataFrame, keys: Sequence[str], offsets, extra: Sequence[str] = ()) -> DataFrame:
    """Each cell repeated at the given (dr, dc) offsets."""
    steps = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets))
    return cells.select(*keys, "r", "c", *extra, F.explode(steps).alias("o")).select(
        *keys, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), *extra)


def smooth_walls(cells: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    """Gaussian 5x5 blur of the drawn cells, threshold at a quarter of the level's peak, then closing."""
    raw = [math.exp(-(d * d) / (2 * BLUR_SIGMA**2)) for d in range(-BLUR_RADIUS, BLUR_RADIUS + 1)]
    kernel = [k / sum(raw) for k in raw]
    span = range(-BLUR_RADIUS, BLUR_RADIUS + 1)
    # two one-dimensional passes: 5 + 5 copies of a cell instead of 25
    def blur(df, axis):
        steps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(k).alias("k")) for d, k in zip(span, kernel)))
        moved = df.select(*keys, "r", "c", "v", F.explode(steps).alias("o"))
        at = {a: F.col(a) + F.col("o.d") if a == axis else F.col(a) for a in ("r", "c")}
        return moved.groupBy(*keys, at["r"].alias("r"), at["c"].alias("c")).agg(F.sum(F.col("v") * F.col("o.k")).alias("v"))
    blurred = blur(blur(cells.select(*keys, "r", "c").distinct().withColumn("v", F.lit(1.0)), "c"), "r")
    peak = blurred.groupBy(*keys).agg(F.max("v").alias("peak"))
    walls = blurred.join(peak, list(keys)).filter(F.col("v") > F.lit(WALL_SHARE) * F.col("peak") + 1e-12).select(*keys, "r", "c")
    return close_cross(walls, keys)


def close_cross(cells: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    """Morphological closing with the 3x3 cross."""
    grown = shifted(cells, keys, CROSS).distinct()
    return shifted(grown, keys, CROSS).groupBy(*keys, "r", "c").agg(F.count("*").alias("n")).filter("n = 5").drop("n")


def rasterize_walls(segments: DataFrame, fills: DataFrame | None, keys: Sequence[str] = LEVEL, width: float = WALL_WIDTH,
                    resolution: float = RESOLUTION, origin=(0.0, 0.0)) -> DataFrame:
    """Wall cells of the outlines ``segments`` and the filled polygons' edges ``fills``.

    Each polygon (and triangle) of ``fills`` is filled on its own, so overlapping ones add up.
    """
    thick = max(1, round(width / resolution)) * resolution / 2
    drawn = draw_segments(segments, keys, thick, resolution, origin)
    if fills is not None:
        own = [c for c in ("polygon_id", "triangle_id") if c in fills.columns]
        filled = rasterize_polygons(fills, [*keys, *own], resolution, origin)
        drawn = drawn.unionByName(filled.select(*drawn.columns)).distinct()
    return smooth_walls(drawn, keys)


def cell_difference(support: DataFrame, walls: DataFrame, keys: Sequence[str] = LEVEL) -> tuple[DataFrame, DataFrame]:
    """Free cells (support without walls) and walls on the support."""
    on = [*keys, "r", "c"]
    return support.join(walls, on, "left_anti"), walls.join(support, on, "left_semi")


def grid_neighbors(cells: DataFrame, keys: Sequence[str] = LEVEL, label: str = "label") -> DataFrame:
    """4-neighbour pairs with different positive labels, with the midpoint of the common side."""
    base = cells.filter(F.col(label) > 0).select(*keys, "r", "c", F.col(label).alias("la"))
    steps = F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))
    probe = base.select("*", F.explode(steps).alias("o")).select(
        *keys, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "la", F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"))
    both = probe.join(base.withColumnRenamed("la", "lb"), [*keys, "r", "c"]).filter("la <> lb")
    return both.select(*keys, F.least("la", "lb").alias("label_a"), F.greatest("la", "lb").alias("label_b"),
                       (F.col("r") - F.col("dr") / 2).alias("mr"), (F.col("c") - F.col("dc") / 2).alias("mc"))


def opening_edges(cells: DataFrame, keys: Sequence[str] = LEVEL, label: str = "label", resolution: float = RESOLUTION,
                  origin=(0.0, 0.0), door_max: float = DOOR_MAX_WIDTH, known: DataFrame | None = None) -> DataFrame:
    """One opening per pair of adjacent rooms: main axis, end points, width and kind.

    The axis is that of the largest spread of the boundary midpoints, in closed form from their
    covariance.  Pairs are numbered in label order before pairs of unknown rooms are dropped.
    """
    ox, oy = map(float, origin)
    pts = grid_neighbors(cells, keys, label).select(
        *keys, "label_a", "label_b",
        ((F.col("mc") + 0.5) * resolution + ox).alias("x"), ((F.col("mr") + 0.5) * resolution + oy).alias("y"))
    pair = [*keys, "label_a", "label_b"]
    # count per distinct offset keeps the sums exact enough: coordinates are few and small
    m = pts.groupBy(*pair).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
                               F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"))
    theta = F.lit(0.5) * F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy"))
    m = m.withColumn("_t", theta).withColumns({"ux": F.cos("_t"), "uy": F.sin("_t")}).drop("_t")
    along = (F.col("x") - F.col("mx")) * F.col("ux") + (F.col("y") - F.col("my")) * F.col("uy")
    ext = pts.join(m, pair).groupBy(*pair).agg(
        F.min(along).alias("lo"), F.max(along).alias("hi"), *(F.first(c).alias(c) for c in ("n", "mx", "my", "ux", "uy")))
    w = W.partitionBy(*keys).orderBy("label_a", "label_b")  # one row per pair of adjacent rooms
    numbered = ext.withColumn("edge_index", F.row_number().over(w) - 1)
    if known is not None:
        for side in ("label_a", "label_b"):
            numbered = numbered.join(known.select(*keys, F.col(label).alias(side)), [*keys, side], "left_semi")
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(resolution))
    end = lambda t: (F.col("mx") + F.col("ux") * F.col(t), F.col("my") + F.col("uy") * F.col(t))
    (xa, ya), (xb, yb) = end("lo"), end("hi")
    return numbered.select(
        *pair, F.format_string("opening_%03d", F.col("edge_index")).alias("edge_id"), "edge_index",
        F.when(width < door_max, "door").otherwise("opening").alias("kind"), width.alias("width_meters"),
        F.col("n").alias("boundary_sample_count"), xa.alias("xa"), ya.alias("ya"), xb.alias("xb"), yb.alias("yb"))


def distance_transform(cells: DataFrame, keys: Sequence[str] = LEVEL, free: str = "free", resolution: float = RESOLUTION) -> DataFrame:
    """Exact Euclidean distance in metres of each free cell to the nearest cell that is not free.

    What lies outside the table is not free: a ring of cells around the support stands for it.  First
    the gap within the column, then the lower envelope of the row's parabolas, one pass over a row.
    """
    around = F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)))
    ring = cells.select(*keys, around.alias("o")).select(*keys, "o.r", "o.c").distinct().join(cells, [*keys, "r", "c"], "left_anti")
    cells = cells.select(*keys, "r", "c", F.coalesce(F.col(free), F.lit(False)).alias(free)).unionByName(ring.withColumn(free, F.lit(False)))
    wall_row = F.when(~F.col(free), F.col("r"))
    up = W.partitionBy(*keys, "c").orderBy("r").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy(*keys, "c").orderBy("r").rowsBetween(W.currentRow, W.unboundedFollowing)
    gap = F.least(F.col("r") - F.last(wall_row, ignorenulls=True).over(up), F.first(wall_row, ignorenulls=True).over(down) - F.col("r"))
    kinds = dict(cells.dtypes)
    col = cells.select(*keys, "r", "c", free, gap.cast("bigint").alias("g"), F.floor(F.col("r") / ROWS_AT_ONCE).alias("_band"))
    made = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "r", "c")) + ", distance double"

    def envelopes(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["r", "c"])
        far = [d for _, row in rows.groupby("r", sort=True) for d in row_distances(row["c"].tolist(), row["g"].tolist())]
        rows["distance"] = np.sqrt(np.array(far, float)) * resolution
        return rows.loc[rows[free].astype(bool), [*keys, "r", "c", "distance"]]

    # a band of rows is as wide as the grid and ROWS_AT_ONCE high, so a task's share is bounded by the grid's width
    return col.filter("g IS NOT NULL").groupBy(*keys, "_band").applyInPandas(envelopes, made)


def row_distances(columns: list[int], gaps: list[int]) -> list[int]:
    """Squared distance at each column to the nearest background, from the gaps within the columns."""
    hull, starts = [], []
    for c, g in zip(columns, gaps):
        while hull:
            c0, g0 = hull[-1]
            cross = (g * g + c * c - g0 * g0 - c0 * c0) / (2 * (c - c0))
            if cross > starts[-1]:
                break
            hull.pop()
            starts.pop()
        starts.append(cross if hull else -math.inf)
        hull.append((c, g))
    out, at = [], 0
    for c in columns:
        while at + 1 < len(hull) and starts[at + 1] <= c:
            at += 1
        out.append((c - hull[at][0]) ** 2 + hull[at][1] ** 2)
    return out


def cell_runs(cells: DataFrame, keys: Sequence[str] = LEVEL, label: str = "label") -> DataFrame:
    """Maximal horizontal runs of equal positive labels: ``(keys, r, label, c0, c1)``."""
    base = cells.filter(F.col(label) > 0).select(*keys, "r", "c", label)
    w = W.partitionBy(*keys, "r", label).orderBy("c")
    island = base.withColumn("_i", F.col("c") - F.row_number().over(w))
    return island.groupBy(*keys, "r", label, "_i").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("_i")


def run_triangles(runs: DataFrame, keys: Sequence[str] = LEVEL, label: str = "label", resolution: float = RESOLUTION, origin=(0.0, 0.0)) -> DataFrame:
    """Two triangles per run, with runs cut so that triangles of one room meet along whole edges.

    Every column where some run of the room starts or ends cuts the room's other runs as well.
    """
    ox, oy = map(float, origin)
    room = [*keys, label]
    cuts = runs.select(*room, F.explode(F.array(F.col("c0"), F.col("c1") + 1)).alias("cut")).distinct()
    indexed = dense_index(cuts, "cut", "k", room)
    at = lambda c, n: indexed.select(*room, F.col("cut").alias(c), F.col("k").alias(n))
    spans = runs.withColumn("c1", F.col("c1") + 1).join(at("c0", "k0"), [*room, "c0"]).join(at("c1", "k1"), [*room, "c1"])
    pieces = spans.select(*room, "r", F.explode(F.sequence(F.col("k0"), F.col("k1") - 1)).alias("k"))
    left = indexed.select(*room, "k", F.col("cut").alias("ca"))
    right = indexed.select(*room, (F.col("k") - 1).alias("k"), F.col("cut").alias("cb"))
    quads = pieces.join(left, [*room, "k"]).join(right, [*room, "k"])
    x0, x1 = F.col("ca") * resolution + ox, F.col("cb") * resolution + ox
    y0, y1 = F.col("r") * resolution + oy, (F.col("r") + 1) * resolution + oy
    tri = lambda half, *p: F.struct(F.lit(half).alias("half"), *(c.alias(n) for n, c in zip(("ax", "ay", "bx", "by", "cx", "cy"), p)))
    both = F.array(tri(0, x0, y0, x1, y0, x1, y1), tri(1, x0, y0, x1, y1, x0, y1))
    return quads.select(*room, "r", "ca", "cb", F.explode(both).alias("t")).select(*room, "r", "ca", "cb", "t.*")


def grid_components(cells: DataFrame, keys: Sequence[str] = LEVEL, out: str = "component") -> DataFrame:
    """4-connected components of a cell set; the id is the smallest ``r * 2**32 + c`` of its cells.

    A level of at most ``LEVEL_CELLS`` cells is labelled by one task.  In larger ones cells are first
    merged into runs, so the graph has one node per run, and components are found in rounds.
    """
    kinds = dict(cells.dtypes)
    made = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "r", "c")) + f", {out} bigint"

    def label(level: pd.DataFrame) -> pd.DataFrame:
        return level.assign(**{out: label_level(level["r"].to_numpy(), level["c"].to_numpy())})

    return _by_size(cells.select(*keys, "r", "c"), keys, label, made, lambda large: _components_in_rounds(large, keys, out))


def _by_size(cells: DataFrame, keys: Sequence[str], local, schema: str, rounds) -> DataFrame:
    """``local`` on each level that one task can hold, ``rounds`` on the others; both give the same rows."""
    sizes = cut_lineage(cells.groupBy(*keys).agg(F.count("*").alias("_n")))
    cells = cut_lineage(cells)
    small = cells.join(sizes.filter(F.col("_n") <= LEVEL_CELLS).drop("_n"), list(keys), "left_semi").groupBy(*keys).applyInPandas(local, schema)
    large = sizes.filter(F.col("_n") > LEVEL_CELLS).drop("_n")
    if large.isEmpty():
        return small
    return small.unionByName(rounds(cells.join(large, list(keys), "left_semi")))


def _cell_ids(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (r.astype(np.int64) << 32) + c.astype(np.int64)


def _cell_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of 4-neighbours in sorted cell ids; the first of each pair has the smaller id."""
    pairs = []
    for step in (1, 1 << 32):  # ids of one row are far apart from those of the next, so no pair wraps around
        at = np.minimum(np.searchsorted(ids, ids + step), len(ids) - 1)
        met = np.flatnonzero(ids[at] == ids + step)
        pairs.append((met, at[met]))
    return tuple(np.concatenate(side) for side in zip(*pairs))


def label_level(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Component of each cell of one level, by repeated minima and pointer jumping."""
    order = np.argsort(_cell_ids(r, c), kind="stable")
    ids = _cell_ids(r, c)[order]
    a, b = _cell_pairs(ids)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (root[a], root[b]):
            np.minimum.at(root, side, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    out = np.empty(len(ids), np.int64)
    out[order] = ids[root]
    return out


def _components_in_rounds(cells: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    w = W.partitionBy(*keys, "r").orderBy("c")
    at = cells.select(*keys, "r", "c").withColumn("_i", F.col("c") - F.row_number().over(w))
    first = F.min("c").over(W.partitionBy(*keys, "r", "_i"))
    run = (F.col("r").cast("bigint") * F.lit(1 << 32) + first.cast("bigint")).alias("run")
    tagged = cut_lineage(at.select(*keys, "r", "c", run))
    below = tagged.select(*keys, (F.col("r") + 1).alias("r"), "c", F.col("run").alias("run2"))
    links = tagged.join(below, [*keys, "r", "c"]).select(*keys, "run", "run2").distinct()
    comp = graphs.connected_components(links, tagged.select(*keys, "run").distinct(), keys, "run", "run", "run2", out)
    return tagged.join(comp, [*keys, "run"]).drop("run")


def watershed_flood(cells: DataFrame, keys: Sequence[str] = LEVEL, height: str = "distance", marker: str = "marker") -> DataFrame:
    """Grow positive markers over the cells in decreasing height.

    A cell belongs to the marker it reaches by the path whose lowest cell is highest, which is the
    cut of a maximum spanning forest rooted at the markers; of equal passes the one with the smallest
    cell pair comes first.  A level of at most ``LEVEL_CELLS`` cells is flooded by one task.  In
    larger ones basins without a marker repeatedly join the neighbour across their highest pass, so
    their number at least halves per round.  Cells cut off from all markers keep 0.
    """
    kinds = dict(cells.dtypes)
    made = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "r", "c", height)) + ", label bigint"
    rows = cells.select(*keys, "r", "c", height, F.coalesce(F.col(marker), F.lit(0)).cast("bigint").alias(marker))

    def flood(level: pd.DataFrame) -> pd.DataFrame:
        label = flood_level(*(level[x].to_numpy() for x in ("r", "c", height, marker)))
        return level.drop(columns=marker).assign(label=label)

    return _by_size(rows, keys, flood, made, lambda large: _flood_in_rounds(large, keys, height, marker))


def flood_level(r: np.ndarray, c: np.ndarray, height: np.ndarray, marker: np.ndarray) -> np.ndarray:
    """Label of each cell of one level: passes from the highest down, joining what has no marker yet."""
    order = np.argsort(_cell_ids(r, c), kind="stable")
    ids = _cell_ids(r, c)[order]
    a, b = _cell_pairs(ids)
    by = np.lexsort((b, a, -np.minimum(height[order][a], height[order][b])))  # places are in the order of ids
    label = marker[order].tolist()
    parent = list(range(len(ids)))
    first: dict[int, int] = {}
    for i in np.flatnonzero(marker[order] > 0).tolist():
        parent[i] = first.setdefault(label[i], i)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a[by].tolist(), b[by].tolist()):
        i, j = root(i), root(j)
        if i != j and not (label[i] > 0 and label[j] > 0):
            if label[j] > 0:
                i, j = j, i
            parent[j] = i
    out = np.empty(len(ids), np.int64)
    out[order] = [max(label[root(i)], 0) for i in range(len(ids))]
    return out


def _flood_in_rounds(cells: DataFrame, keys: Sequence[str], height: str, marker: str) -> DataFrame:
    ident = F.col("r").cast("bigint") * F.lit(1 << 32) + F.col("c").cast("bigint")
    base = cut_lineage(cells.select(*keys, "r", "c", ident.alias("id"), F.col(height).alias("h"), F.coalesce(F.col(marker), F.lit(0)).cast("bigint").alias("m")))
    right = base.select(*keys, F.col("r"), F.col("c"), F.col("id").alias("a"), F.col("h").alias("ha"))
    steps = F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))
    probe = base.select(*keys, F.col("id").alias("b"), F.col("h").alias("hb"), "r", "c", F.explode(steps).alias("o")).select(
        *keys, "b", "hb", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    passes = probe.join(right, [*keys, "r", "c"]).select(*keys, F.col("a"), F.col("b"), F.least("ha", "hb").alias("h"),
                                                         F.least("a", "b").alias("t0"), F.greatest("a", "b").alias("t1"))
    # basins: marked cells use -marker, others their cell id
    basin = base.select(*keys, F.col("id"), F.when(F.col("m") > 0, -F.col("m")).otherwise(F.col("id")).alias("basin"))
    passes = passes.join(basin.withColumnRenamed("id", "a").withColumnRenamed("basin", "pa"), [*keys, "a"]).join(
        basin.withColumnRenamed("id", "b").withColumnRenamed("basin", "pb"), [*keys, "b"])
    passes = cut_lineage(passes.filter("pa <> pb AND (pa >= 0 OR pb >= 0)").select(*keys, "pa", "pb", "h", "t0", "t1"))
    basin = cut_lineage(basin)
    merges = []
    while not passes.isEmpty():
        both = passes.select(*keys, F.explode(F.array(F.struct("pa", "pb"), F.struct(F.col("pb").alias("pa"), F.col("pa").alias("pb")))).alias("e"), "h", "t0", "t1")
        rank = F.struct(F.col("h"), (-F.col("t0")).alias("t0"), (-F.col("t1")).alias("t1"), F.col("e.pb").alias("to"))
        hook = both.filter("e.pa >= 0").groupBy(*keys, F.col("e.pa").alias("p")).agg(F.max(rank).alias("k")).select(*keys, "p", F.col("k.to").alias("to"))
        # two basins that chose each other: the smaller one becomes the root
        back = hook.select(*keys, F.col("p").alias("to"), F.col("to").alias("p2"))
        ptr = hook.join(back, [*keys, "to"], "left").select(*keys, "p", F.when((F.col("p2") == F.col("p")) & (F.col("p") < F.col("to")), F.col("p")).otherwise(F.col("to")).alias("to"))
        ptr = cut_lineage(ptr)
        while True:  # pointer jumping to the root of each tree of choices, two jumps per round
            for _ in range(2):
                up = ptr.select(*keys, F.col("p").alias("to"), F.col("to").alias("up"))
                ptr = ptr.join(up, [*keys, "to"], "left").select(*keys, "p", F.coalesce("up", "to").alias("to"), (F.coalesce("up", "to") != F.col("to")).alias("moved"))
            ptr = cut_lineage(ptr)
            if ptr.filter("moved").isEmpty():
                break
        ptr = ptr.drop("moved")
        merges.append(ptr)
        for side in ("pa", "pb"):
            passes = passes.join(ptr.select(*keys, F.col("p").alias(side), F.col("to").alias("_to")), [*keys, side], "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        pair = [*keys, F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb")]
        best = F.max(F.struct(F.col("h"), (-F.col("t0")).alias("t0"), (-F.col("t1")).alias("t1"))).alias("k")
        passes = passes.filter("pa <> pb AND (pa >= 0 OR pb >= 0)").groupBy(*pair).agg(best)
        passes = cut_lineage(passes.select(*keys, "pa", "pb", "k.h", (-F.col("k.t0")).alias("t0"), (-F.col("k.t1")).alias("t1")))
    for ptr in merges:
        basin = basin.join(ptr.select(*keys, F.col("p").alias("basin"), "to"), [*keys, "basin"], "left").select(*keys, "id", F.coalesce("to", "basin").alias("basin"))
    joined = base.join(basin, [*keys, "id"])
    return joined.select(*keys, "r", "c", F.col("h").alias(height), F.when(F.col("basin") < 0, -F.col("basin")).otherwise(0).alias("label"))


def segment_rooms(cells: DataFrame, keys: Sequence[str] = LEVEL, resolution: float = RESOLUTION, widths=BOTTLENECKS,
                  min_seed_area: float = MIN_SEED_AREA, min_room_area: float = MIN_ROOM_AREA) -> DataFrame:
    """Room label per free cell: seeds wider than a bottleneck at two scales, then a watershed.

    A component of a scale that touches no marker becomes one, one that touches a single marker
    extends it, others are ignored.  Rooms below the minimum area are dropped and the rest is
    renumbered; a level without seeds falls back to its connected components.
    """
    dist = cut_lineage(distance_transform(cells, keys, resolution=resolution))
    min_seed = max(1, math.ceil(min_seed_area / resolution**2 - 1e-9))
    min_room = max(1, math.ceil(min_room_area / resolution**2 - 1e-9))
    on = [*keys, "r", "c"]
    markers = None
    for width in widths:
        comp = grid_components(dist.filter(F.col("distance") >= width / 2.0), keys)
        if markers is None:
            joined = comp.withColumn("marker", F.lit(None).cast("bigint"))
        else:
            joined = comp.join(markers, on, "left")
        stats = joined.groupBy(*keys, "component").agg(
            F.count("*").alias("n"), F.min("marker").alias("lo"), F.max("marker").alias("hi")).filter(F.col("n") >= min_seed)
        new = stats.filter("lo IS NULL").select(*keys, "component")
        base = F.lit(0) if markers is None else F.coalesce(F.col("_base"), F.lit(0))
        numbered = dense_index(new, "component", "k", keys, bits=64)
        if markers is not None:
            top = markers.groupBy(*keys).agg(F.max("marker").alias("_base"))
            numbered = numbered.join(top, list(keys), "left")
        numbered = numbered.select(*keys, "component", (F.col("k") + 1 + base).cast("bigint").alias("marker"))
        extended = stats.filter("lo = hi").select(*keys, "component", F.col("lo").alias("marker"))
        painted = joined.drop("marker").join(numbered.unionByName(extended), [*keys, "component"]).select(*on, "marker")
        markers = cut_lineage(painted if markers is None else painted.unionByName(markers.join(painted, on, "left_anti")))
    seeded = dist.join(markers, on, "left")
    labels = watershed_flood(seeded, keys)
    sizes = labels.filter("label > 0").groupBy(*keys, "label").agg(F.count("*").alias("n"))
    kept = dense_index(sizes.filter(F.col("n") >= min_room), "label", "k", keys).select(*keys, "label", (F.col("k") + 1).alias("room_label"))
    with_seeds = markers.select(*keys).distinct()
    with_rooms = kept.select(*keys).distinct()
    rooms = labels.join(kept, [*keys, "label"], "left").select(*on, "distance", F.coalesce("room_label", F.lit(0)).alias("label"))
    rooms = rooms.join(with_rooms.withColumn("_any", F.lit(1)), list(keys), "left").withColumn(
        "label", F.when(F.col("_any").isNull(), 1).otherwise(F.col("label"))).drop("_any")
    rooms = rooms.join(with_seeds, list(keys), "left_semi")
    bare = dist.join(with_seeds, list(keys), "left_anti")
    fallback = grid_components(bare, keys)
    number = dense_index(fallback, "component", "k", keys, bits=64)
    fallback = fallback.join(number, [*keys, "component"]).join(dist, on).select(*on, "distance", (F.col("k") + 1).alias("label"))
    return rooms.unionByName(fallback)


def room_stats(cells: DataFrame, keys: Sequence[str] = LEVEL, resolution: float = RESOLUTION, origin=(0.0, 0.0)) -> DataFrame:
    ox, oy = map(float, origin)
    return cells.filter("label > 0").groupBy(*keys, "label").agg(
        F.count("*").alias("n_cells"), (F.count("*") * F.lit(resolution**2)).alias("area"),
        ((F.avg("c") + 0.5) * resolution + ox).alias("x"), ((F.avg("r") + 0.5) * resolution + oy).alias("y"))


def room_boundary(cells: DataFrame, keys: Sequence[str] = LEVEL, label: str = "label") -> DataFrame:
    """Sides between a room's cells and anything else, as edges between grid corners.

    Corners are numbered ``r * 2**24 + c``; feed the rows to ``trace_faces`` for rings.
    """
    base = cells.filter(F.col(label) > 0).select(*keys, label, "r", "c")
    corner = lambda r, c: (r.cast("bigint") * F.lit(1 << 24) + c.cast("bigint"))
    r, c = F.col("r"), F.col("c")
    side = lambda a, b: F.struct(F.least(a, b).alias("e0"), F.greatest(a, b).alias("e1"))
    p00, p01, p10, p11 = corner(r, c), corner(r, c + 1), corner(r + 1, c), corner(r + 1, c + 1)
    sides = base.select(*keys, label, F.explode(F.array(side(p00, p01), side(p10, p11), side(p00, p10), side(p01, p11))).alias("s"))
    return sides.groupBy(*keys, label, F.col("s.e0").alias("e0"), F.col("s.e1").alias("e1")).agg(F.count("*").alias("n")).filter("n = 1").drop("n")


def floorplan_stats(cells: DataFrame, keys: Sequence[str] = LEVEL) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.count("*").alias("support"), F.count_if("free").alias("free"), F.count_if(~F.col("free")).alias("walls"),
        (F.max("r") - F.min("r") + 1).alias("n_rows"), (F.max("c") - F.min("c") + 1).alias("n_cols"))
