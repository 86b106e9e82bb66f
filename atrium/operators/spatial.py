"""Exact nearest, range and ray joins on a linear octree of bounding boxes, as equi joins and aggregates.

Targets (points, segments, triangles, boxes) get the Morton code of their centre within their own
scene's cube; a cell is cut into 4x4x4 while it holds more than a set number of distinct targets,
so each scene has its own edge lengths and only crowded cells are cut further.  Queries are grouped
into cells as well, and each group walks down the tree: one join on the parent cell per level, then
nodes that cannot hold an answer are dropped by comparing box distances.  A leaf above the deepest
level goes on as its own child.  What is left per group is a short list of leaf cells, which every
query of the group scans.  Nothing depends on a search radius, so results are exact for empty and
for crowded regions.

Crowding is handled where it arises: copies of one geometry collapse to the k lowest ids before
the tree is built, a crowded region gets deeper leaves, and a crowded query group only widens a
join on the group key, which adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.functions.eigen import moment_sums, planes_from_moments
from atrium.functions.vectors import Vec, named, segment_distance2, segment_share, vec, vec_of
from atrium.operators.ranking import top_k
from atrium.session import cut_lineage

STEP = 2  # bits per axis and level: 4 x 4 x 4 children
DEPTH = 10  # levels below the root
LOW, HIGH = ("lx", "ly", "lz"), ("hx", "hy", "hz")
GROUP = ("gx", "gy", "gz")
PLACE = ("_ox", "_oy", "_oz", "_edge")  # origin and group edge of a scene
LEAVES_PER_ROW = 512
BROADCAST_CELLS = 100_000  # node rows take about 100 bytes
BROADCAST_ROWS = 50_000  # target rows take up to 300 bytes
GROUPS_PER_TASK = 500  # a group may meet some hundred cells on each level
CODES_PER_TASK = 50_000  # each is listed once per level
COPIES = 2  # queries per place from which on places are searched instead of queries


@dataclass(frozen=True)
class Tree:
    """Targets with Morton code and level of their leaf, and the cube of each scene."""

    rows: DataFrame
    scenes: DataFrame
    keys: tuple[str, ...]
    levels: int  # of the deepest leaf
    total: int
    cells: int
    n_scenes: int
    valued: bool = False  # targets carry a value, boxes the range of their members' values
    boxes: DataFrame | None = None  # leaf cells with their extents, also across the scene (`with_slabs`)
    counted: tuple[int, ...] = ()  # cells of each level, as far as counted

    def box_union(self) -> list[Column]:
        return box_union() + ([F.min("val").alias("vl"), F.max("val").alias("vh")] if self.valued else [])

    def is_small(self, level: int) -> bool:
        """Whether the nodes of a level, bounded by the build's count and by the cells there can be, may be broadcast."""
        if 0 <= level < len(self.counted):
            return self.counted[level] <= BROADCAST_CELLS
        return min(self.cells, self.n_scenes << 3 * STEP * max(0, level)) <= BROADCAST_CELLS

    def small_nodes(self, nodes: DataFrame, level: int = DEPTH) -> DataFrame:
        """Broadcast hint for node tables of a level that has few."""
        return F.broadcast(nodes) if self.is_small(level) else nodes

    def small_leaves(self, leaves: DataFrame) -> DataFrame:
        return F.broadcast(leaves) if self.total <= BROADCAST_ROWS else leaves

    def placed(self, queries: DataFrame, *at: tuple[Vec, Sequence[str]]) -> DataFrame:
        """Queries with the cells of some of their points; null where the scene has no targets."""
        scenes = F.broadcast(self.scenes) if self.n_scenes <= BROADCAST_CELLS else self.scenes
        out = queries.join(scenes, list(self.keys), "left") if self.keys else queries.join(F.broadcast(self.scenes), how="left")
        return out.withColumns({g: F.floor((c - F.col(o)) / F.col("_edge")) for q, cell in at for g, c, o in zip(cell, q, PLACE)}).drop(*PLACE)

    def nodes(self, level: int) -> DataFrame:
        """Boxes and member counts of the cells at a level (leaves above it stand for themselves), with their parent."""
        return self.rows.groupBy(*self.keys, node_id(level).alias("node"), node_id(level - 1).alias("parent")).agg(*self.box_union(), F.count("*").alias("cnt"))

    def slabs(self, level: int) -> DataFrame:
        """`nodes` of a tree with slabs: boxes with their extents across the scene, from those of the leaf cells."""
        across = [F.min("ln").alias("ln"), F.max("hn").alias("hn")]
        return self.boxes.groupBy(*self.keys, node_id(level).alias("node"), node_id(level - 1).alias("parent")).agg(*box_union(), *across)

    def leaves(self) -> DataFrame:
        """Leaf cells with their box and members; the number of distinct members is bounded."""
        member = F.struct("tid", "geom", "val") if self.valued else F.struct("tid", "geom")
        return self.rows.groupBy(*self.keys, node_id(DEPTH).alias("node")).agg(*self.box_union(), F.collect_list(member).alias("members"))

    def members(self) -> DataFrame:
        """Targets one by one under their leaf cell, with their boxes."""
        return self.rows.select(*self.keys, node_id(DEPTH).alias("node"), "tid", "geom", *LOW, *HIGH)


def box_union() -> list[Column]:
    return [F.min(c).alias(c) for c in LOW] + [F.max(c).alias(c) for c in HIGH]


def spread_bits(x: Column) -> Column:
    """A number of 20 bits with two zero bits between its bits."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(cell: Sequence[Column]) -> Column:
    x, y, z = (spread_bits(c.cast("bigint")) for c in cell)
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def node_id(level: int, leaf: Column | None = None) -> Column:
    """Cell of a target at a level, or its leaf if that lies above: a one in front of the code's leading bits."""
    at = F.greatest(F.least(F.col("leaf") if leaf is None else leaf, F.lit(level)), F.lit(0))
    bits = 3 * STEP
    # the code has a one above its 60 bits, so shifting it keeps one mark per level
    return F.call_function("shiftright", F.col("code"), bits * (DEPTH - at))


def with_leaf_levels(rows: DataFrame, keys: Sequence[str], weight: Sequence[str], most: int) -> DataFrame:
    """Rows with the level of their leaf: a cell is cut while it holds more than ``most`` distinct ``weight``.

    Cells with too many are nested, so a target's leaf lies as deep as it has such cells above it.
    """
    # codes shrink to little in a shuffle, so that adaptive execution would count and list all of them in one task
    parts = max(1, math.ceil(rows.count() / CODES_PER_TASK))
    every = rows.select(*keys, "code", *weight).repartition(parts, *keys, "code")
    cells = (every.distinct() if weight else every).groupBy(*keys, "code").agg(F.count("*").alias("n"))
    bits = 3 * STEP
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(DEPTH - 1)), lambda level: F.call_function("shiftright", F.col("code"), bits * (DEPTH - level)))).alias("cell")
    listed = cells.select(*keys, "code", "n", above)
    crowded = listed.groupBy(*keys, "cell").agg(F.sum("n").alias("held")).filter(F.col("held") > most).select(*keys, "cell")
    deep = listed.join(crowded, [*keys, "cell"]).groupBy(*keys, "code").agg(F.count("*").cast("int").alias("leaf"))
    return rows.join(deep.hint("merge"), [*keys, "code"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))


def build_tree(
    targets: DataFrame, keys: Sequence[str], tid: Column | str, geom: Column, low: Vec, high: Vec,
    *, k: int | None = 1, leaf_points: int = 8, value: Column | None = None,
) -> Tree:
    """Place targets in their scene's octree.  ``tid`` breaks ties and must be orderable.

    Of equal geometries the ``k`` lowest ids are kept, as many as a k-nearest search can return;
    ``None`` keeps all of them, for joins that return every match.  A cell with more than
    ``2 * leaf_points`` distinct targets is cut.  With a ``value`` searches may ask for targets below
    a limit of each query (`knn`, `nearest`).
    """
    tid = F.col(tid) if isinstance(tid, str) else tid
    slim = targets.select(
        *keys, tid.alias("tid"), geom.alias("geom"),
        *(c.cast("double").alias(n) for n, c in zip((*LOW, *HIGH), (*low, *high))),
        *([value.cast("double").alias("val")] if value is not None else []),
    )
    same = ["geom", *(["val"] if value is not None else [])]
    if k == 1:
        slim = slim.groupBy(*keys, *same, *LOW, *HIGH).agg(F.min("tid").alias("tid"))
    elif k is not None:
        slim = top_k(slim, [*keys, *same], [F.col("tid")], k)
    slim = cut_lineage(slim)
    span = F.greatest(*(F.max(h) - F.min(l) for l, h in zip(LOW, HIGH)), F.lit(1e-6)) * 1.0001
    scenes = slim.groupBy(*keys).agg(*(F.min(c).alias(o) for c, o in zip(LOW, PLACE)), span.alias("_size")).filter(F.col(PLACE[0]).isNotNull())
    scenes = cut_lineage(scenes)
    few = F.broadcast(scenes) if not keys or scenes.count() <= BROADCAST_CELLS else scenes  # a shuffle by few scenes has few tasks
    joined = slim.join(few, list(keys)) if keys else slim.join(few)
    center = [(F.col(l) + F.col(h)) / 2 for l, h in zip(LOW, HIGH)]
    cell = [F.greatest(F.lit(0), F.least(F.lit((1 << STEP * DEPTH) - 1), F.floor((m - F.col(o)) / F.col("_size") * (1 << STEP * DEPTH)))) for m, o in zip(center, PLACE)]
    coded = joined.withColumn("code", morton(cell).bitwiseOR(F.lit(1 << 3 * STEP * DEPTH))).drop("_size", *PLACE[:3])
    # copies of one geometry cannot be told apart by a finer grid, so they count once
    rows = cut_lineage(with_leaf_levels(coded, keys, () if k == 1 else ("geom",), 2 * leaf_points))
    leaves = rows.groupBy(*keys, node_id(DEPTH).alias("node")).agg(F.count("*").alias("n"), F.first("leaf").alias("leaf"))
    per_scene = leaves.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.max("leaf").alias("deepest"), F.avg("leaf").alias("usual"))
    # query groups are as large as the usual leaf of their scene
    edge = (F.col("_size") / F.pow(F.lit(2.0**STEP), F.round("usual"))).alias("_edge")
    scenes = cut_lineage((scenes.join(per_scene, list(keys)) if keys else scenes.join(per_scene)).select(*keys, *PLACE[:3], edge, "n", "cells", "deepest"))
    total, cells, levels, n_scenes = scenes.agg(F.sum("n"), F.sum("cells"), F.max("deepest"), F.count("*")).first()
    return Tree(rows, scenes.drop("n", "cells", "deepest"), tuple(keys), levels or 0, total or 0, cells or 0, n_scenes, value is not None)


def point_tree(targets: DataFrame, keys: Sequence[str], tid, p: Vec, k: int | None = 1, **kw) -> Tree:
    return build_tree(targets, keys, tid, p.struct(), p, p, k=k, **kw)


def corners_box(*corners: Vec) -> tuple[Vec, Vec]:
    return (
        Vec(*(F.least(*(v[i] for v in corners)) for i in range(3))),
        Vec(*(F.greatest(*(v[i] for v in corners)) for i in range(3))),
    )


def shape_tree(targets: DataFrame, keys: Sequence[str], tid, corners: Sequence[Vec], k: int | None = 1, **kw) -> Tree:
    """Pyramid over segments (two corners) or triangles (three)."""
    if len(corners) == 3:
        geom = triangle_geom(*corners)
    else:
        geom = F.struct(*(v.struct().alias(n) for n, v in zip("ab", corners)))
    return build_tree(targets, keys, tid, geom, *corners_box(*corners), k=k, **kw)


def point_metric(q: Vec, g: Column) -> Column:
    return (q - vec_of(g)).norm2()


def segment_metric(q: Vec, g: Column) -> Column:
    return segment_distance2(q, vec_of(g["a"]), vec_of(g["b"]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside a lambda, where repeated subexpressions are not shared."""
    return F.transform(F.array(value), body)[0]


def listed_segment_metric(q: Vec, g: Column) -> Column:
    """`segment_metric` for the segments of a list, whose lambda computes shared parts once."""
    a, b = vec_of(g["a"]), vec_of(g["b"])
    rest = lambda d, t: let((q - (a + d.scale(t))).struct(), lambda o: vec_of(o).norm2())
    return let((b - a).struct(), lambda d: let(segment_share(q, a, vec_of(d)), lambda t: rest(vec_of(d), t)))


def triangle_geom(a: Vec, b: Vec, c: Vec) -> Column:
    """Triangle as first corner, two edges, their cross product and the squared lengths."""
    u, v = b - a, c - a
    w, n = v - u, u.cross(v)
    names = [f"{p}{x}" for p in "auvn" for x in "xyz"] + ["uu", "vv", "ww", "nn"]
    values = [*a, *u, *v, *n, u.norm2(), v.norm2(), w.norm2(), n.norm2()]
    return F.struct(*(c.alias(m) for c, m in zip(values, names)))


def triangle_metric(q: Vec, g: Column) -> Column:
    """Squared distance to a triangle from its prepared form: face if the foot is inside, else edges."""
    at = lambda p: Vec(*(g[f"{p}{x}"] for x in "xyz"))
    a, u, v, n = at("a"), at("u"), at("v"), at("n")

    def to_edge(p: Vec, d: Vec, l2: Column) -> Column:
        share = F.when(l2 < 1e-16, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p.dot(d) / l2)))
        return let(share, lambda t: let((p - d.scale(t)).struct(), lambda o: vec_of(o).norm2()))

    def inner(s: Column) -> Column:
        p = vec_of(s)
        inside = let(F.struct(p.cross(v).dot(n).alias("v"), u.cross(p).dot(n).alias("w")),
                     lambda b: (g["nn"] > 0) & (b["v"] >= 0) & (b["w"] >= 0) & (b["v"] + b["w"] <= g["nn"]))
        face = let(p.dot(n), lambda h: h * h / g["nn"])
        rim = F.least(to_edge(p, u, g["uu"]), to_edge(p, v, g["vv"]), to_edge(p - u, v - u, g["ww"]))
        return F.when(inside, face).otherwise(rim)

    return let((q - a).struct(), inner)


def box_of(source) -> tuple[Vec, Vec]:
    get = (lambda c: source[c]) if isinstance(source, Column) else (lambda c: F.col(f"{source}{c}"))
    return Vec(*map(get, LOW)), Vec(*map(get, HIGH))


def gap2(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> Column:
    """Smallest squared distance between two boxes."""
    d = Vec(*(F.greatest(F.lit(0.0), bl - ah, al - bh) for al, ah, bl, bh in zip(*a, *b)))
    return d.norm2()


def reach2(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> Column:
    """Largest squared distance between points of two boxes."""
    d = Vec(*(F.greatest(bh - al, ah - bl) for al, ah, bl, bh in zip(*a, *b)))
    return d.norm2()


def slack(limit: Column) -> Column:
    return limit * (1 + 1e-9) + 1e-12


def group_queries(queries: DataFrame, tree: Tree, q: Vec, below: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries with their group cell, and the groups with the boxes around their queries and the range of their limits."""
    placed = tree.placed(queries, (q, GROUP))
    box = {f"q{n}": c for n, c in zip((*LOW, *HIGH), (*q, *q))}
    limits = [] if below is None else [F.min(below).alias("ql"), F.max(below).alias("qh")]
    groups = placed.filter(F.col(GROUP[0]).isNotNull()).groupBy(*tree.keys, *GROUP).agg(
        *(F.min(c).alias(n) for n, c in list(box.items())[:3]),
        *(F.max(c).alias(n) for n, c in list(box.items())[3:]), *limits,
    )
    return placed, groups


def group_parts(groups: DataFrame) -> int:
    return max(1, math.ceil(groups.count() / GROUPS_PER_TASK))


def spread_groups(groups: DataFrame, on: Sequence[str], parts: int | None = None) -> DataFrame:
    """Groups in partitions of a bounded number, which adaptive execution does not put together.

    It knows the size of the groups only, while the sorts of all levels hold what these meet there.
    """
    groups = groups if parts else cut_lineage(groups)
    return groups.repartition(parts or group_parts(groups), *on)


def descend(groups: DataFrame, tree: Tree, k: int | None, radius2: Column | None, below: bool = False, parts: int | None = None) -> DataFrame:
    """Leaf cells each query group has to look at: (keys, group, leaf cell).

    With ``below`` cells whose least value is above every limit of the group go, and only cells
    whose greatest value is below every limit bound the distance.  Where nodes are shuffled, groups
    return to ``parts`` partitions.
    """
    keys, boxes = list(tree.keys), [f"q{c}" for c in (*LOW, *HIGH)] + (["ql", "qh"] if below else [])
    front = groups.withColumns({"parent": F.lit(1).cast("bigint"), "_bound": F.lit(math.inf)})
    for level in range(min(1, tree.levels), tree.levels + 1):  # the root holds everything
        step = front.join(tree.small_nodes(tree.nodes(level), level), [*keys, "parent"])
        mine, node = box_of("q"), box_of("")
        # the bound of the level above already drops most children before they are compared
        step = step.withColumn("_gap", gap2(mine, node)).filter(F.col("_gap") <= slack(F.col("_bound")))
        if radius2 is not None:
            step = step.filter(F.col("_gap") <= slack(radius2))
        if below:
            step = step.filter("vl < qh")
        if k is not None:
            if parts and not tree.is_small(level):
                step = step.repartition(parts, *keys, *GROUP)
            by_group = W.partitionBy(*keys, *GROUP)
            far = reach2(mine, node)
            step = step.withColumn("_reach", F.when(F.col("vh") < F.col("ql"), far).otherwise(math.inf) if below else far)
            if k == 1:
                bound = F.min("_reach").over(by_group)
            else:
                running = by_group.orderBy("_reach").rowsBetween(W.unboundedPreceding, W.currentRow)
                step = step.withColumn("_have", F.sum("cnt").over(running))
                bound = F.min(F.when(F.col("_have") >= k, F.col("_reach"))).over(by_group)
            step = step.withColumn("_bound", F.coalesce(F.least(bound, F.col("_bound")), F.lit(math.inf))).filter(
                F.col("_gap") <= slack(F.col("_bound")))
        front = step.select(*keys, *GROUP, *boxes, "_bound", F.col("node").alias("parent"))
    return front.select(*keys, *GROUP, F.col("parent").alias("node"))


def candidate_rows(pairs: DataFrame, tree: Tree) -> DataFrame:
    """Leaf lists per query group, in rows of a bounded number of leaves."""
    keys = list(tree.keys)
    order = W.partitionBy(*keys, *GROUP).orderBy("node")
    numbered = pairs.withColumn("part", F.floor((F.row_number().over(order) - 1) / LEAVES_PER_ROW))
    full = numbered.join(tree.small_leaves(tree.leaves()), [*keys, "node"])
    return full.groupBy(*keys, *GROUP, "part").agg(
        F.collect_list(F.struct(*LOW, *HIGH, *(["vl", "vh"] if tree.valued else []), "members")).alias("leaves")
    )


def scan_leaves(q: Vec, leaves: Column, metric: Callable[[Vec, Column], Column], k: int | None, radius2: Column | None, below: Column | None = None) -> Column:
    """Best members of a leaf list for one query, as ``array<struct<d2, tid>>``."""
    me = (q, q)
    limit = radius2 if radius2 is not None else F.lit(math.inf)
    if below is not None:
        leaves = F.filter(leaves, lambda l: l["vl"] < below)
    if k == 1:
        far = lambda l: reach2(me, box_of(l)) if below is None else F.when(l["vh"] < below, reach2(me, box_of(l))).otherwise(math.inf)
        limit = F.least(limit, F.array_min(F.transform(leaves, far)))
    elif k is not None:
        # the k-th target lies no farther than the leaves of least reach that hold k of them
        full = leaves if below is None else F.filter(leaves, lambda l: l["vh"] < below)
        reaches = F.array_sort(F.transform(full, lambda l: F.struct(reach2(me, box_of(l)).alias("r"), F.size(l["members"]).alias("n"))))
        start = F.struct(F.lit(math.inf).alias("r"), F.lit(0).alias("n"))
        met = F.aggregate(reaches, start, lambda s, l: F.when(s["n"] >= k, s).otherwise(F.struct(F.when(s["n"] + l["n"] >= k, l["r"]).otherwise(math.inf).alias("r"), (s["n"] + l["n"]).alias("n"))))
        limit = F.least(limit, met["r"])
    # the one-element array binds the limit once for all leaves
    near = F.flatten(F.transform(F.array(limit), lambda u: F.filter(leaves, lambda l: gap2(me, box_of(l)) <= slack(u))))
    members = F.flatten(F.transform(near, lambda l: l["members"]))
    if below is not None:
        members = F.filter(members, lambda m: m["val"] < below)
    hits = F.transform(members, lambda m: F.struct(metric(q, m["geom"]).alias("d2"), m["tid"].alias("tid")))
    if radius2 is not None:
        hits = F.filter(hits, lambda h: h["d2"] <= radius2)
    if k == 1:
        return F.transform(F.array(F.array_min(hits)), lambda h: h)
    return F.array_sort(hits) if k is None else F.slice(F.array_sort(hits), 1, k)


def knn(
    queries: DataFrame, tree: Tree, q: Vec, metric=point_metric, k: int = 1, *,
    max_dist: float | None = None, how: str = "inner", out: str = "hits", below: Column | None = None,
) -> DataFrame:
    """Queries with their k nearest targets as ``out: array<struct<d2, tid>>`` in (distance, id) order.

    ``max_dist`` keeps targets up to that distance, ``below`` those whose value is under the query's.  With ``how="left"`` queries without any target
    keep a null; otherwise they are dropped.
    """
    radius2 = None if max_dist is None else F.lit(float(max_dist) ** 2)
    at = [f"_{c}" for c in "xyz"]
    asked = queries.withColumns({**dict(zip(at, q)), **({} if below is None else {"_below": below})})
    at += [] if below is None else ["_below"]
    spot, below = Vec(*map(F.col, at[:3])), None if below is None else F.col("_below")
    # queries at one place have one answer; where few share one, places are only counted, as their list is as long as the queries
    n_queries, n_spots = asked.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*tree.keys, *at))).first()
    alone = n_queries < COPIES * n_spots
    spots = asked if alone else cut_lineage(asked.select(*tree.keys, *at).distinct())
    placed, groups = group_queries(spots, tree, spot, below)
    on = [*tree.keys, *GROUP]
    groups = cut_lineage(groups)
    parts = group_parts(groups)
    pairs = cut_lineage(descend(spread_groups(groups, on, parts), tree, k, radius2, below is not None, parts))
    longest = pairs.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    rows = candidate_rows(pairs, tree)
    hits = scan_leaves(spot, F.col("leaves"), metric, k, radius2, below)
    whole = longest <= LEAVES_PER_ROW  # every list sits in one row, so the answer needs no merge
    if whole and alone:
        result = placed.join(rows.drop("part"), on, how).withColumn(out, F.when(F.col("leaves").isNotNull(), hits)).drop("leaves", *GROUP, *at)
    else:
        placed = placed.select(*tree.keys, *at, *GROUP).distinct() if alone else placed
        if whole:
            best = placed.join(rows.drop("part"), on).select(*tree.keys, *at, hits.alias(out))
        else:  # scan part by part, then merge
            partial = placed.join(rows, on).select(*tree.keys, *at, F.explode(hits).alias("h")).filter("h IS NOT NULL")
            best = top_k(partial, [*tree.keys, *at], [F.col("h")], k).groupBy(*tree.keys, *at).agg(F.array_sort(F.collect_list("h")).alias(out))
        result = asked.join(best, [*tree.keys, *at], how).drop(*at)
    return result.withColumn(out, F.filter(F.col(out), lambda h: h.isNotNull()))


def nearest(queries: DataFrame, tree: Tree, q: Vec, metric=point_metric, *, max_dist: float | None = None,
            how: str = "inner", tid: str = "tid", dist: str = "dist", below: Column | None = None) -> DataFrame:
    """Queries with the id of and distance to their nearest target."""
    hit = F.get("_hits", F.lit(0))
    out = knn(queries, tree, q, metric, 1, max_dist=max_dist, how=how, out="_hits", below=below)
    if how == "inner":
        out = out.filter(F.size("_hits") > 0)
    return out.withColumns({tid: hit["tid"], dist: F.sqrt(hit["d2"])}).drop("_hits")


def within(queries: DataFrame, tree: Tree, q: Vec, radius: float, metric=point_metric) -> DataFrame:
    """All (query, target) pairs up to ``radius``; rows go out one by one, never as a group."""
    radius2 = F.lit(float(radius) ** 2)
    placed, groups = group_queries(queries, tree, q)
    pairs = descend(groups, tree, None, radius2)
    on = [*tree.keys, *GROUP]
    full = pairs.join(tree.small_leaves(tree.members()), [*tree.keys, "node"]).select(*on, F.col("tid").alias("_tid"), F.col("geom").alias("_geom"), *(F.col(c).alias(f"_{c}") for c in (*LOW, *HIGH)))
    # the target's box settles most pairs at a fraction of the metric's cost
    joined = placed.join(full, on).filter(gap2((q, q), box_of("_")) <= slack(radius2))
    d2 = metric(q, F.col("_geom"))
    return joined.withColumn("d2", d2).filter(F.col("d2") <= radius2).select(
        *queries.columns, F.col("_tid").alias("tid"), F.sqrt("d2").alias("dist"))


PACKET = ("_line",)  # number of a ray
ORIGIN, END = ("ox", "oy", "oz", "on"), ("ex", "ey", "ez", "en")  # n: along the direction across the scene
ACROSS = ("na", "nb", "nc")  # direction in which a scene is flattest
PAD = 1e-9  # boxes are widened by it against rounding
FIRST_NODES = 4  # nodes of a level a ray follows in its first round
RAYS_PER_TASK = 10_000  # a ray meets some dozen boxes on each level


def with_slabs(tree: Tree) -> Tree:
    """A tree of triangles with a fourth axis: the direction in which a scene is flattest, and its leaves' extents along it.

    Boxes along x, y and z over a slanted surface hold much air, and a ray close above it would
    touch most of them.
    """
    keys = list(tree.keys)
    half = [(F.col(h) - F.col(l)) / 2 for l, h in zip(LOW, HIGH)]
    moments = tree.rows.groupBy(*keys).agg(*moment_sums(Vec(*(F.col(l) + e for l, e in zip(LOW, half))))).filter("m_n > 0")
    across = cut_lineage(planes_from_moments(moments, keys).select(*keys, *(F.col(c).alias(n) for c, n in zip("abc", ACROSS))))
    few = F.broadcast(across) if tree.n_scenes <= BROADCAST_CELLS else across
    joined = lambda df: df.join(few, keys) if keys else df.join(few)
    # from the corners themselves: their box reaches farther, and a ray that comes down along the surface would enter leaf after leaf before it is there
    (a, u, v), n = (Vec(*(F.col(f"geom.{p}{x}") for x in "xyz")) for p in "auv"), Vec(*map(F.col, ACROSS))
    heights = [n.dot(p) for p in (a, a + u, a + v)]
    error = sum((1e-12 * F.abs(c) * (F.abs(l) + F.abs(h)) for c, l, h in zip(n, LOW, HIGH)), F.lit(0.0))
    rows = joined(tree.rows).withColumns({"ln": F.least(*heights) - error, "hn": F.greatest(*heights) + error})
    boxes = cut_lineage(rows.groupBy(*keys, node_id(DEPTH).alias("_leaf")).agg(
        F.first("code").alias("code"), F.first("leaf").alias("leaf"), *box_union(), F.min("ln").alias("ln"), F.max("hn").alias("hn")).drop("_leaf"))
    # copied scenes have equal cells, so these are counted with their keys
    counts = boxes.agg(*(F.approx_count_distinct(F.xxhash64(*keys, node_id(level))).alias(f"_{level}") for level in range(tree.levels + 1))).first()
    return replace(tree, scenes=joined(tree.scenes), boxes=boxes, counted=tuple(counts))


def ray_span() -> tuple[Column, Column]:
    """Where a ray enters the box of the joined node (0..1) and where it leaves it, which is less if it does not touch it."""
    first, last = [F.lit(0.0)], [F.lit(1.0)]
    for o, e, low, high in zip(ORIGIN, END, (*LOW, "ln"), (*HIGH, "hn")):
        step = F.col(e) - F.col(o)
        pace = F.when(F.abs(step) >= 1e-15, 1 / step).otherwise(math.inf)
        # not a number for 0 times infinity, which bounds nothing
        t1, t2 = (F.col(low) - PAD - F.col(o)) * pace, (F.col(high) + PAD - F.col(o)) * pace
        first.append(F.least(t1, t2) * (1 - 1e-9))
        last.append(F.greatest(t1, t2) * (1 + 1e-9))
    return F.greatest(*first), F.least(*last)


def follow(walk: DataFrame, tree: Tree, level: int, most: int) -> DataFrame:
    """One level down: the ``most`` nodes each ray enters first, and one row for all that is entered later."""
    columns, by_ray = walk.columns, W.partitionBy(*tree.keys, *PACKET)
    first, last = ray_span()
    is_rest = F.col("parent") < 0
    step = walk.join(tree.small_nodes(tree.slabs(level), level), [*tree.keys, "parent"], "left").withColumns({"_a": first, "_b": last})
    step = step.filter(is_rest | (F.col("_b") >= F.greatest("_a", "_from")))
    step = step.select(*(c for c in columns if c not in ("parent", "_f")), F.when(is_rest, F.col("_f")).otherwise(F.col("_a")).alias("_f"),
                       F.when(is_rest, F.col("parent")).otherwise(F.col("node")).alias("node"))
    step = step.withColumn("_turn", F.row_number().over(by_ray.orderBy("_f", "node"))).filter(F.col("_turn") <= most + 1)
    step = step.withColumn("_cut", F.min(F.when(F.col("node") < 0, F.col("_f"))).over(by_ray))
    step = step.filter((F.col("node") < 0) | F.col("_cut").isNull() | (F.col("_f") < F.col("_cut")))
    rest = -1 - F.pmod(F.xxhash64(*PACKET), F.lit(1 << 40))  # spread over the partitions of the next join
    return step.withColumn("parent", F.when(F.col("_turn") > most, rest).otherwise(F.col("node"))).select(*columns)


def walk_packets(live: DataFrame, tree: Tree, most: int) -> DataFrame:
    """The first leaves each ray enters, as its row with ``node, _f``; a negative node stands for all that is entered from ``_f`` on.

    On each level a ray follows the ``most`` nodes it enters first.  A node is not entered before
    its parent, so every leaf entered before ``_f`` is listed.  Nodes left before ``_from`` are
    settled already.
    """
    walk = live.withColumns({"parent": F.lit(1).cast("bigint"), "_f": F.lit(0.0)})
    for level in range(min(1, tree.levels), tree.levels + 1):
        walk = follow(walk, tree, level, most)
    return walk.withColumnRenamed("parent", "node")


def with_triangle_hit(pairs: DataFrame) -> DataFrame:
    """Rows of a ray and a prepared triangle (a, u, v) with the parameter ``t`` of the hit, null without one."""
    o, e, a, u, v = (Vec(*(F.col(f"{p}{x}") for x in "xyz")) for p in ("o", "e", "_a", "_u", "_v"))
    d, s, h, q = e - o, o - a, vec("_h"), vec("_q")
    out = pairs.withColumns({**named("_h", d.cross(v)), **named("_q", s.cross(u))})
    out = out.withColumn("_det", u.dot(h)).withColumn("_det", F.when(F.abs("_det") > 1e-12, F.col("_det")))
    out = out.withColumns({"_r": s.dot(h) / F.col("_det"), "_s": d.dot(q) / F.col("_det"), "t": v.dot(q) / F.col("_det")})
    return out.withColumn("t", F.when((F.col("_r") >= 0) & (F.col("_s") >= 0) & (F.col("_r") + F.col("_s") <= 1) & (F.col("t") >= 0) & (F.col("t") < 1), F.col("t")))


def ray_hits(rays: DataFrame, tree: Tree, ray_id: Sequence[str], o: Vec, dest: Vec, margin: float = 0.0, counted: bool = False) -> DataFrame:
    """First triangle each segment meets before its end, if the end lies at least ``margin`` behind it.

    Each ray walks down the tree to the leaves it enters first, and goes to their triangles: rows of
    a ray are a fraction of a leaf's.  A hit before all that was left out is the ray's first; the
    others go on from there in a further round, with more leaves.  (Rays of one end cell that walk
    together list what any of them enters; near a surface that grows with the rays' length.)
    Returns the ray keys with ``tid``, the hit parameter ``t`` and the ``overshoot`` in metres;
    ``counted`` adds the number of leaves whose triangles were ``tested``.
    """
    keys = list(tree.keys)
    on = [*dict.fromkeys([*keys, *ray_id])]
    names = [*ORIGIN[:3], *END[:3]]
    tree = with_slabs(tree)
    scenes = tree.scenes.select(*keys, *ACROSS)
    scenes = F.broadcast(scenes) if tree.n_scenes <= BROADCAST_CELLS else scenes
    front = rays.select(*on, *(c.alias(n) for n, c in zip(names, (*o, *dest))))
    placed = front.join(scenes, keys) if keys else front.join(scenes)
    across, start, end = (Vec(*map(F.col, c)) for c in (ACROSS, ORIGIN[:3], END[:3]))
    placed = placed.withColumns({"on": across.dot(start), "en": across.dot(end), "_from": F.lit(0.0), "_tested": F.lit(0)}).drop(*ACROSS).dropna(subset=names)
    live = cut_lineage(placed.withColumn(PACKET[0], F.monotonically_increasing_id()))
    corner = [F.col(f"geom.{p}{x}").alias(f"_{p}{x}") for p in "auv" for x in "xyz"]
    triangles = tree.rows.select(*keys, node_id(DEPTH).alias("node"), "tid", *corner)
    state, at = live.columns, [*keys, "node"]
    most, done, left = FIRST_NODES, None, live.count()
    while left:
        walked = walk_packets(live.repartition(math.ceil(left / RAYS_PER_TASK), *PACKET), tree, most)
        asked = triangles
        if left * most <= BROADCAST_CELLS:  # few rays do not move all triangles
            walked = cut_lineage(walked)
            asked = triangles.join(F.broadcast(walked.select(*at).distinct()), at, "left_semi")
        tried = with_triangle_hit(walked.withColumn("_leaf", F.when(F.col("node") >= 0, F.col("node"))).join(tree.small_leaves(asked), at, "left"))
        hit = F.when(F.col("t").isNotNull(), F.struct("t", "tid"))
        found = tried.groupBy(*keys, *PACKET).agg(
            *(F.first(c).alias(c) for c in state if c not in (*keys, *PACKET)), F.min(hit).alias("hit"),
            F.min(F.when(F.col("node") < 0, F.col("_f"))).alias("_cut"), *([F.count_distinct("_leaf").cast("int").alias("_looked")] if counted else []))
        if counted:
            found = found.withColumn("_tested", F.col("_tested") + F.col("_looked"))
        found = cut_lineage(found.filter("hit IS NOT NULL OR _cut IS NOT NULL").select(*state, "hit", "_cut"))
        first = F.col("hit").isNotNull() & (F.col("_cut").isNull() | (F.col("hit.t") < F.col("_cut")))
        settled = found.filter(first).select(*on, *names, "hit", "_tested")
        done = settled if done is None else done.unionByName(settled)
        live = found.filter(~first & F.col("_cut").isNotNull()).withColumn("_from", F.col("_cut")).select(*state)
        most, left = most * 4, live.count()
    if done is None:
        done = live.limit(0).select(*on, *names, F.struct(F.lit(0.0).alias("t"), F.lit(None).cast(tree.rows.schema["tid"].dataType).alias("tid")).alias("hit"), "_tested")
    overshoot = ((1 - F.col("hit.t")) * (end - start).norm()).alias("overshoot")
    more = [F.col("_tested").alias("tested")] if counted else []
    out = done.select(*on, F.col("hit.tid").alias("tid"), F.col("hit.t").alias("t"), overshoot, *more)
    return out.filter(F.col("overshoot") >= margin)
