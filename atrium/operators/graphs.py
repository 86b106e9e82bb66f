"""Iterative graph operators: components, greedy matching, list ranking.

Every round is a join and an aggregate on the whole edge table; rounds end with
files that the next one reads (`end_round`) and one small action that tells whether anything changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.operators.ranking import hash_order
from atrium.session import end_round as cut_lineage

TIES = 7  # seed of the order among equals


def connected_components(edges: DataFrame, nodes: DataFrame, keys: Sequence[str], node: str, left: str, right: str, out: str = "component") -> DataFrame:
    """Smallest node id of the component of each node (isolated nodes are their own component).

    Alternating star contraction: each node hands its larger, then its smaller neighbours to the
    smallest neighbour it knows, so long chains shrink in a logarithmic number of rounds.  Only
    minima are aggregated, never neighbour lists, so hubs cost no more than other nodes.
    """
    pairs = edges.select(
        *keys, F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    ).filter("u <> v").distinct()
    pairs = cut_lineage(pairs)
    state = None
    while True:
        pairs = cut_lineage(_contract(pairs, keys))
        digest = pairs.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if digest == state:
            break
        state = digest
    roots = pairs.select(*keys, F.col("u").alias(node), F.col("v").alias(out))
    return nodes.select(*keys, node).join(roots, [*keys, node], "left").withColumn(out, F.coalesce(out, node))


def _contract(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One large-star and one small-star step on edges ``u > v``."""
    both = pairs.select(*keys, F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select(*keys, "e.u", "e.v")
    low = both.groupBy(*keys, "u").agg(F.min("v").alias("w")).select(*keys, "u", F.least("u", "w").alias("m"))
    large = both.filter("v > u").join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # every u is now larger than its neighbours: hand them, and u itself, to the smallest one
    low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    moved = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")
    return large.join(low, [*keys, "u"]).select(*keys, moved).select(*keys, F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()


def greedy_pairs(pairs: DataFrame, keys: Sequence[str], left: str, right: str, cost: str) -> DataFrame:
    """Maximal matching that equals taking pairs in the order of cost, equal costs by a seeded hash of the pair.

    A pair is taken as soon as it is the best one at both of its ends; taken ends drop their other
    pairs; repeat until no pair is left.  The hash order keeps the number of rounds logarithmic on
    paths and meshes whose ids run along them.
    """
    open_pairs = cut_lineage(pairs.select(*keys, left, right, cost, hash_order(TIES, left, right).alias("_tie")))
    taken = None
    while True:
        rank = F.struct(cost, "_tie", left, right)
        ends = open_pairs.select(*keys, rank.alias("r"), F.explode(F.array(left, right)).alias("n"))
        best = ends.groupBy(*keys, "n").agg(F.min("r").alias("r"))
        won = best.groupBy(*keys, "r").agg(F.count("*").alias("c")).filter("c = 2").select(*keys, "r.*")
        won = cut_lineage(won.select(*keys, left, right, cost))
        if won.isEmpty():
            return won if taken is None else taken
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(*keys, F.explode(F.array(left, right)).alias("n"))
        for end in (left, right):
            open_pairs = open_pairs.join(used.withColumnRenamed("n", end), [*keys, end], "left_anti")
        open_pairs = cut_lineage(open_pairs)


def independent_set(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str, left: str, right: str) -> DataFrame:
    """Nodes picked in the order of a seeded hash of their ids, never two adjacent ones; rounds are logarithmic in any numbering."""
    rest = cut_lineage(nodes.select(*keys, node).distinct())
    ranked = lambda c: F.struct(hash_order(TIES, c), F.col(c).alias("id"))
    both = edges.select(*keys, F.explode(F.array(F.struct(F.col(left).alias("a"), F.col(right).alias("b")), F.struct(F.col(right).alias("a"), F.col(left).alias("b")))).alias("e")).select(*keys, "e.a", "e.b").filter("a <> b").distinct()
    both = cut_lineage(both.join(rest.withColumnRenamed(node, "a"), [*keys, "a"], "left_semi").join(rest.withColumnRenamed(node, "b"), [*keys, "b"], "left_semi"))
    picked = None
    while not rest.isEmpty():
        lowest = both.groupBy(*keys, "a").agg(F.min(ranked("b")).alias("m"))
        now = rest.join(lowest, (F.col(node) == F.col("a")) & _same(rest, lowest, keys), "left").filter(F.col("m").isNull() | (F.col("m") > ranked("a"))).select(*(rest[k] for k in keys), node)
        now = cut_lineage(now)
        picked = now if picked is None else picked.unionByName(now)
        hit = both.join(now.withColumnRenamed(node, "a"), [*keys, "a"], "left_semi").select(*keys, F.col("b").alias(node))
        gone = now.unionByName(hit.select(*keys, node)).distinct()
        rest = cut_lineage(rest.join(gone, [*keys, node], "left_anti"))
        both = cut_lineage(both.join(gone.withColumnRenamed(node, "a"), [*keys, "a"], "left_anti").join(gone.withColumnRenamed(node, "b"), [*keys, "b"], "left_anti"))
    return picked if picked is not None else rest


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & (a[k] == b[k])
    return cond


def trace_faces(edges: DataFrame, points: DataFrame, keys: Sequence[str], left: str = "e0", right: str = "e1", vertex: str = "vertex_id") -> DataFrame:
    """Closed loops of an undirected planar edge set, as (keys, loop_id, pos, vertex, x, y, area).

    Each edge becomes two half-edges.  A half-edge continues with the next edge clockwise from its
    own reverse, which walks every face with its inside on the left; faces of positive area are the
    loops, whether or not they share vertices.  Cycles are found and ordered by pointer doubling:
    the number of joins grows with the logarithm of the longest loop.  A loop starts at its
    smallest half-edge.
    """
    xy = points.select(*keys, F.col(vertex), "x", "y")
    both = edges.select(*keys, F.explode(F.array(F.struct(F.col(left).alias("a"), F.col(right).alias("b")), F.struct(F.col(right).alias("a"), F.col(left).alias("b")))).alias("e")).select(*keys, "e.a", "e.b").filter("a <> b").distinct()
    for end in "ab":
        both = both.join(xy.select(*keys, F.col(vertex).alias(end), F.col("x").alias(f"x{end}"), F.col("y").alias(f"y{end}")), [*keys, end])
    angle = F.atan2(F.col("yb") - F.col("ya"), F.col("xb") - F.col("xa"))
    fan = W.partitionBy(*keys, "a")
    by_angle = fan.orderBy("angle", "b")
    everything = by_angle.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turned = both.withColumn("angle", angle).withColumn("clockwise", F.coalesce(F.lag("b").over(by_angle), F.last("b").over(everything)))
    # reverse half-edge (b, a) of (a, b) turns clockwise to (b, c)
    half = turned.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), F.col("clockwise").alias("c"),
                         F.col("xb").alias("x"), F.col("yb").alias("y"), F.col("xa").alias("x2"), F.col("ya").alias("y2"))
    h = F.struct("a", "b")
    half = cut_lineage(half.select(*keys, h.alias("h"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")).alias("next"), "x", "y", "x2", "y2"))
    walk = half.select(*keys, "h", F.col("next").alias("ptr"), F.least("h", "next").alias("low"))
    total = half.count()
    reach = 1
    while True:  # smallest half-edge of each cycle
        ahead = walk.select(*keys, F.col("h").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        walk = cut_lineage(walk.join(ahead, [*keys, "ptr"]).select(*keys, "h", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed")))
        reach *= 2
        if reach > total or walk.filter("changed").isEmpty():
            break
    head = F.col("h") == F.col("low")
    steps = half.join(walk.select(*keys, "h", "low"), [*keys, "h"])
    steps = cut_lineage(steps.select(*keys, "h", "low", F.when(~head, F.col("next")).alias("ptr"), F.when(head, 0).otherwise(1).cast("bigint").alias("left_over")))
    while not steps.filter("ptr IS NOT NULL").isEmpty():  # steps left until the head
        ahead = steps.select(*keys, F.col("h").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("left_over").alias("more"))
        steps = cut_lineage(steps.join(ahead, [*keys, "ptr"], "left").select(
            *keys, "h", "low", F.col("ptr2").alias("ptr"), (F.col("left_over") + F.coalesce("more", F.lit(0))).alias("left_over")))
    full = half.drop("next").join(steps.drop("ptr"), [*keys, "h"])
    loops = full.groupBy(*keys, "low").agg(F.count("*").alias("n"), (F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2).alias("area")).filter("area > 0")
    pos = F.when(F.col("left_over") == 0, 0).otherwise(F.col("n") - F.col("left_over")).alias("pos")
    return full.join(loops, [*keys, "low"]).select(*keys, F.col("low").alias("loop_id"), pos, F.col("h.a").alias(vertex), "x", "y", "area")


def branching_vertices(edges: DataFrame, keys: Sequence[str], left: str = "e0", right: str = "e1") -> DataFrame:
    """Vertices whose number of edges is not two, with that number."""
    ends = edges.select(*keys, F.explode(F.array(left, right)).alias("vertex_id"))
    return ends.groupBy(*keys, "vertex_id").agg(F.count("*").alias("degree")).filter("degree <> 2")
