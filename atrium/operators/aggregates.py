"""Histograms, votes, summaries, voxel grids, plane fits and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.functions.eigen import merge_moments, moment_sums, planes_from_moments
from atrium.functions.labels import LAYOUT_LABELS
from atrium.functions.vectors import vec
from atrium.session import end_round as cut_lineage


def frame_histogram(samples: DataFrame, keys: Sequence[str], label: str, valid: Column, n_labels: int = len(LAYOUT_LABELS)) -> DataFrame:
    """Sample and valid counts per frame, and valid counts of every label including zeros."""
    counts = [F.count_if(valid & (F.col(label) == i)).alias(f"label_{i}") for i in range(n_labels)]
    return samples.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.count_if(valid).alias("n_valid"), *counts)


def global_histogram(samples: DataFrame, frame_keys: Sequence[str], label: str) -> DataFrame:
    """Counts per frame and label together with the totals per label (null frame keys)."""
    per_frame = samples.groupBy(*frame_keys, label).agg(F.count("*").alias("n"))
    frame = F.struct(*frame_keys)
    sets = per_frame.select(F.explode(F.array(frame, F.lit(None).cast(per_frame.select(frame).schema[0].dataType))).alias("f"), label, "n")
    return sets.groupBy("f", label).agg(F.sum("n").alias("n")).select(*(F.col(f"f.{k}").alias(k) for k in frame_keys), label, "n")


def vertex_votes(hits: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    return hits.groupBy(*keys, "vertex_id", "label").agg(F.count("*").alias("votes"))


def without_votes(votes: DataFrame, segments: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Vertices of the superpoints none of whose vertices has a vote; only these need neighbour probabilities."""
    on, seg = [*keys, "vertex_id"], [*keys, "segment_id"]
    voted = segments.select(*on, "segment_id").join(votes.select(*on).distinct(), on, "left_semi").select(*seg).distinct()
    return segments.join(voted, seg, "left_anti")


def segment_labels(votes: DataFrame, probabilities: DataFrame, segments: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Winning label per superpoint: summed votes, or summed neighbour probabilities without votes.

    ``probabilities`` are read of superpoints without votes only (`without_votes`).  Returns one row per vertex with its segment's label, the label's share and whether the
    fallback decided.
    """
    on = [*keys, "vertex_id"]
    both = votes.select(*on, "label", F.col("votes").cast("double").alias("vote"), F.lit(0.0).alias("p")).unionByName(
        probabilities.select(*on, "label", F.lit(0.0).alias("vote"), "p"))
    seg = [*keys, "segment_id"]
    per_label = both.join(segments.select(*on, "segment_id"), on).groupBy(*seg, "label").agg(
        F.sum("vote").alias("vote"), F.sum("p").alias("p"))
    # a segment has at most one row per label, so this array is as short as the vocabulary
    lists = per_label.groupBy(*seg).agg(
        F.sum("vote").alias("total_vote"), F.sum("p").alias("total_p"),
        F.max(F.struct("vote", (-F.col("label")).alias("neg"))).alias("by_vote"),
        F.max(F.struct("p", (-F.col("label")).alias("neg"))).alias("by_p"))
    voted = F.col("total_vote") > 0
    decided = lists.select(
        *seg, F.when(voted, -F.col("by_vote.neg")).otherwise(-F.col("by_p.neg")).alias("label"),
        F.when(voted, F.col("by_vote.vote") / F.col("total_vote")).otherwise(F.col("by_p.p") / F.col("total_p")).alias("share"),
        (~voted).alias("fallback"))
    return segments.select(*on, "segment_id").join(decided, seg, "left")


def vote_coverage(vertices: DataFrame, votes: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    voted = votes.groupBy(*keys, "vertex_id").agg(F.sum("votes").alias("votes"))
    return vertices.join(voted, [*keys, "vertex_id"], "left").groupBy(*keys).agg(
        F.count("votes").alias("voted"), F.count_if(F.col("votes").isNull()).alias("unvoted"),
        F.sum(F.coalesce("votes", F.lit(0))).alias("votes"))


SELECT_LIMIT = 1_000_000
SELECT_BUCKETS = 1024


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float], limit: int = SELECT_LIMIT) -> DataFrame:
    """Exact interpolated percentiles per group, whatever the group's size.

    Groups up to ``limit`` rows use the built-in aggregate, which holds a group's values in one
    task.  Larger ones are selected by counting: the range that holds a rank is cut into buckets
    again and again until few rows are left in it.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    large = cut_lineage(sizes.filter(F.col("n") > limit))
    plain = lambda d: d.groupBy(*keys).agg(*(F.percentile("v", p).alias(n) for n, p in wanted.items()))
    if large.isEmpty():
        return plain(rows)
    asks = F.array(*(F.struct(F.lit(n).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for n, p in wanted.items()))
    state = large.select(*keys, "lo", "hi", F.explode(asks).alias("a")).select(
        *keys, "lo", "hi", "a.name", "a.at", F.explode(F.array(F.floor("a.at"), F.ceil("a.at"))).alias("rank")).distinct()
    state = cut_lineage(state.withColumns({"skip": F.lit(0).cast("bigint"), "left": F.lit(limit + 1).cast("bigint")}))
    spot = [*keys, "name", "rank"]
    big = rows.join(F.broadcast(large.select(*keys)), list(keys), "left_semi")  # a group has more than `limit` rows
    while True:
        open_ = state.filter((F.col("left") > limit) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        width = (F.col("hi") - F.col("lo")) / SELECT_BUCKETS
        bucket = F.least(F.lit(SELECT_BUCKETS - 1), F.floor((F.col("v") - F.col("lo")) / width))
        met = big.join(F.broadcast(open_.select(*spot, "lo", "hi")), list(keys)).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        counts = met.groupBy(*spot, bucket.alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("b_lo"), F.max("v").alias("b_hi"))
        w = W.partitionBy(*spot).orderBy("b")  # one row per bucket
        counts = counts.withColumn("before", F.sum("c").over(w) - F.col("c"))
        hit = counts.join(open_.select(*spot, "skip", "at"), spot).filter(
            (F.col("rank") - F.col("skip") >= F.col("before")) & (F.col("rank") - F.col("skip") < F.col("before") + F.col("c")))
        moved = hit.select(*keys, F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), "name", "at", "rank", (F.col("skip") + F.col("before")).alias("skip"), F.col("c").alias("left"))
        state = cut_lineage(state.join(open_.select(*spot), spot, "left_anti").unionByName(moved))
    flat = state.filter("lo = hi").select(*spot, "at", F.col("lo").alias("v"))
    rest = big.join(F.broadcast(state.filter("lo < hi")), list(keys)).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    order = W.partitionBy(*spot).orderBy("v")  # at most ``limit`` rows
    found = rest.withColumn("i", F.row_number().over(order) - 1 + F.col("skip")).filter("i = rank").select(*spot, "at", "v").unionByName(flat)
    share = F.col("at") - F.floor("at")
    value_of = lambda n: F.sum(F.when(F.col("name") == n, F.when(F.ceil("at") == F.floor("at"), F.col("v")).when(
        F.col("rank") == F.floor("at"), F.col("v") * (1 - share)).otherwise(F.col("v") * share)))
    selected = found.groupBy(*keys).agg(*(value_of(n).alias(n) for n in wanted))
    return plain(rows.join(large.select(*keys), list(keys), "left_anti")).unionByName(selected)


def distance_summary(df: DataFrame, keys: Sequence[str], dist: str = "dist", exact: bool = True) -> DataFrame:
    """Minimum, median, 95th percentile and maximum; ``exact=False`` uses the sketch instead."""
    df = cut_lineage(df.select(*keys, dist)) if exact else df  # read three times below
    ends = df.groupBy(*keys).agg(F.min(dist).alias("min"), F.max(dist).alias("max"),
                                 *([] if exact else [F.percentile_approx(dist, p, 100000).alias(n) for n, p in (("median", 0.5), ("p95", 0.95))]))
    return ends.join(percentiles(df, keys, dist, {"median": 0.5, "p95": 0.95}), list(keys)) if exact else ends


def depth_stats(samples: DataFrame, keys: Sequence[str], confidence: Sequence[str] = (), normal: Sequence[str] | None = None) -> DataFrame:
    """Range, mean, median and share of positive depths per frame.

    Adds the range of each ``confidence`` column, and of the length of the ``normal`` columns the
    mean and the largest deviation from one.
    """
    d = F.col("depth")
    more = [f(c).alias(f"{c}_{n}") for c in confidence for f, n in ((F.min, "min"), (F.max, "max"))]
    if normal is not None:
        length = F.sqrt(sum((F.col(c) * F.col(c) for c in normal), F.lit(0.0)))
        more += [F.avg(length).alias("normal_norm_mean"), F.max(F.abs(length - 1)).alias("normal_norm_max_error")]
    plain = samples.groupBy(*keys).agg(
        F.min(d).alias("depth_min"), F.max(d).alias("depth_max"), F.avg(d).alias("depth_mean"),
        F.avg((d > 0).cast("double")).alias("positive_fraction"), *more)
    return plain.join(percentiles(samples, keys, "depth", {"depth_median": 0.5}), list(keys))


def mean_of_means(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scene summary of per-frame statistics; the mean weighs frames, not pixels."""
    return frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.min("depth_min").alias("depth_min"),
                                     F.max("depth_max").alias("depth_max"), F.avg("depth_mean").alias("mean_of_means"))


def voxel_downsample(points: DataFrame, keys: Sequence[str], size: float, origin=(0.0, 0.0, 0.0), extra: Sequence[str] = ()) -> DataFrame:
    """Mean position (and extra values) per occupied voxel."""
    cell = [F.floor((F.col(c) - F.lit(float(o))) / F.lit(size)).alias(f"v{c}") for c, o in zip("xyz", origin)]
    return points.groupBy(*keys, *cell).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("x", "y", "z", *extra)))


def bounds(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Axis-aligned bounds and the scene scale: one more than the largest coordinate, rounded up."""
    g = points.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    far = F.greatest(*(F.abs(F.col(f"{n}_{c}")) for c in "xyz" for n in ("min", "max")))
    return g.withColumn("scene_scale", F.greatest(F.lit(1), F.ceil(far + 1)).cast("bigint"))


def fit_plane_group(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plane per group from additive moments; the group itself never travels."""
    return planes_from_moments(points.groupBy(*keys).agg(*moment_sums(vec())), keys)


def plane_merge_moments(moments: DataFrame, pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Joint plane of each pair as the fit of the two groups' summed moments."""
    pair = [*dict.fromkeys([*[k for k in keys if k in pairs.columns], left, right])]
    shared = [k for k in keys if k in pairs.columns]
    side = lambda c: pairs.join(moments.withColumnRenamed("polygon_id", c), [*shared, c])
    both = side(left).unionByName(side(right))
    return planes_from_moments(merge_moments(both, pair), pair)


def plane_error(points: DataFrame, planes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean distance and mean normal angle of points to the plane they are keyed to."""
    from atrium.functions.vectors import angle_degrees, plane

    j = points.join(planes, list(keys))
    return j.groupBy(*keys).agg(F.avg(F.abs(plane().at(vec()))).alias("mean_distance"),
                                F.avg(angle_degrees(vec("n"), plane().n)).alias("mean_angle"))


def flip_normals_majority(points: DataFrame, planes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planes turned over where more than half of their points' normals oppose them."""
    from atrium.functions.vectors import plane

    against = points.join(planes, list(keys)).groupBy(*keys).agg(
        F.count_if(vec("n").dot(plane().n) < 0).alias("_opp"), F.count("*").alias("_n"))
    flip = F.coalesce(F.col("_opp") * 2 > F.col("_n"), F.lit(False))
    return planes.join(against, list(keys), "left").withColumn("flipped", flip).select(
        *keys, *(F.when(F.col("flipped"), -F.col(k)).otherwise(F.col(k)).alias(k) for k in "abcd"), "flipped")


def weighted_elevation(df: DataFrame, keys: Sequence[str], z: str, weight: str, floor: float = 1e-6) -> DataFrame:
    w = F.greatest(F.col(weight), F.lit(floor))
    return df.groupBy(*keys).agg((F.sum(w * F.col(z)) / F.sum(w)).alias("elevation"))


def argmax_label(scores: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Label with the highest score; ties go to the lowest label."""
    best = F.max(F.struct(F.col(score), (-F.col(label)).alias("neg")))
    return scores.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b.neg")).alias(label), F.col(f"_b.{score}").alias(score))


def validation(df: DataFrame, keys: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """All-of checks per key as one map; an absent value fails its check."""
    ok = df.groupBy(*keys).agg(*(F.every(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    entries = [x for n in checks for x in (F.lit(n), F.col(n))]
    passed = F.lit(True)
    for n in checks:
        passed = passed & F.col(n)
    return ok.select(*keys, F.create_map(*entries).alias("validation"), passed.alias("passed"))
