"""Seeded sampling that is exact, reproducible and independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.functions.vectors import Vec, triangle_normal, vec
from atrium.operators.ranking import dense_index, hash_order, hash_uniform, prefix_counts, top_k


def sample_per_group(df: DataFrame, group: Sequence[str], n: int, seed: int, identity: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Up to n rows per group without replacement, uniform under the seed.

    The rank is cut to n per group in each map task, so a group of any size moves n rows per task.
    """
    ordered = df.withColumn("_h", hash_order(seed, *identity))
    return top_k(ordered, group, [F.col("_h"), *map(F.col, ties)], n).drop("_h")


def cap_rows(df: DataFrame, n: int, seed: int, identity: Sequence[str], at_least: int = 0) -> DataFrame:
    """Seeded global cap: rows whose 60-bit hash is below the n-th smallest one.

    The cut-off comes from counts per hash bucket, so the n kept rows are neither sorted nor moved
    together.
    """
    value = F.conv(F.substring(hash_order(seed, *identity), 1, 12), 16, 10).cast("bigint")
    hashed = df.withColumn("_h", value)
    low, width, need = 0, 48, n
    total = df.count()
    if total < at_least:
        raise ValueError(f"{total} points are left, fewer than {at_least}")
    if total <= n:
        return df
    while width > 0 and need > 0:  # narrow the bucket that holds the n-th hash, 12 bits at a time
        width -= 12
        inside = hashed.filter((F.col("_h") >= low) & (F.col("_h") < low + (1 << (width + 12))))
        counts = inside.groupBy(F.shiftright(F.col("_h") - low, width).alias("b")).count().orderBy("b").collect()  # at most 4096 rows
        for row in counts:
            if row["count"] > need:
                low += row["b"] << width
                break
            need -= row["count"]
        else:
            low += 1 << (width + 12)
            break
    # everything below ``low`` is kept; ``need`` more rows share the one hash value at ``low``
    below = hashed.filter(F.col("_h") < low)
    if need > 0:
        edge = hashed.filter(F.col("_h") == low).orderBy(hash_order(seed, *identity), *identity).limit(need)
        below = below.unionByName(edge)
    return below.drop("_h")


def preview_rows(df: DataFrame, order: str, n: int, rounding: str = "floor") -> DataFrame:
    """n evenly spaced rows of a table in order, by dense index."""
    indexed = dense_index(df, order, "idx")
    total = indexed.agg(F.count("*").alias("_total"))  # one row
    spots = df.sparkSession.range(n).select(F.col("id").cast("double").alias("i")).join(F.broadcast(total))
    place = F.col("i") * (F.col("_total") - 1) / F.lit(float(max(n - 1, 1)))
    place = F.floor(place) if rounding == "floor" else F.rint(place).cast("bigint")
    wanted = spots.select(place.alias("idx")).distinct()
    return indexed.join(wanted, "idx", "left_semi")


def sample_mesh_surface(cornered: DataFrame, density: float, seed: int, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Points spread over the triangles of each scene in proportion to their area.

    Sample i of a scene lands in the triangle whose cumulative area covers position i + 0.5 in
    units of 1/density, which is systematic sampling: every triangle gets its share of points to
    within one.  Places inside the triangle come from seeded hashes.
    """
    a, b, c = vec("a"), vec("b"), vec("c")
    area, n = triangle_normal(a, b, c)
    tri = cornered.withColumns({"area": area, "nx": n.x, "ny": n.y, "nz": n.z})
    tri = prefix_counts(tri, "triangle_id", "area", "_before", keys)
    total = tri.groupBy(*keys).agg(F.sum("area").alias("_total"))
    tri = tri.join(total, list(keys))
    count = F.round(F.col("_total") * density)
    unit = F.col("_total") / F.greatest(count, F.lit(1.0))
    first = F.ceil(F.col("_before") / unit - 0.5)
    last = F.ceil((F.col("_before") + F.col("area")) / unit - 0.5) - 1
    last_row = F.col("_before") + F.col("area") >= F.col("_total") * (1 - 1e-12)
    last = F.when(last_row, count.cast("bigint") - 1).otherwise(last)
    tri = tri.withColumns({"_first": first, "_last": last}).filter("_last >= _first")
    # a large triangle is cut into runs of samples that are spread before they are expanded
    run = F.explode(F.sequence(F.floor(F.col("_first") / 4096), F.floor(F.col("_last") / 4096))).alias("_run")
    runs = tri.select("*", run).withColumns({
        "_lo": F.greatest(F.col("_first"), F.col("_run") * 4096),
        "_hi": F.least(F.col("_last"), F.col("_run") * 4096 + 4095)})
    pts = runs.select("*", F.explode(F.sequence("_lo", "_hi")).alias("sample_id"))
    pts = pts.withColumns({"_u": F.sqrt(hash_uniform(seed, *keys, "sample_id")), "_v": hash_uniform(seed + 1, *keys, "sample_id")})
    u, v = F.col("_u"), F.col("_v")
    pts = pts.withColumns({"w0": 1 - u, "w1": u * (1 - v), "w2": u * v})
    p = Vec(*(F.col("w0") * x + F.col("w1") * y + F.col("w2") * z for x, y, z in zip(a, b, c)))
    return pts.select(*keys, "sample_id", "triangle_id", p.x.alias("x"), p.y.alias("y"), p.z.alias("z"),
                      "nx", "ny", "nz", "w0", "w1", "w2")
