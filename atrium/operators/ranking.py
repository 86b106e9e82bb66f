"""Dense numbering, prefix sums and top-k without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_BITS = 16


def prefix_counts(counts: DataFrame, key: str, value: str, out: str, keys: Sequence[str] = (), bits: int = 48) -> DataFrame:
    """Exclusive prefix sum of ``value`` over an integer key, unique per group.

    Keys are cut into buckets of 2**16; each window holds one bucket at most, and the bucket totals
    are summed the same way one level up.  ``bits`` is the width of the keys.
    """
    if bits <= BUCKET_BITS:
        w = W.partitionBy(*keys).orderBy(key) if keys else W.partitionBy(F.lit(0)).orderBy(key)
        before = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(value)
        return counts.withColumn(out, before)
    bucket, total, offset, inside = (f"_{n}{bits}" for n in ("bucket", "total", "offset", "inside"))
    bucketed = counts.withColumn(bucket, F.shiftright(F.col(key).cast("bigint"), BUCKET_BITS))
    totals = bucketed.groupBy(*keys, bucket).agg(F.sum(value).alias(total))
    offsets = prefix_counts(totals, bucket, total, offset, keys, bits - BUCKET_BITS)
    w = W.partitionBy(*keys, bucket).orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = bucketed.withColumn(inside, F.sum(value).over(w) - F.col(value))
    return (
        running.join(offsets.select(*keys, bucket, offset), [*keys, bucket])
        .withColumn(out, F.col(offset) + F.col(inside))
        .drop(bucket, offset, inside)
    )


def dense_index(ids: DataFrame, key: str, out: str, keys: Sequence[str] = (), bits: int = 48) -> DataFrame:
    """0-based rank of each distinct id in ascending order, per group."""
    rows = ids.select(*keys, key).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return prefix_counts(rows, key, "_one", out, keys, bits).drop("_one")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per group; Spark trims each map task to k rows per group before the shuffle."""
    name = rank or "_rank"
    w = W.partitionBy(*group).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def hash_order(seed: int | Column, *columns: str) -> Column:
    """Seeded pseudo-random order that any engine with md5 reproduces."""
    return F.md5(F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def hash_uniform(seed: int | Column, *columns: str) -> Column:
    """Seeded uniform in [0, 1) from the first 12 hex digits of the md5 order."""
    return F.conv(F.substring(hash_order(seed, *columns), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
