"""Uniform shuffle into shards of exact sizes with a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn from the multivariate
hypergeometric law that a uniform permutation of all rows would give.  Each partition permutes its
rows and cuts them by its counts, the rows are exchanged, and each shard permutes again.  Shard
sizes are exact by construction (law ``rows``: at most one apart).

The driver holds one count per partition and shard, never rows.  The second permutation is cut
into hash ranges of bounded size, so no task holds a whole shard.

Defined results: null texts have no bytes (size 1, crc32 of nothing), null ids are rows like any
other, equal rows are independent rows and may go to different shards; an empty table gives an
empty result; other columns are carried along unread, but for columns ``shard`` and ``slot``, which
are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.session import cut_lineage

SPLIT = 20_000  # rows of a shard that are permuted together


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of good + bad, for populations of any size.

    Inverts the distribution inside 40 standard deviations of its mode, built from the ratios of neighbouring
    probabilities, so no factorials of large numbers are needed.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    wide = int(40 * (draws * good / total * bad / total) ** 0.5) + 40
    k = np.arange(max(low, mode - wide), min(high, mode + wide) + 1, dtype=np.float64)
    ratio = np.log((good - k[:-1]) / (k[:-1] + 1)) + np.log((draws - k[:-1]) / (bad - draws + k[:-1] + 1))
    log_p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(log_p - log_p.max())
    at = np.searchsorted(np.cumsum(p), rng.random() * p.sum(), "right")
    return int(k[min(at, len(k) - 1)])


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; column sums are the exact shard sizes."""
    rng, total = np.random.default_rng(seed), sum(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        left, free, sent = n, sum(room), []
        for s in range(shards):
            got = hypergeometric(rng, room[s], free - room[s], left)
            sent.append(got)
            free -= room[s]
            left -= got
        room = [r - x for r, x in zip(room, sent)]
        matrix.append(sent)
    return matrix


def shuffle_to_shards(docs: DataFrame, shards: int = 8, seed: int = 5) -> DataFrame:
    """``docs`` with ``shard`` (0..shards-1) and ``slot`` (gapless from 0 within the shard).

    The input is checkpointed first: both passes over it, and any task that runs again, must see the same partitions in
    the same order.
    """
    spark, docs = docs.sparkSession, docs.drop("shard", "slot")
    own = [f"c{i}" for i in range(len(docs.columns))]  # clashing names do no harm
    rows = cut_lineage(docs.toDF(*own)).withColumn("_part", F.spark_partition_id())
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # one number per partition
    parts = sorted(counts)
    cuts = [(p, np.cumsum(sent).tolist()) for p, sent in zip(parts, communication_matrix([counts[p] for p in parts], shards, seed))]
    matrix = spark.createDataFrame(cuts, "_part int, _cuts array<long>")
    # permute locally: by a hash of the row's place and the seed, so equal rows move independently
    placed = rows.withColumn("_row", F.monotonically_increasing_id())
    placed = placed.withColumn("_first", F.xxhash64(F.lit(seed), "_row")).withColumn("_second", F.xxhash64(F.lit(seed + 1), "_row"))
    local = placed.sortWithinPartitions("_first", "_row").withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    shard = F.size(F.filter("_cuts", lambda c: c <= F.col("_nth")))
    sent = local.join(F.broadcast(matrix) if len(cuts) * shards <= 1 << 20 else matrix, "_part").withColumn("shard", shard)
    # exchange and permute again, in hash ranges of the shard
    total = sum(counts.values())
    ranges = max(1, -(-total // (shards * SPLIT)))
    sent = sent.withColumn("_range", F.floor((F.col("_second") / F.lit(2.0**64) + 0.5) * ranges).cast("long"))
    held = sent.groupBy("shard", "_range").agg(F.count("*").alias("_held"))
    held = held.withColumn("_before", F.sum("_held").over(W.partitionBy("shard").orderBy("_range")) - F.col("_held")).drop("_held")
    order = W.partitionBy("shard", "_range").orderBy("_second", "_row")
    out = sent.withColumn("_in", F.row_number().over(order)).join(held, ["shard", "_range"])
    out = out.withColumn("slot", F.col("_before") + F.col("_in") - 1)
    return out.select(*own, F.col("shard").cast("int"), "slot").toDF(*docs.columns, "shard", "slot")


def shard_digest(docs: DataFrame, shards: int = 8, seed: int = 5) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce("text", F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_to_shards(small, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
