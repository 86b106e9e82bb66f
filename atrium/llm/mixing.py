"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact word count.  Whole passes over a source are taken
first; of the rest of its budget, an even share of every length is taken, and what is then still
open (less than the longest document) is fitted by a bounded knapsack over the lengths left.
Which documents of a length are taken is decided by a seeded hash.

Texts are read once, for their word counts; everything after that moves rows of some 30 bytes.

Defined results: a null text has size 0 and is taken with 0 words; a null source is a source of
its own, last in order; sources without words have target 0; equal rows are told apart by
nothing, so their number, not their identity, is decided; an empty table gives an empty result.
Only ``doc_id``, ``text`` and ``source`` are read, other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.llm.words import WORD
from atrium.session import cut_lineage

SEED = 11
SPLIT = 1024  # rows of a group that are ranked together


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(rows: DataFrame, key: str, out: str) -> DataFrame:
    """``rows`` with their 0-based place in the order of ``key``: a distributed sort, then one count per partition."""
    rows = cut_lineage(rows.orderBy(key)).withColumn("_part", F.spark_partition_id())
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    starts = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    place = rows.withColumn(out, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return place.join(starts, "_part").withColumn(out, F.col(out) + F.col("_start")).drop("_part", "_start")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Target words of each source: (key, source, source_size) plus weight and target.

    ``sizes`` has one row per source.  Sources in code-point order, null last, take ``weights`` in
    turn and share ``share`` times all words.  A source whose part exceeds ``most`` times its size
    stops there and the others share the excess; each round is one aggregate over the sources.
    """
    ranked = in_order(sizes, "key", "rank")
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("weight", choice).withColumn("most", most * F.col("source_size")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        stopped = F.col("most") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.count_if(stopped).alias("n"), F.sum(F.when(stopped, F.col("most"))).alias("used"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("weight")).first()
        if row.n == capped or not row.weight:
            break
        capped, level = row.n, (share * total - (row.used or 0)) / row.weight
    return ranked.withColumn("target", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")))


def fit_lengths(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """Bounded knapsack: how many of each length make the largest sum within ``budget``.

    Reachable sums are the bits of one number; a length with c documents adds shifts by powers of
    two of it.  Stops as soon as the budget itself is reached.
    """
    steps, reach, full = [], 1, (1 << budget + 1) - 1
    for length, count in sorted(zip(lengths, counts)):
        count, part = min(count, budget // length), 1
        while count > 0 and not reach >> budget & 1:
            part = min(part, count)
            steps.append((length, part, reach))
            reach |= reach << length * part & full
            count, part = count - part, part * 2
    rest, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> rest & 1:
            taken[length] = taken.get(length, 0) + part
            rest -= length * part
    return taken


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    found = fit_lengths(rows["size"].tolist(), rows["spare"].tolist(), int(rows["open"].iloc[0]))
    return pd.DataFrame({"key": rows["key"], "size": rows["size"], "fitted": [found.get(n, 0) for n in rows["size"]]})


def length_counts(hist: DataFrame) -> DataFrame:
    """How many documents of each (key, size) are taken once more than the whole passes.

    ``hist``: key, size, n, source_size, target.  The even share of all lengths, rounded on the
    running count from the longest down, misses the budget by less than the longest document.
    """
    down = W.partitionBy("key").orderBy(F.desc("size"))
    rest = F.when(F.col("source_size") > 0, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0)
    hist = hist.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    hist = hist.withColumn("rest", rest).withColumn("upto", F.sum("n").over(down))
    portion = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)
    hist = hist.withColumn("even", (F.floor(portion * F.col("upto")) - F.floor(portion * (F.col("upto") - F.col("n")))).cast("long"))
    hist = hist.withColumn("spare", F.col("n") - F.col("even"))
    hist = hist.withColumn("open", (F.floor(F.col("rest") + 0.5) - F.sum(F.col("even") * F.col("size")).over(W.partitionBy("key"))).cast("long"))
    hist = cut_lineage(hist)
    fitted = hist.filter("size > 0 AND spare > 0 AND size <= open").select("key", "size", "spare", "open") \
        .groupBy("key").applyInPandas(_fit, "key string, size long, fitted long")
    return hist.join(fitted, ["key", "size"], "left").withColumn("take", F.col("even") + F.coalesce("fitted", F.lit(0)))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document.

    Returns a row per document: doc_id, source, size (words), source_size, target (of the source,
    words), copies (0..``most``) and taken (size times copies).
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))  # "=" sorts before "~": null last
    sized = cut_lineage(docs.select(
        "doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw")))
    hist = cut_lineage(sized.groupBy("key", "size").agg(F.count("*").alias("n")))
    sources = hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, share, most).select("key", "source_size", "target")
    counts = cut_lineage(length_counts(hist.join(targets, "key")).select("key", "size", "n", "source_size", "target", "passes", "take"))
    # the first `take` documents of each length by hash: count per hash range, then rank inside the range that the cut falls in
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / SPLIT))
    rows = sized.join(counts, ["key", "size"]).withColumn(
        "part", F.floor((F.col("draw") / F.lit(2.0**64) + 0.5) * ranges).cast("long"))
    rows = rows.repartition("key", "size", "part")  # the join may split a crowded length, the ranks go by range
    parts = rows.groupBy("key", "size", "part").agg(F.count("*").alias("rows"))
    running = W.partitionBy("key", "size").orderBy("part")
    parts = parts.withColumn("earlier", F.sum("rows").over(running) - F.col("rows")).drop("rows")
    inside = W.partitionBy("key", "size", "part").orderBy("draw", "doc_id")
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(parts, ["key", "size", "part"])
    copies = (F.col("passes") + F.when(F.col("earlier") + F.col("nth") <= F.col("take"), 1).otherwise(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "draw")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken (whole rows of ``docs``, repeated).

    Rows are told apart by id, source and text, also those without an id.  Repeated rows share their
    copies, the first ones by a hash of the whole row getting one more, so attempts agree.
    """
    seed = options.get("seed", SEED)
    key = F.xxhash64("draw", "source")
    counts = mix_sources(docs, **options).withColumn("_row", key).groupBy("_row").agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)), F.xxhash64(*plain).alias("_order"),
                       "source", F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw")).withColumn("_row", key).drop("draw", "source")
    taken = rows.join(counts.filter("_sum > 0"), "_row")
    nth = F.row_number().over(W.partitionBy("_row").orderBy("_order"))  # of one row but where rows are repeated
    times = F.floor(F.col("_sum") / F.col("_rows")) + F.when(F.col("_nth") <= F.col("_sum") % F.col("_rows"), 1).otherwise(0)
    taken = taken.withColumn("_nth", nth).withColumn("_times", times.cast("int")).filter("_times > 0")
    return taken.select(*own, F.explode(F.sequence(F.lit(1), "_times"))).select(own).toDF(*docs.columns)
