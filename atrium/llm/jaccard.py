"""N-gram Jaccard join with signature trees.

A text's set holds the hashes of its distinct word shingles.  Texts with equal sets form a class
and count as one.  Two classes link when 100 * intersection >= percent * union.

Candidates come in two layers, both without loss:

* Shingles in hash order: linked sets share one among the first n - ceil(percent * n) + 1 of each.
  With `slack` more, they share slack + 1, or all they have in common if that is less.  A set with fewer
  hot shingles (held by more than ``HOT`` sets) can do without those: a passage that many documents
  quote forms no group.
* Over the sets that share a shingle stands a signature tree: leaves are sets with a bitmap of their
  shingles, inner nodes hold OR-combined bitmaps and size ranges.  A dual traversal drops node pairs
  whose largest possible overlap (by sizes and common bits) cannot reach the threshold, and those
  already known to be connected.

Sets that share one of their least ``HOMES`` common shingles are first joined exactly in one place,
so a large group of near copies costs about as many checks as it has members; only pairs of
different components are searched afterwards.  Groups with the same members, as the many shingles of one family have, are
treated once.  Surviving pairs are verified on the full sets.

Defined results: null and empty texts, and texts without words, have an empty set and link with
nothing; a text shorter than the shingle has its whole sequence as one; copies share a class and a
component also when they are whole repeated rows; null ids take part and get the least id of their
component (null if there is none); only ``doc_id`` and ``text`` are read.

Sets are known by a 64-bit hash of their content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atrium.llm.words import long_lists, mix, shingles, slices, word_hashes, words
from atrium.operators.graphs import connected_components
from atrium.session import cut_lineage, scratch_path

HOT = 64  # sets that hold a shingle, above which it is hot
GROUP = 4096  # sets that are joined or traversed together
BROADCAST_ROWS = 200_000  # of three numbers at most
HOMES = 3  # groups in which a set is joined in place
SHINGLES = 4 << 20  # shingles of the sets that are joined together
PAIRS = 1 << 18  # bitmap words of the node pairs expanded at once


def _slack(n):
    """Additional shingles in the prefix of a set of n; grows with n."""
    return 8 + n // 16


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a (cut) table of proven size; larger ones are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _need(n, percent):
    return -(-n * percent // 100)


def _prefix(n, percent):
    return n - _need(n, percent) + 1 + _slack(n)


def _bits(n: int) -> int:
    """Signature length for a set of n shingles: a power of two, two bits a shingle or more."""
    return max(64, 2 << max(0, int(n) - 1).bit_length())


def signature(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of a set: one bit per shingle hash, as 64-bit words."""
    out = np.zeros(bits, np.uint8)
    out[(mix(tokens) % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def fold(sig: np.ndarray, words_out: int) -> np.ndarray:
    """Shorten bitmaps (rows) by OR-ing their parts, as if made with fewer bits."""
    return np.bitwise_or.reduce(sig.reshape(len(sig), -1, words_out), axis=1)


def _digest(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((mix(tokens + np.uint64(len(tokens))) * mix(tokens)).sum(dtype=np.uint64).view(np.int64))


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, text_key, n (set size), node (content hash of the set), prefix, bitmap."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(batch.column("text"), lower=True)
            sets = shingles(w, word_hashes(w), width)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.int64()),
                long_lists([s[:_prefix(len(s), percent)] for s in sets]),
                pa.array([signature(s, _bits(len(s))).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], names=["doc_id", "text_key", "n", "node", "prefix", "bitmap"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(make, "doc_id long, text_key long, n long, node long, prefix array<long>, bitmap binary")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, tokens) for the classes in ``wanted`` (node, rep_id, rep_key), one text each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(batch.column("text"), lower=True)
            yield pa.RecordBatch.from_arrays([batch.column("node"), long_lists(shingles(w, word_hashes(w), width))], names=["node", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep_id"), F.xxhash64("text").alias("rep_key"), "text").alias("d")
    chosen = wanted.alias("w")
    same = (F.col("d.rep_key") == F.col("w.rep_key")) & F.col("d.rep_id").eqNullSafe(F.col("w.rep_id"))
    return rows.join(chosen, same).select("w.node", "d.text").mapInArrow(make, "node long, tokens array<long>")


def candidate_pairs(group: np.ndarray, n: np.ndarray, sig: np.ndarray, comp: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs of equal ``group`` that may link and are of different ``comp``: the dual traversal.

    Leaves come sorted by group and size.  All groups are walked at once, level by level; wide
    levels are walked in pieces, so memory stays bounded.
    """
    count = np.bitwise_count(sig).sum(axis=1).astype(np.int64)
    levels = [{"g": group, "lo": n, "hi": n, "spare": n - count, "sig": sig, "c0": comp, "c1": comp}]
    while True:
        low = levels[-1]
        first = np.flatnonzero(np.r_[True, low["g"][1:] != low["g"][:-1]])
        if len(first) == len(low["g"]):
            break
        place = np.arange(len(low["g"])) - np.repeat(first, np.diff(np.r_[first, len(low["g"])]))
        start = np.flatnonzero(place % 2 == 0)
        levels.append({
            "g": low["g"][start], "lo": np.minimum.reduceat(low["lo"], start), "hi": np.maximum.reduceat(low["hi"], start),
            "spare": np.maximum.reduceat(low["spare"], start), "sig": np.bitwise_or.reduceat(low["sig"], start, axis=0),
            "c0": np.minimum.reduceat(low["c0"], start), "c1": np.maximum.reduceat(low["c1"], start),
            "child": start, "children": np.diff(np.r_[start, len(low["g"])])})

    def open_pairs(level: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fits = (100 * level["hi"][a] >= percent * level["lo"][b]) & (100 * level["hi"][b] >= percent * level["lo"][a])
        one = (level["c0"][a] == level["c1"][a]) & (level["c0"][b] == level["c1"][b]) & (level["c0"][a] == level["c0"][b])
        at = np.flatnonzero(fits & ~one)
        a, b = a[at], b[at]
        common = np.bitwise_count(level["sig"][a] & level["sig"][b]).sum(axis=1).astype(np.int64)
        most = np.minimum(np.minimum(level["hi"][a], level["hi"][b]), common + np.minimum(level["spare"][a], level["spare"][b]))
        return at[(100 + percent) * most >= percent * (level["lo"][a] + level["lo"][b])]

    piece = max(256, PAIRS // sig.shape[1])

    def walk(depth: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if depth == 0:
            other = a != b
            yield a[other], b[other]
            return
        for at in range(0, len(a), piece):
            x, y, level = a[at:at + piece], b[at:at + piece], levels[depth]
            left, right = [], []
            for i in (0, 1):
                for j in (0, 1):
                    ok = (i < level["children"][x]) & (j < level["children"][y])
                    u, v = level["child"][x[ok]] + i, level["child"][y[ok]] + j
                    keep = (x[ok] != y[ok]) | (u <= v)
                    left.append(u[keep])
                    right.append(v[keep])
            u, v = np.concatenate(left), np.concatenate(right)
            keep = open_pairs(levels[depth - 1], u, v)
            if len(keep):
                yield from walk(depth - 1, u[keep], v[keep])

    top = np.arange(len(levels[-1]["g"]))
    yield from walk(len(levels) - 1, top, top)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def join_in_place(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component label (a node of the component) of each set of one group, by exact checks."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    sets = [sets[i] for i in order]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def check(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])):
            common = overlap(sets[i], sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[max(a, b)] = min(a, b)

    # near copies mostly link with the set whose shingles are the most common; go on with what it leaves
    flat = np.concatenate(sets)
    _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    first = np.r_[0, np.cumsum([len(s) for s in sets])]
    common = np.add.reduceat(count[back], first[:-1]) / np.diff(first)
    rest = list(np.argsort(-common, kind="stable"))
    while len(rest) > 1:
        center = rest[0]
        for i in rest[1:]:
            check(center, i)
        left = [i for i in rest[1:] if root(i) != root(center)]
        if len(left) == len(rest) - 1:
            break
        rest = left
    n = np.array([len(s) for s in sets], np.int64)
    comp = np.array([root(i) for i in range(len(sets))], np.int64)
    width = max(64, _bits(int(np.median(n))))
    sig = np.stack([signature(s, width) for s in sets])
    for a, b in candidate_pairs(np.zeros(len(sets), np.int64), n, sig, comp, percent):
        now = np.array([root(i) for i in range(len(sets))], np.int64)
        apart = now[a] != now[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            check(i, j)
    label = np.empty(len(sets), np.int64)
    label[order] = [nodes[order[root(i)]] for i in range(len(sets))]
    return label


def _join_groups(percent: int):
    def join(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        _, at = np.unique(node, return_index=True)
        tokens = rows.column("tokens").combine_chunks()
        sets = [tokens[int(i)].values.to_numpy(zero_copy_only=False).view(np.uint64) for i in at]
        return pa.table({"node": node[at], "comp": join_in_place(node[at], sets, percent)})
    return join


def _search_groups(percent: int):
    """Candidate pairs of each (token, one, two) group; rows come sorted by it and a group may span batches."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = _group_keys(held)
            last = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1]
            if last and held.num_rows >= 20_000:
                yield from _search(held.slice(0, last), key[:last], percent)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from _search(held, _group_keys(held), percent)
    return search


def _group_keys(rows: pa.Table) -> np.ndarray:
    cols = [rows.column(c).to_numpy() for c in ("token", "one", "two")]
    new = np.zeros(rows.num_rows, bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _search(rows: pa.Table, key: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    node, n, comp, block = (rows.column(c).to_numpy() for c in ("node", "n", "comp", "block"))
    apart = rows.column("one").to_numpy() != rows.column("two").to_numpy()
    homes = [rows.column(f"home{i}").to_numpy() for i in range(HOMES)]
    maps = rows.column("bitmap").combine_chunks()
    size = np.array([_bits(x) for x in n.tolist()], np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for bits in np.unique(size):
        own = np.flatnonzero((size == bits) | (size == 2 * bits))  # sizes that may link differ by less than two
        own = own[np.lexsort((node[own], n[own], key[own]))]
        sig = np.stack([fold(np.frombuffer(maps[int(i)].as_buffer(), np.uint64)[None, :], bits // 64)[0] for i in own])
        for a, b in candidate_pairs(key[own], n[own], sig, comp[own], percent):
            a, b = own[a], own[b]
            keep = ((size[a] == bits) | (size[b] == bits)) & (~apart[a] | (block[a] != block[b])) & (node[a] != node[b])
            for h in homes:
                for g in homes:  # joined in one place already
                    keep &= (h[a] != g[b]) | (h[a] == 0)
            left.append(np.minimum(node[a], node[b])[keep])
            right.append(np.maximum(node[a], node[b])[keep])
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])


def _members() -> list:
    return [F.count("*").alias("held"), F.min("node").alias("lead"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("mark")]


def distinct_groups(groups: DataFrame, key: str) -> DataFrame:
    """One of all groups with the same members; ``groups``: key, held, lead (least member), last, mark (of the members' hashes)."""
    return groups.groupBy("held", "lead", "last", "mark").agg(
        F.min(key).alias(key), *(F.first(c).alias(c) for c in groups.columns if c not in (key, "held", "lead", "last", "mark")))


def link_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, node (its class), root (its component), component_id (least doc_id reachable by links), text_key."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "profiles")
    profiles(docs, width, percent).write.parquet(folder)
    rows = spark.read.parquet(folder)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    reps = cut_lineage(rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), least.alias("rep"))
                       .select("node", "n", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")))
    # copies of a class's first text go
    same = (F.col("r.node") == F.col("p.node")) & (F.col("r.text_key") == F.col("p.rep_key")) & F.col("r.doc_id").eqNullSafe(F.col("p.rep_id"))
    ids = rows.filter("n > 0").select("node", "doc_id", "text_key")
    copies = cut_lineage(ids.alias("r").join(reps.alias("p"), same, "left_anti").distinct())
    again = (F.col("r.text_key") == F.col("c.text_key")) & F.col("r.doc_id").eqNullSafe(F.col("c.doc_id"))
    one = rows.filter("n > 0").alias("r").join(small(copies).alias("c"), again, "left_anti")
    # shingles that two classes or more have in their prefixes; classes with too few of them cannot link
    entries = one.select(F.explode("prefix").alias("token"), "node")
    shared = entries.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    kept = cut_lineage(entries.join(shared, "token"))
    need = F.floor((F.col("n") * percent + 99) / 100).cast("long")  # also the least size of a set it may link with
    slack = 8 + F.shiftright(need, 4)
    sizes = reps.select("node", "n")
    for _ in range(2):
        own = kept.groupBy("node").agg(F.count("*").alias("own")).join(sizes, "node")
        able = own.filter(F.col("own") >= F.least(slack + 1, need)).select("node")
        kept = kept.drop("held").join(able, "node", "left_semi")
        kept = cut_lineage(kept.join(kept.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1"), "token"))
    kept = kept.withColumn("hot", F.col("held") > HOT)
    hot = kept.filter("hot")
    full = hot.groupBy("node").agg(F.count("*").alias("hots")).join(sizes, "node").filter(F.col("hots") >= F.least(slack + 1, need)).select("node")
    kept = cut_lineage(kept.filter("NOT hot").unionByName(hot.join(full, "node", "left_semi")).select("token", "node"))
    # classes that share one of their least tokens are joined in place
    least_tokens = F.row_number().over(W.partitionBy("node").orderBy("token"))
    key = kept.withColumn("nth", least_tokens).filter(F.col("nth") <= HOMES).select("node", F.col("token").alias("key"))
    groups = distinct_groups(key.join(sizes, "node").groupBy("key").agg(*_members(), F.sum("n").alias("shingles")).filter("held > 1"), "key")
    chunks = F.ceil(F.greatest(F.col("held") / GROUP, F.col("shingles") / SHINGLES)).cast("int")
    homes = key.join(groups, "key").withColumn("chunk", F.when(F.col("node") == F.col("lead"), F.sequence(F.lit(0), chunks - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node"), chunks).cast("int")))).select("node", "key", (chunks == 1).alias("whole"), F.explode("chunk").alias("chunk"))
    homes = cut_lineage(homes)
    done = homes.filter("whole").groupBy("node").agg(F.collect_list("key").alias("keys"))
    sets = full_sets(docs, small(cut_lineage(homes.select("node").distinct().join(reps, "node"))), width)
    joined = sets.join(homes, "node").groupBy("key", "chunk").applyInArrow(_join_groups(percent), "node long, comp long")
    ties = cut_lineage(joined.filter("node <> comp").distinct())
    met = ties.select("node").union(ties.select("comp")).distinct()
    comps = cut_lineage(connected_components(ties, met, [], "node", "node", "comp", "root").select("node", F.col("root").alias("comp")))
    # what different components share a shingle is searched with signature trees
    known = kept.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    bitmaps = one.select("node", "n", "bitmap").join(done, "node", "left").select(
        "node", "n", "bitmap", *(F.coalesce(F.get("keys", F.lit(i)), F.lit(0)).alias(f"home{i}") for i in range(HOMES)))
    mixed = known.groupBy("token").agg(*_members(), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1")
    mixed = distinct_groups(mixed, "token")
    blocks = F.ceil(F.col("held") / GROUP).cast("int")
    spread = known.join(mixed.select("token", "held"), "token").join(bitmaps, "node").withColumn("blocks", blocks) \
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("token", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "node", "n", "comp", "bitmap",
                           *(f"home{i}" for i in range(HOMES)))
    found = spread.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two").mapInArrow(_search_groups(percent), "u long, v long")
    pairs = cut_lineage(found.distinct())
    ends = cut_lineage(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(reps, "node"))
    sets = full_sets(docs, small(ends), width)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("left")), "u") \
        .join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("right")), "v")
    common = F.size(F.array_intersect("left", "right"))
    links = both.withColumn("common", common).filter(100 * F.col("common") >= percent * (F.size("left") + F.size("right") - F.col("common")))
    edges = links.select("u", "v").union(ties.select("node", "comp"))
    linked = connected_components(edges, reps.select("node"), [], "node", "u", "v", "root")
    named = cut_lineage(linked.join(reps, "node").select("node", "root", "rep_id"))
    names = named.groupBy("root").agg(F.min("rep_id").alias("component_id"))
    named = named.join(names, "root").select("node", "root", "component_id")
    out = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Rows of ``docs`` with one row for each component: that of the least doc_id, of the least text hash among rows without an id.

    Rows are told apart by id and text, so a null id is compared like any other; of repeated rows
    (same id and text) one stays, whatever else they hold.  Texts without words are linked with
    nothing and all stay; only ``doc_id`` and ``text`` decide; an empty table stays empty.
    """
    found = cut_lineage(link_components(docs, width, percent).filter("n_shingles > 0").select("doc_id", "text_key", "root"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    groups = found.groupBy("root").agg(F.count("*").alias("held"), F.min(rank).alias("first")).filter("held > 1")
    judged = found.join(groups, "root").withColumn("_first", F.col("text_key").eqNullSafe(F.col("first.text_key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    judged = cut_lineage(judged.groupBy("doc_id", "text_key", "_first").agg(F.count("*").alias("n")))
    key = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key")).alias("_key")
    keyed = docs.select(key, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    listed = judged.select(F.struct(F.col("doc_id").alias("id"), "text_key").alias("_key"), "_first", "n")
    stay = keyed.join(small(cut_lineage(listed.filter("NOT _first OR n > 1").select("_key"))), "_key", "left_anti")
    # the few first rows that are repeated: one of each
    again = keyed.join(small(cut_lineage(listed.filter("_first AND n > 1").select("_key"))), "_key", "left_semi")
    plain = [F.col(f"_row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = again.groupBy("_key").agg(F.min_by("_row", F.xxhash64(*plain)).alias("_row"))
    return stay.select("_row").unionByName(one.select("_row")).select("_row.*")
