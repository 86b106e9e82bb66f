"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, one line per component.

Lines are the \\n-separated parts of a text, compared without outer white space.  Equal lines are
one node.  A line's set holds its ``WIDTH``-byte shingles (a shorter line is one shingle); its
signature has one minimum in each of ``BANDS`` * ``ROWS`` classes of shingle hashes, empty classes
borrowing from the next.  Lines that agree in a whole band are candidates; pairs with Jaccard
similarity of at least ``SIMILARITY`` link, and of every connected component only the first
occurrence (least doc_id, line number) stays.

At similarity 0.8, 8 bands of 4 find a pair with probability 0.985, at 0.9 with 0.9998.  Of a band with up to ``ALL_PAIRS``
lines all pairs are candidates.  Larger ones are joined in one place, in blocks of ``BLOCK`` lines
(fewer where they hold more than ``BLOCK_BYTES``) of which every two meet: a line is compared with each component until one member is similar, so a band
of near copies costs about as many comparisons as it has lines, and no link between components is lost.
Bands with the same lines (told by number, least, greatest and two 64-bit marks) are looked at once.

Defined results: blank lines are never removed and never removed for; null and empty texts have no
lines and keep the empty text; a line repeated in one text stays once there at most; rows without an
id come last; repeated rows count as one occurrence each, and lose or keep their lines together.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.llm.words import _BYTE, _SEPARATOR, mix, runs, slices, text_bytes
from atrium.operators.graphs import connected_components
from atrium.session import cut_lineage, scratch_path

WIDTH = 8
BANDS, ROWS = 8, 4
SIMILARITY = 0.8
ALL_PAIRS = 16
BLOCK = 512
BLOCK_BYTES = 1 << 20
PAIR_BYTES = 1 << 20
CLOSE_CALL = 2
BROADCAST_ROWS = 200_000  # of one number
LINES = "doc_id long, text_key long, line_no int, line long, size int, bands array<long>"


def line_ranges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, first byte, last byte + 1) of every line with something in it, outer white space cut."""
    newline = np.flatnonzero(data == 10)
    begin = np.union1d(at[:-1][np.diff(at) > 0], newline + 1)
    begin = begin[begin < len(data)]
    text = np.searchsorted(at, begin, "right") - 1
    stop = np.minimum(np.r_[newline, len(data)][np.searchsorted(newline, begin)], at[text + 1])
    first = np.searchsorted(text, text)
    number = np.arange(len(text)) - first
    solid = np.flatnonzero(~_SEPARATOR[data])
    lo, hi = np.searchsorted(solid, begin), np.searchsorted(solid, stop)
    full = hi > lo
    return text[full], number[full], solid[lo[full]], solid[hi[full] - 1] + 1


def shingle_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of every shingle of the byte ranges, in order."""
    count = np.maximum(end - begin - width + 1, 1)
    line = np.repeat(np.arange(len(begin)), count)
    start = begin[line] + np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    if len(data) >= width:
        total = np.zeros(len(data), np.uint64)
        for k in range(width):
            total[:len(data) - width + 1] *= np.uint64(0x100000001B3)
            total[:len(data) - width + 1] += _BYTE[data[k:len(data) - width + 1 + k]]
        found = mix(total[np.minimum(start, len(data) - width)])
    else:
        found = np.zeros(len(line), np.uint64)
    short = np.flatnonzero(end - begin < width)
    if len(short):
        found[np.searchsorted(line, short)] = runs(_BYTE[data], begin[short], end[short])
    return line, found


def band_keys(line: np.ndarray, found: np.ndarray, lines: int, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Hash per line and band from one permutation: the least hash of each class, empty classes borrow from the next."""
    classes = bands * rows
    least = np.full(lines * classes, np.iinfo(np.uint64).max, np.uint64)
    cell = line * classes + ((found >> np.uint64(32)) * np.uint64(classes) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, cell, found)
    least = least.reshape(lines, classes)
    for _ in range(classes):
        empty = least == np.iinfo(np.uint64).max
        if not empty.any():
            break
        least = np.where(empty, np.roll(least, -1, axis=1), least)
    out = np.zeros((lines, bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            out[:, b] = mix(out[:, b] ^ least[:, b * rows + r]) + np.uint64(b + 1)
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, at = text_bytes(batch.column("text"))
        text, number, begin, end = line_ranges(data, at)
        name = runs(_BYTE[data], begin, end) if len(begin) else np.zeros(0, np.uint64)
        once = np.zeros(len(begin), bool)
        once[np.unique(name, return_index=True)[1]] = True  # a line's bands are given once a slice
        line, found = shingle_hashes(data, begin[once], end[once]) if len(begin) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        keys = band_keys(line, found, int(once.sum()))
        at_key = np.r_[0, np.cumsum(once * BANDS)].astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(pa.array(text)), batch.column("text_key").take(pa.array(text)), pa.array(number.astype(np.int32)),
            pa.array(name.view(np.int64)), pa.array((end - begin).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(at_key), pa.array(keys.ravel().view(np.int64))),
        ], names=["doc_id", "text_key", "line_no", "line", "size", "bands"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, at = text_bytes(batch.column("text"))
        _, _, begin, end = line_ranges(data, at)
        name = runs(_BYTE[data], begin, end) if len(begin) else np.zeros(0, np.uint64)
        name, once = np.unique(name, return_index=True)
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays([
            pa.array(name.view(np.int64)), pa.array([raw[a:b] for a, b in zip(begin[once].tolist(), end[once].tolist())], pa.binary())],
            names=["line", "content"])


def jaccard(x: bytes, y: bytes, width: int = WIDTH) -> float:
    a, b = ({s[i:i + width] for i in range(max(1, len(s) - width + 1))} for s in (x, y))
    return len(a & b) / len(a | b)


def overlaps(left: list[bytes], right: list[bytes], least: float) -> np.ndarray:
    """Whether the Jaccard similarity of each pair of (different) lines is at least ``least``.

    The shingles of all pairs are sorted at once, as pair, hash and side.  A hash clash could shift a count by one or
    two, so pairs within ``CLOSE_CALL`` shingles of the bound are decided by their sets of bytes.  A line shorter than
    a shingle is its own only one and meets no other line.
    """
    n = len(left)
    count = np.array([max(len(s) - WIDTH + 1, 0) for s in (*left, *right)], np.int64)
    data = np.frombuffer(b"".join((*left, *right)), np.uint8)
    if not count.any():
        return np.zeros(n, bool)
    number = np.zeros(len(data) - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        number = number << np.uint64(8) | data[k:len(data) - WIDTH + 1 + k]
    at = np.r_[0, np.cumsum([len(s) for s in (*left, *right)])[:-1]]
    line = np.repeat(np.arange(2 * n), count)
    start = at[line] + np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    bits = np.uint64(62 - n.bit_length())
    key = (line % n).astype(np.uint64) << bits | mix(number)[start] >> (np.uint64(64) - bits)
    key = np.sort(key << np.uint64(1) | (line >= n).astype(np.uint64))
    value = key >> np.uint64(1)
    pair = (value >> bits).astype(np.int64)
    same = value[1:] == value[:-1]
    union = np.bincount(pair[np.r_[True, ~same]], minlength=n)
    common = np.bincount(pair[1:][same & (key[1:] != key[:-1])], minlength=n)
    out = common >= least * union
    for i in np.flatnonzero(np.abs(common - least * union) <= CLOSE_CALL).tolist():
        out[i] = jaccard(left[i], right[i]) >= least
    return out


def _similar(least: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.add(pc.binary_length(batch.column("left")), pc.binary_length(batch.column("right"))).to_numpy(zero_copy_only=False).astype(np.int64))
            begin = 0
            while begin < batch.num_rows:
                stop = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + PAIR_BYTES, "right")))
                part = batch.slice(begin, stop - begin)
                alike = overlaps(part.column("left").to_pylist(), part.column("right").to_pylist(), least)
                yield part.select(["u", "v"]).filter(pa.array(alike))
                begin = stop
    return check


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a (cut) table of proven size; larger ones are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _join_block(least: float):
    """Links that connect what is similar among some lines: each line is compared with a component until one member is similar."""
    def join(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("line").to_numpy(), kind="stable")
        name, content = rows.column("line").to_numpy()[order].tolist(), [rows.column("content")[int(i)].as_py() for i in order]
        components: list[list[tuple[int, set[bytes]]]] = []
        links = []
        for line, text in zip(name, content):
            own = {text[i:i + WIDTH] for i in range(max(1, len(text) - WIDTH + 1))}
            met = []
            for component in components:
                for other, its in component:
                    small_, large = sorted((len(own), len(its)))
                    if small_ >= least * large and (common := len(own & its)) >= least * (small_ + large - common):
                        links.append((other, line))
                        met.append(component)
                        break
            joined = [(line, own)]
            for component in met:
                joined = component + joined
            components = [c for c in components if not any(c is m for m in met)] + [joined]
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})
    return join


def link_lines(rows: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(line, root) of the lines that link with another one; ``rows``: line, size, bands; ``docs`` holds their texts."""
    member = rows.select("line", "size", F.explode("bands").alias("band"))
    full = member.groupBy("band").agg(F.min("line").alias("least"), F.max("line").alias("most")).filter("least < most").select("band")
    member = cut_lineage(member.join(small(cut_lineage(full)), "band", "left_semi").distinct())
    marks = [F.count("*").alias("held"), F.min("line").alias("least"), F.max("line").alias("most"),
             F.bit_xor(F.xxhash64("line")).alias("mark"), F.bit_xor(F.xxhash64("line", F.lit(1))).alias("other_mark")]
    alike = member.groupBy("band").agg(*marks, F.sum("size").alias("bytes")).groupBy("held", "least", "most", "mark", "other_mark", "bytes")
    member = cut_lineage(member.join(alike.agg(F.min("band").alias("band")).select("band", "held", "bytes"), "band"))
    wanted = small(cut_lineage(member.select("line").distinct()))
    texts = docs.select("text").mapInArrow(_contents, "line long, content binary").join(wanted, "line", "left_semi")
    texts = cut_lineage(texts.groupBy("line").agg(F.min("content").alias("content")))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
        both = pairs.join(texts.select(F.col("line").alias("u"), F.col("content").alias("left")), "u") \
            .join(texts.select(F.col("line").alias("v"), F.col("content").alias("right")), "v")
        return cut_lineage(both.mapInArrow(_similar(least), "u long, v long"))

    few = member.filter(F.col("held") <= ALL_PAIRS)
    links = verified(few.select("band", F.col("line").alias("u")).join(few.select("band", F.col("line").alias("v")), "band").filter("u < v"))
    # crowded bands are joined in one place, in blocks; every two blocks meet
    blocks = F.ceil(F.greatest(F.col("held") / BLOCK, F.least(F.col("bytes") / BLOCK_BYTES, F.col("held")))).cast("int")
    crowd = member.filter(F.col("held") > ALL_PAIRS).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int")) \
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    crowd = crowd.select("band", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "line").join(texts, "line")
    inner = crowd.groupBy("band", "one", "two").applyInArrow(_join_block(least), "u long, v long")
    links = cut_lineage(links.union(inner).distinct())
    met = links.select(F.col("u").alias("line")).union(links.select("v")).distinct()
    return cut_lineage(connected_components(links, met, [], "line", "u", "v", "root"))


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, kept = [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            parts = text.split("\n") if text else []
            out = set(gone)
            count.append(len(parts))
            kept.append("\n".join(p for i, p in enumerate(parts) if i not in out))
        removed = [len(g) for g in batch.column("gone").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                         names=["doc_id", "n_lines", "n_removed", "kept_text"])


def dedup_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_text (remaining lines joined by \\n)."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    folder = scratch_path(spark, "lines")
    keyed.mapInArrow(_lines, LINES).write.parquet(folder)
    rows = spark.read.parquet(folder)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "line_no")
    firsts = cut_lineage(rows.groupBy("line").agg(F.min(place).alias("at"), F.count("*").alias("times")))
    roots = link_lines(rows.select("line", "size", "bands"), docs, least)
    named = firsts.join(roots, "line", "left").withColumn("root", F.coalesce("root", "line"))
    keep = named.groupBy("root").agg(F.min("at").alias("keep"), F.sum("times").alias("times")).filter("times > 1")
    crowded = cut_lineage(named.join(keep.drop("times"), "root").select("line", "keep"))
    same_place = (F.col("text_key") == F.col("keep.text_key")) & (F.col("line_no") == F.col("keep.line_no")) & F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
    gone = rows.select("line", "doc_id", "text_key", "line_no").join(crowded, "line").filter(~same_place)
    gone = gone.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("gone"))
    same = (F.col("d.text_key") == F.col("g.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id"))
    none = F.array().cast("array<int>")
    return keyed.alias("d").join(gone.alias("g"), same, "left").select("d.doc_id", "d.text", F.coalesce("g.gone", none).alias("gone")) \
        .mapInArrow(_drop, "doc_id long, n_lines long, n_removed long, kept_text string")


def lines_digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
