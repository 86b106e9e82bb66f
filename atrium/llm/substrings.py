"""Substring dedup with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one text; the words of every window that also stands
anywhere else go.  Equal windows have equal minimizers (the least hash among their runs of ``GRAM``
words), so texts are cut into segments of windows with one minimizer, and segments whose minimizer
occurs once are done with.  The others, one of each content with its count, go to the shard of
their minimizer.  Each shard builds an FM-index over its segments; backward search over a wavelet
matrix computes matching statistics and reports the intervals that occur twice or more.

Runs of words that make up more than one in ``SHARE`` minimizers rank last, so that a short line
which many texts hold does not gather their surroundings in one shard; there are at most ``SHARE`` of
them.  Words and whole texts are known by 64-bit hashes, so copies share their segments.

Defined results: null and empty texts have no words and keep the empty text; texts shorter than a
window stay whole; repeated rows remove each other's windows and keep the rest; windows are judged on
the input; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.llm.fm_index import FMIndex, repeated_intervals
from atrium.llm.words import Words, long_lists, runs, slices, word_hashes, words
from atrium.session import cut_lineage, scratch_path

WINDOW = 35
GRAM = 8
SHARE = 50_000
SHARD_ROWS = 16_000  # segments per shard or so
NUMBERS = 2_000_000  # rows of one to four 64-bit numbers that may be broadcast
SEGMENT = "text_key long, place long, minimizer long, content long"  # place: first window * 64 + windows


def _hash_keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def segments(w: Words, hashes: np.ndarray, hot: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, minimizer) of every segment of the texts, by word number."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - gram + 1)
    grams = runs(hashes, at, at + gram) >> np.uint64(1)
    if len(hot):
        found = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        grams = np.where(hot[found] == grams, grams | np.uint64(1 << 63), grams)
    least = _slide(grams, window - gram + 1)
    room = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(hashes))  # words left in the text
    start = np.flatnonzero(room[:len(least)] >= window)
    if not len(start):
        return none, none, np.zeros(0, np.uint64)
    value = least[start]
    # a segment also ends where the least run itself leaves, so that equal windows of one text are in two segments
    new = np.r_[True, (start[1:] != start[:-1] + 1) | (value[1:] != value[:-1]) | (grams[start[:-1]] == value[:-1])]
    cut = np.flatnonzero(new)
    return start[cut], np.diff(np.r_[cut, len(start)]), value[cut]


def _minimizers(hot: np.ndarray, window: int, gram: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0, np.uint64)]
        for batch in slices(batches):
            w = words(batch.column("text"))
            seen.append(segments(w, word_hashes(w), hot, window, gram)[2])
        value, n = np.unique(np.concatenate(seen), return_counts=True)  # one number per 15 words of the task's input
        often = n > 1  # what is frequent in the table is seen twice by some task; the choice of hot runs is free
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[value[often].view(np.int64), np.int64(0)]), pa.array(np.r_[n[often], 0]),
            pa.array(np.r_[np.zeros(int(often.sum()), np.int64), n.sum()])], names=["minimizer", "n", "all"])
    return count


def _cut(hot: np.ndarray, window: int, gram: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(batch.column("text"))
            hashes = word_hashes(w)
            first, count, value = segments(w, hashes, hot, window, gram)
            text = np.searchsorted(w.first, first, "right") - 1
            yield pa.RecordBatch.from_arrays([
                batch.column("text_key").take(pa.array(text)), pa.array((first - w.first[text]) * 64 + count), pa.array(value.view(np.int64)),
                pa.array(runs(hashes, first, first + count + window - 1).view(np.int64)) if len(first) else pa.array([], pa.int64()),
            ], names=["text_key", "place", "minimizer", "content"])
    return cut


def _contents(window: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(batch.column("text"))
            hashes = word_hashes(w)
            cuts = batch.column("cuts")
            at = cuts.offsets.to_numpy()
            text = np.repeat(np.arange(batch.num_rows), np.diff(at))
            flat = cuts.flatten()
            pos, count = np.divmod(flat.field("place").to_numpy(), 64)
            begin = w.first[text] + pos
            yield pa.RecordBatch.from_arrays([
                flat.field("minimizer"), flat.field("content"), flat.field("n"),
                long_lists([hashes[a:b] for a, b in zip(begin, begin + count + window - 1)])], names=["minimizer", "content", "n", "words"])
    return read


def _search(window: int):
    """One shard: index all its segments, report for each a bit per window that occurs twice or more."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = pa.Table.from_batches(held) if held else None
        if rows is None or not rows.num_rows:
            return
        # whole repeated rows bring a content more than once; its count holds them all
        _, once = np.unique(np.stack([rows.column("minimizer").to_numpy(), rows.column("content").to_numpy()], axis=1), axis=0, return_index=True)
        rows = rows.take(pa.array(once)).combine_chunks()
        lists = rows.column("words").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        _, symbol = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        begin = np.r_[0, np.cumsum(size + 1)[:-1]].astype(np.int64)
        text = np.zeros(int((size + 1).sum()), np.int64)
        piece = np.repeat(np.arange(len(size)), size)
        text[np.arange(len(symbol)) + piece] = symbol + 1
        weight = np.repeat(rows.column("n").to_numpy(), size + 1)
        index = FMIndex(text, weight)
        mask = np.zeros(len(size), np.int64)
        for of, left, right in repeated_intervals(index, text, begin, begin + size, window):
            first, count = left - begin[of], right - left - window + 1
            np.bitwise_or.at(mask, of, ((np.int64(1) << count) - 1) << first)
        some = pa.array(np.flatnonzero(mask))
        yield pa.RecordBatch.from_arrays([
            rows.column("minimizer").take(some).combine_chunks(), rows.column("content").take(some).combine_chunks(), pa.array(mask[mask != 0])],
            names=["minimizer", "content", "mask"])
    return search


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(batch.column("text"))
            found = batch.column("found")
            at = found.offsets.to_numpy()
            text = np.repeat(np.arange(batch.num_rows), np.diff(at))
            flat = found.flatten()
            change = np.zeros(len(w.start) + 1, np.int32)
            if len(flat):
                bits = np.unpackbits(flat.field("mask").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, offset = np.nonzero(bits)
                first = w.first[text[row]] + flat.field("place").to_numpy()[row] // 64 + offset
                np.add.at(change, first, 1)
                np.add.at(change, first + window, -1)
            stays = np.cumsum(change)[:-1] == 0
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(w.first)), pa.array(np.diff(np.r_[0, np.cumsum(~stays)][w.first])),
                joined(w, stays)], names=["doc_id", "n_words", "n_removed", "kept_text"])
    return remove


def joined(w: Words, stays: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between them."""
    data = np.r_[w.data, np.uint8(32)]
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, w.start[stays], 1)
    np.add.at(keep, w.end[stays], -1)
    keep = np.cumsum(keep)[:-1].astype(bool)
    kept = np.flatnonzero(stays)
    text = np.searchsorted(w.first, kept, "right") - 1
    inner = kept[:-1][text[:-1] == text[1:]] if len(kept) else kept  # words that another one follows in the same text
    data[w.end[inner]] = 32
    keep[w.end[inner]] = True
    size = np.r_[0, np.cumsum(keep)][w.at]
    return pa.LargeStringArray.from_buffers(len(w.at) - 1, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[keep].tobytes())).cast(pa.string())


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, share: int = SHARE) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    spark, keyed = docs.sparkSession, _hash_keys(docs)
    counts = keyed.mapInArrow(_minimizers(np.zeros(0, np.uint64), window, gram), "minimizer long, n long, all long") \
        .groupBy("minimizer").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    counts = cut_lineage(counts.filter("n > 1000 OR minimizer = 0"))
    total = counts.agg(F.sum("all")).first()[0] or 0
    hot = counts.filter(F.col("n") > total / share).select("minimizer").collect()  # fewer than `share`
    hot = np.sort(np.array([r[0] for r in hot], np.int64).view(np.uint64))

    folder = scratch_path(spark, "segments")
    keyed.mapInArrow(_cut(hot, window, gram), SEGMENT).write.parquet(folder)
    cut = spark.read.parquet(folder)
    shared = cut_lineage(cut.groupBy("minimizer").agg(F.count("*").alias("held")).filter("held > 1").select("minimizer"))
    hits = cut_lineage(cut.join(F.broadcast(shared) if shared.count() <= NUMBERS else shared, "minimizer"))
    distinct = hits.groupBy("minimizer", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("text_key", "place")).alias("at"))
    distinct = cut_lineage(distinct.select("minimizer", "content", "n", "at.text_key", "at.place"))
    wanted = distinct.groupBy("text_key").agg(F.collect_list(F.struct("minimizer", "content", "n", "place")).alias("cuts"))
    one = keyed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))  # of many copies one is read
    same = (F.col("d.text_key") == F.col("x.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("x.doc_id"))
    wanted = wanted.join(one, "text_key")
    pieces = distinct.count()
    wanted = F.broadcast(wanted) if pieces <= NUMBERS else wanted  # four numbers a piece (64 MB at most); else the texts are shuffled
    contents = keyed.alias("d").join(wanted.alias("x"), same).select("d.text", "x.cuts").mapInArrow(
        _contents(window), "minimizer long, content long, n long, words array<long>")
    shards = max(8, -(-pieces // SHARD_ROWS))
    masks = contents.repartition(shards, "minimizer").mapInArrow(_search(window), "minimizer long, content long, mask long")
    marks = hits.join(cut_lineage(masks), ["minimizer", "content"]).groupBy("text_key").agg(F.collect_set(F.struct("place", "mask")).alias("found"))
    none = F.array().cast("array<struct<place:bigint,mask:bigint>>")
    return keyed.join(marks, "text_key", "left").select("doc_id", "text", F.coalesce("found", none).alias("found")) \
        .mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_text string")


def dedup_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
