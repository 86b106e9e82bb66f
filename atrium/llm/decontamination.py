"""Benchmark decontamination with SimHash windows and multi-index Hamming search.

For every benchmark item of n words, each window of n words of a text gets a 64-bit SimHash of its
words.  A fingerprint within ``RADIUS`` bits of the item's differs by at most RADIUS // BLOCKS bits
in at least one of ``BLOCKS`` blocks, so tables that hold every item under all such block values
find all of them.  Candidates are verified exactly: sum of minima over sum of maxima of the shingle
counts of window and item, ``SIMILARITY`` or more.

A window can only reach the similarity if it shares a shingle with an item.  Stretches without any
shingle of any item are therefore left out before fingerprints are made, which changes no result.

Words here are runs of ASCII letters and digits and of non-ASCII characters, A-Z folded to a-z, so
case and punctuation do not hide a leak.  Items come to the tasks in blocks of ``ITEMS``, however
many there are.

Defined results: null and empty texts and items match nothing; a text shorter than an item is one
window; an item shorter than the shingle has its whole sequence as one, and windows of a text are
compared with it by shingles of that size;
items with equal texts each get their rows; repeated documents each get their rows; only ``doc_id``,
``text``, ``item_id`` are read from the inputs, under names of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.llm.words import Words, runs, slices, word_hashes, words

SIMILARITY = 0.75
WIDTH = 5
RADIUS = 15
BLOCKS = 8
ITEMS = 20_000
CHUNK = 1 << 16  # windows fingerprinted at once

OUT = "doc_id long, item_id long, similarity double, distance int, first_word long, n_words int"


def shingle_list(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Shingle hashes in text order; a shorter sequence is one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    k = max(1, len(hashes) - width + 1)
    at = np.arange(k)
    return runs(hashes, at, np.minimum(at + width, len(hashes)))


def weighted_jaccard(x: Counter, y: Counter) -> float:
    both = sum((x & y).values())
    either = sum(x.values()) + sum(y.values()) - both
    return both / either if either else 0.0


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each word hash."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def simhashes(hashes: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """Fingerprint (8 bytes) of the n words from each start; a bit is set if more than half of the words have it."""
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(_signs(hashes), axis=0, out=total[1:])
    return np.packbits(total[starts + n] - total[starts] > 0, axis=1)


class ItemIndex:
    """Items of one block: shingles, and per length the fingerprints and block tables."""

    def __init__(self, items: list[tuple[int, str | None]], radius: int = RADIUS):
        w = words(pa.array([t for _, t in items], pa.string()), lower=True, letters=True)
        hashes = word_hashes(w)
        self.radius, self.by_length = radius, {}
        known: dict[int, list[np.ndarray]] = {}  # by shingle size
        lengths: dict[int, list[int]] = {}
        for i in range(len(items)):
            if w.first[i + 1] > w.first[i]:
                lengths.setdefault(int(w.first[i + 1] - w.first[i]), []).append(i)
        near = [m for m in range(256) if bin(m).count("1") <= radius // BLOCKS]
        for n, held in lengths.items():
            own = [hashes[w.first[i]:w.first[i + 1]] for i in held]
            prints = np.concatenate([simhashes(h, n, np.array([0])) for h in own])
            tables = np.zeros((BLOCKS, 256, len(held)), bool)
            for b in range(BLOCKS):
                for flip in near:
                    tables[b, prints[:, b] ^ flip, np.arange(len(held))] = True
            shingled = [shingle_list(h) for h in own]
            known.setdefault(min(n, WIDTH), []).extend(shingled)
            self.by_length[n] = ([items[i][0] for i in held], prints, tables, [Counter(s.tolist()) for s in shingled])
        self.known = {width: np.unique(np.concatenate(parts)) for width, parts in known.items()}
        self.marks = {width: np.zeros(1 << 20, bool) for width in known}  # quick test before the search in `known`
        for width, held in self.known.items():
            self.marks[width][(held >> np.uint64(44)).astype(np.int64)] = True

    def knows(self, shingle: np.ndarray, width: int) -> np.ndarray:
        """Positions of shingles of ``width`` words that some item holds."""
        known = self.known[width]
        at = np.flatnonzero(self.marks[width][(shingle >> np.uint64(44)).astype(np.int64)])
        found = np.minimum(np.searchsorted(known, shingle[at]), len(known) - 1)
        return at[known[found] == shingle[at]]

    def near(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of length n within the radius: all that agree in a block, then the exact distance."""
        _, own, tables, _ = self.by_length[n]
        hit = np.zeros((len(prints), len(own)), bool)
        for b in range(BLOCKS):
            hit |= tables[b][prints[:, b]]
        row, item = np.nonzero(hit)
        far = np.bitwise_count(prints[row] ^ own[item]).sum(axis=1)
        keep = far <= self.radius
        return row[keep], item[keep]

    def search(self, hashes: np.ndarray) -> Iterator[tuple[int, float, int, int, int]]:
        """Best window of each item that one text holds: item_id, similarity, distance, first word, words."""
        shingle = {width: shingle_list(hashes, width) for width in self.known}
        known = {width: self.knows(s, width) for width, s in shingle.items()}
        grams, best = {width: s.tolist() for width, s in shingle.items() if len(known[width])}, {}
        for n, (ids, prints, _, counts) in self.by_length.items():
            size, width = min(n, len(hashes)), min(n, WIDTH)
            hits = known[width]
            if not len(hits):
                continue
            reach = max(size - width, 0)  # a window from here on still covers the shingle
            cover = np.zeros(len(hashes) + 2, np.int32)
            np.add.at(cover, np.maximum(hits - reach, 0), 1)
            np.add.at(cover, np.minimum(hits, len(hashes) - size) + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover[:len(hashes) - size + 1]) > 0)
            for at in range(0, len(starts), CHUNK):
                part = starts[at:at + CHUNK]
                low = part[0]
                made = simhashes(hashes[low:part[-1] + size], size, part - low)
                for row, item in zip(*self.near(n, made)):
                    begin = int(part[row])
                    alike = weighted_jaccard(Counter(grams[width][begin:begin + max(1, size - width + 1)]), counts[item])
                    key = (-alike, begin)
                    if alike >= SIMILARITY and key < best.get((n, item), ((0.0, 0),))[0]:
                        distance = int(np.bitwise_count(made[row] ^ prints[item]).sum())
                        best[n, item] = (key, (ids[item], alike, distance, begin, size))
        for _, found in best.values():
            yield found


def find_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, block: int = ITEMS) -> DataFrame:
    """A row per document and item it holds: doc_id, item_id, similarity, distance, first_word, n_words of the best window."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    blocks = max(1, -(-items.count() // block))

    def run(held: list[tuple[int, str | None]]):
        shared = docs.sparkSession.sparkContext.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, radius)
            for batch in slices(batches):
                w = words(batch.column("text"), lower=True, letters=True)
                hashes = word_hashes(w)
                doc, out = batch.column("doc_id").to_pylist(), []
                for i in _suspects(index, w, hashes):
                    out += [(doc[i], *found) for found in index.search(hashes[w.first[i]:w.first[i + 1]])]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int32()))],
                    names=["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"])

        return texts.mapInArrow(search, OUT)

    parts = []
    for b in range(blocks):  # at most `block` items or so are with the driver and the tasks at a time
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        parts.append(run([(r["item_id"], r["text"]) for r in mine.collect()]))
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, block: int = ITEMS) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark item, decided row by row where the row is.

    Rows without an id and repeated rows are judged by their own text; null, empty and blank texts
    hold nothing and stay; without items all rows stay.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    blocks = max(1, -(-items.count() // block))
    for b in range(blocks):  # each block of items filters what the blocks before have left
        held = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        docs = docs.mapInArrow(_leak_filter(docs.sparkSession.sparkContext.broadcast(held), radius), docs.schema)
    return docs


def _leak_filter(shared, radius: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shared.value, radius)
        for batch in slices(batches):
            w = words(batch.column("text"), lower=True, letters=True)
            hashes = word_hashes(w)
            keep = np.ones(batch.num_rows, bool)
            for i in _suspects(index, w, hashes):
                keep[i] = next(index.search(hashes[w.first[i]:w.first[i + 1]]), None) is None
            yield batch.filter(pa.array(keep))
    return clean


def _suspects(index: ItemIndex, w: Words, hashes: np.ndarray) -> list[int]:
    """Texts of a slice that hold any item's shingle; those across two texts or in short ones are looked at as well."""
    held = [index.knows(shingle_list(hashes, width), width) for width in index.known]
    some = np.unique(np.searchsorted(w.first, np.concatenate([np.zeros(0, np.int64), *held]), "right") - 1)
    short = np.flatnonzero((np.diff(w.first) < WIDTH) & (np.diff(w.first) > 0))
    return np.union1d(some, short).tolist()
