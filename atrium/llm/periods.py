"""Periodic run detection: descending-LCP Kruskal over the suffixes of each text's words.

A run is a stretch of words with smallest period q (words q apart are identical) of at least
``least`` words and ``times`` periods, which no neighbouring word extends.  The suffixes at a run's
start and one period later have a common prefix (LCP) of length minus q.  So suffixes are united
into classes by decreasing LCP with a union-find; each class keeps its word numbers in order, and
positions that become neighbours in a class at a distance within the LCP seed a run: it begins at
the first, ends where the LCP of the second ends, and its period is their distance.  A seed whose
preceding words agree lies inside an earlier one and goes; of seeds with one extent the least
distance is the smallest period.

Runs need an LCP of `shortest_lcp` words.  Words in no window of that size which repeats in its text
take no part, so ordinary prose costs one sort of window hashes.  What remains of a slice of texts
gets one suffix array by prefix doubling.

Defined results: null, empty and blank texts have no words and no runs; words are compared by
64-bit hashes, unchanged; overlapping runs are all reported; repeated rows and rows without an id
stay rows of their own; only ``doc_id`` and ``text`` are read.  A text is treated as a whole: memory
of a task grows with the words of its longest text (its repeating part alone for the suffix array).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium.llm.words import WORD, Words, joined, mix, runs, slices, word_hashes, words

LEAST = 24
TIMES = 3
BLOCK = 1024  # positions of one block of an ordered class
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def shortest_lcp(least: int = LEAST, times: int = TIMES) -> int:
    """Least common prefix of the suffixes at the start of a run and one period later, whatever the period."""
    q = max(1, least // times)
    return min(max(least, times * p) - p for p in (q, q + 1))


class Positions:
    """Word numbers of one class in order, in blocks of bounded size."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, one: int):
        self.blocks, self.firsts, self.size = [[one]], [one], 1

    def add(self, x: int) -> tuple[int, int]:
        """Insert; the neighbours below and above (-1: none)."""
        k = max(bisect_right(self.firsts, x) - 1, 0) if len(self.blocks) > 1 else 0
        block = self.blocks[k]
        at = bisect_left(block, x)
        below = block[at - 1] if at else -1
        if at < len(block):
            above = block[at]
        else:
            above = self.firsts[k + 1] if k + 1 < len(self.blocks) else -1
        block.insert(at, x)
        self.size += 1
        if not at:
            self.firsts[k] = x
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks.insert(k + 1, block[half:])
            self.firsts.insert(k + 1, block[half])
            del block[half:]
        return below, above


def suffix_order(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``seq`` and the LCP of each suffix with the one before it, by prefix doubling.

    Ranks of all powers of two are kept; comparing them from the largest down gives every LCP at once.
    """
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while step < n:
        key = rank * (n + 1)
        key[:n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.r_[False, key[order[1:]] != key[order[:-1]]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            break
        levels.append(rank.astype(np.int32))
        step *= 2
    a, b = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = np.flatnonzero((x < n) & (y < n))
        same = levels[k][x[inside]] == levels[k][y[inside]]
        lcp[inside[same]] += 1 << k
    return order, np.r_[0, lcp] if n else np.zeros(0, np.int64)


def seeds(seq: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of left-maximal repetitions, by uniting suffix classes from the highest LCP down."""
    floor = shortest_lcp(least, times)
    edges = np.flatnonzero(lcp >= floor)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}
    found = []

    def root(i: int) -> int:
        top = parent.setdefault(i, i)
        while parent[top] != top:
            top = parent[top]
        while parent[i] != top:
            parent[i], i = top, parent[i]
        return top

    for a, b, length in zip(order[edges - 1].tolist(), order[edges].tolist(), lcp[edges].tolist()):
        a, b = root(a), root(b)
        big, new = classes.get(a) or Positions(a), classes.get(b) or Positions(b)
        if big.size < new.size:
            a, b, big, new = b, a, new, big
        parent[b] = a
        classes.pop(b, None)
        classes[a] = big
        farthest, last = length // (times - 1), -1
        for block in new.blocks:
            for x in block:
                below, above = big.add(x)
                if below >= 0 and below != last and x - below <= farthest and x - below + length >= least and seq[below - 1] != seq[x - 1]:
                    found.append((below, x - below + length, x - below))
                if above >= 0 and above - x <= farthest and above - x + length >= least and seq[x - 1] != seq[above - 1]:
                    found.append((x, above - x + length, above - x))
                last = x
    return found


def find_runs(w: Words, hashes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of a slice of texts: first word (within the slice), length and period, by (start, period)."""
    if times < 2:
        raise ValueError("a run has at least two periods")
    floor, total = shortest_lcp(least, times), len(hashes)
    nothing = (np.zeros(0, np.int64),) * 3
    if total < least:
        return nothing
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    marked = mix(hashes + mix(text.astype(np.uint64)))  # the same word differs between texts, so no window matches across them
    at = np.arange(total - floor + 1)
    window = runs(marked, at, at + floor)
    order = np.argsort(window, kind="stable")
    twin = window[order[1:]] == window[order[:-1]]
    repeats = np.zeros(len(window), bool)
    repeats[order[1:][twin]] = True
    repeats[order[:-1][twin]] = True
    if not repeats.any():
        return nothing
    cover = np.zeros(total + 1, np.int64)
    cover[np.flatnonzero(repeats)] += 1
    cover[np.flatnonzero(repeats) + floor] -= 1
    inside = np.cumsum(cover[:-1]) > 0
    # stretches of covered words, each behind a mark that equals nothing else, and one mark at the end
    place = np.flatnonzero(inside)
    begins = np.flatnonzero(np.r_[True, np.diff(place) > 1])
    ids = np.unique(marked[place], return_inverse=True)[1].astype(np.int64)
    seq = np.insert(ids, begins, ids.max() + 1 + np.arange(len(begins)))
    seq = np.append(seq, seq.max() + 1)
    word = np.append(np.insert(place, begins, -1), -1)
    found = seeds(seq, *suffix_order(seq), least, times)
    if not found:
        return nothing
    start, length, period = np.array(found, np.int64).T
    start = word[start]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    smallest = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
    start, length, period = start[smallest], length[smallest], period[smallest]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (array of start, length, period, by start and period), collapsed.

    ``collapsed`` is the text with one period of each run left: words that some run holds after its
    first period go, the others stand joined by one space (empty, never null).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = words(batch.column("text"))
            start, length, period = find_runs(w, word_hashes(w), least, times)
            drop = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, start + length, -1)
            keep = np.cumsum(drop[:-1]) == 0
            raw, begin, end = joined(w, keep)
            kept = np.r_[0, np.cumsum(keep)][w.first]
            texts = [raw[begin[a]:end[b - 1]].decode() if b > a else "" for a, b in zip(kept[:-1], kept[1:])]
            owner = np.searchsorted(w.first, start, "right") - 1
            offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=batch.num_rows))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                [pa.array(start - w.first[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(w.first)), lists, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the ids (by crc32) get a periodic tail: word i from a on becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    w = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), w.alias("w")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int") + 1)
    tail = F.slice("w", F.col("a") + 1, F.col("p"))
    many = F.slice(F.flatten(F.array_repeat(tail, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), many), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def periods_digest(docs: DataFrame) -> DataFrame:
    """Runs of every text with planted tails: their number, the one of the greatest exponent, and digests of runs and kept words."""
    found = collapse_runs(with_planted_runs(docs))

    def better(x, y):  # length / period, compared exactly
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        later = F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(
            F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
        return F.when(left > right, -1).when(left < right, 1).otherwise(later)

    best = F.get(F.array_sort("runs", better), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                       F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
