"""SimHash near-dedup: fingerprints within two bits are linked through deletion-variant signatures.

A fingerprint has 64 bits; bit b is set if more than half of a text's shingle hashes have it.  Two
fingerprints within ``radius`` bits, cut into ``radius // 2 + 1`` segments (fewer than the
``radius + 1`` that exact matching would need), have a segment in which they differ by one bit at
most.  So each segment is indexed once per bit with that bit left out (its one-wildcard variants),
an equality join on variants finds every pair, and the exact distance decides.

Only distinct fingerprints are joined.  A variant that two fingerprints share gives its pair
straight from the counting pass; one that up to ``CROWD`` share is joined with itself.  Above that
pairs are not formed at all: fingerprints in a crowded variant are dealt out once more by every
value within one bit of them.  Those that meet at a value are all within two bits of each other, at
most 65 of them, and two fingerprints within two bits always meet at one; so each is linked with
the least of its value, and no link is lost.

Defined results: words are lower-cased A-Z; shingles count as often as they stand; a text with
fewer words than a shingle has its whole sequence as one; null, empty and blank texts have
fingerprint zero and are linked like any other; a bit set in exactly half of the hashes is 0;
copies and repeated rows stay rows of their own; rows without an id take part and get the least id
of their component (null if it has none); only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.llm.jaccard import small
from atrium.llm.words import Words, joined, slices, words
from atrium.operators.graphs import connected_components
from atrium.session import cut_lineage, scratch_path

BITS = 64
SEED = 42
CROWD = 16  # fingerprints of one variant that are still joined in pairs
PIECE = 1 << 16  # shingles whose bits are counted at once


def text_fingerprints(w: Words, width: int = 3) -> np.ndarray:
    """Fingerprint of each text of a slice; memory for hashes and bits does not grow with a text."""
    raw, start, end = joined(w)
    raw = memoryview(raw)
    count = np.diff(w.first)
    # shingles are word ranges [a, b): all full ones, or the whole of a short text
    have = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), have)
    a = np.arange(len(owner)) - np.repeat(np.cumsum(have) - have, have) + np.repeat(w.first[:-1], have)
    b = a + np.minimum(count, width)[owner]
    ones = np.zeros((len(count), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(owner), PIECE):
        here = owner[at:at + PIECE]
        x, y = start[a[at:at + PIECE]].tolist(), end[b[at:at + PIECE] - 1].tolist()
        hashes = np.fromiter((digest(raw[i:j], SEED) for i, j in zip(x, y)), np.uint64, len(x))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        ones[here[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    out = np.packbits(2 * ones > have[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (64 bits as a long)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = text_fingerprints(words(batch.column("text"), lower=True), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, fingerprint long")


def variants(fp: Column, radius: int) -> Column:
    """Array of (variant key, segment, deleted bit): every segment with each of its bits left out."""
    cuts = radius // 2 + 1
    width = BITS // cuts
    out = []
    for s in range(cuts):
        mask = ((1 << width) - 1) << (s * width)
        for bit in range(s * width, (s + 1) * width):
            left = mask & ~(1 << bit)
            left = left - (1 << BITS) if left >> (BITS - 1) else left
            # what is left of the segment, moved to the low bits, with the number of the deleted bit above if there is room
            value = F.shiftrightunsigned(fp.bitwiseAND(F.lit(left)), s * width)
            out.append(F.struct(value.alias("rest"), F.lit(bit).cast("tinyint").alias("bit")))
    return F.array(*out)


def apart(a: str | Column, b: str | Column) -> Column:
    """Number of differing bits."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def _first_shared(a: Column, b: Column, bit: Column, radius: int) -> Column:
    """True for one of the variants that a pair shares: the first segment within one bit, at the differing bit or its first."""
    cuts = radius // 2 + 1
    width = BITS // cuts
    x = a.bitwiseXOR(b)
    parts = [F.shiftrightunsigned(x, s * width).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1)) for s in range(cuts)]
    near = [F.bit_count(p) <= 1 for p in parts]
    out = F.lit(False)
    for s in reversed(range(cuts)):
        own = F.floor(bit / width) == s
        # a segment that does not differ is shared through all its bits: take the first
        place = F.when(parts[s] == 0, bit == s * width).otherwise(True)
        out = F.when(near[s], own & place).otherwise(out)
    return out


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v), u < v, whose components are those of all pairs of ``prints`` (fp, distinct) within ``radius`` (1 or 2) bits."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    listed = prints.select("fp", F.explode(variants(F.col("fp"), radius)).alias("k")).select("fp", "k.rest", "k.bit")
    counted = listed.groupBy("bit", "rest").agg(F.count("*").alias("held"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    shared = cut_lineage(counted.filter("held > 1"))
    two = shared.filter("held = 2").filter(apart("u", "v") <= radius).select("u", "v")
    more = small(cut_lineage(shared.filter("held > 2").select("bit", "rest", "held")))
    again = cut_lineage(listed.join(more, ["bit", "rest"]))
    few = again.filter(F.col("held") <= CROWD)
    left, right = (few.select("bit", "rest", F.col("fp").alias(c)) for c in "uv")
    met = left.join(right, ["bit", "rest"]).filter(F.col("u") < F.col("v"))
    some = met.filter(_first_shared(F.col("u"), F.col("v"), F.col("bit").cast("int"), radius) & (apart("u", "v") <= radius)).select("u", "v")
    return two.union(some).union(_crowded_links(again.filter(F.col("held") > CROWD).select("fp").distinct())).distinct()


def _crowded_links(prints: DataFrame) -> DataFrame:
    """Links among many near fingerprints (radius 2): those that meet at a value within one bit of each, with the least of them."""
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << BITS) * (b == BITS - 1))) for b in range(BITS)))
    met = prints.select("fp", F.explode(near).alias("at")).groupBy("at").agg(F.array_sort(F.collect_list("fp")).alias("all"))  # 65 at most
    met = met.filter(F.size("all") > 1)
    return met.select(F.element_at("all", 1).alias("u"), F.explode(F.slice("all", 2, BITS + 1)).alias("v"))


def near_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (long), component_id (least doc_id reachable by links within ``radius`` bits)."""
    folder = scratch_path(docs.sparkSession, "fingerprints")
    fingerprints(docs, width).write.parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    own = cut_lineage(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    links = near_links(own.select("fp"), radius)
    linked = connected_components(links, own.select("fp"), [], "fp", "u", "v", "root")
    named = cut_lineage(linked.join(own, "fp").select("fp", "root", "first"))
    # fingerprints that stand alone keep their own first id and need no second pass
    least = named.groupBy("root").agg(F.count("*").alias("held"), F.min("first").alias("component_id")).filter("held > 1")
    named = named.join(least, "root", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    found = near_components(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
