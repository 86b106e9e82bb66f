"""Words, word hashes and shingles of whole texts, computed for many texts at once with NumPy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; these separators are ASCII, so the
rule is the same on UTF-8 bytes as on characters.  A null text has no words.  Functions here run
inside ``mapInArrow`` tasks and see one bounded slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNODD = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class Words(NamedTuple):
    """Words of a slice of texts: byte range of each, and the first word of each text (one more entry at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: np.ndarray  # first byte of each text, one more entry at the end


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about ``limit`` bytes (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(_sizes(batch.column(column)))
        begin = 0
        while begin < batch.num_rows:
            done = size[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def _sizes(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.diff(at)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins; a null text is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(column: pa.Array, lower: bool = False, letters: bool = False) -> Words:
    """Words of every text; ``lower`` turns A-Z into a-z first, ``letters`` also ends words at ASCII punctuation."""
    data, at = text_bytes(column)
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64), at)
    gap = (_NO_LETTER if letters else _SEPARATOR)[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[at[:-1][at[:-1] < len(data)]] = True
    after[at[1:][at[1:] > 0] - 1] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    return Words(data, start, end, np.searchsorted(start, at), at)


def joined(w: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The kept words (a mask; None: all), each followed by one space, as bytes, with the byte range of every kept word."""
    start, end = (w.start, w.end) if keep is None else (w.start[keep], w.end[keep])
    size = end - start
    out_end = np.cumsum(size + 1) - 1
    out_start = out_end - size
    total = int(out_end[-1]) + 1 if len(size) else 0
    taken = np.zeros(len(w.data) + 1, np.int8)  # +1 at a word's first byte, -1 behind its last
    taken[start] += 1
    taken[end] -= 1  # both where one text ends with a word and the next begins with one
    out = np.full(total, 0x20, np.uint8)
    if total:
        place = np.ones(total, bool)
        place[out_end] = False
        out[place] = w.data[np.cumsum(taken[:-1], dtype=np.int8).view(bool)]
    return out.tobytes(), out_start, out_end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_KEPT_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ...; what a usual slice needs is kept."""
    known = _KEPT_POWERS.get(int(base))
    if known is not None and len(known) >= n:
        return known[:n]
    out = np.full(max(n, SLICE_BYTES + SLICE_BYTES // 8), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if len(out) <= 4 * SLICE_BYTES:
        _KEPT_POWERS[int(base)] = out
    return out[:n]


def runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the sequence ``values[start:end]`` of each range, from one prefix sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_ODD, len(values)), out=total[1:])
    undo = _powers(_UNODD, len(values) + 1)
    return mix((total[end] - total[start]) * undo[start] + (end - start).astype(np.uint64))


def word_hashes(w: Words) -> np.ndarray:
    return runs(_BYTE[w.data], w.start, w.end) if len(w.start) else np.zeros(0, np.uint64)


def shingles(w: Words, hashes: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text has its whole sequence as one, an empty one none."""
    n = len(w.first) - 1
    count = np.diff(w.first)
    long_from = np.minimum(w.first[:-1] + np.maximum(count - width + 1, 0), len(hashes))
    if len(hashes) >= width:
        k = len(hashes) - width + 1
        full = runs(hashes, np.arange(k), np.arange(k) + width)
    else:
        full = np.zeros(0, np.uint64)
    out = []
    for i in range(n):
        if count[i] >= width:
            out.append(np.unique(full[w.first[i]:long_from[i]]))
        elif count[i]:
            part = hashes[w.first[i]:w.first[i + 1]]
            out.append(runs(part, np.array([0]), np.array([len(part)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def strings(w: Words, index: np.ndarray) -> list[str]:
    return [bytes(w.data[a:b]).decode() for a, b in zip(w.start[index], w.end[index])]


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrow list<int64> from unsigned arrays."""
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64) if len(flat) else np.zeros(0, np.int64)))
