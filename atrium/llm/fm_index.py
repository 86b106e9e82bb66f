"""FM-index over a sequence of small integers: backward search on a wavelet matrix, for many patterns at once."""

from __future__ import annotations

import numpy as np

REACH = 64  # symbols by which suffixes are ordered; patterns are shorter


class FMIndex:
    """Index of ``text`` (0 separates pieces, symbols from 1).

    ``weight`` says how often each position of the text counts; a pattern's weight is the sum over
    its occurrences.
    """

    def __init__(self, text: np.ndarray, weight: np.ndarray):
        n = len(text)
        order = _suffixes(text)
        last = text[order - 1]  # symbol before each suffix
        self.begin = np.r_[0, np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))]
        self.total = np.r_[0, np.cumsum(weight[order])]
        self.n, self.levels = n, max(1, int(text.max(initial=0)).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        current = last
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            self._store(bit.astype(bool))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        symbols = np.arange(len(self.begin))
        self.base = self._down(symbols, np.zeros(len(symbols), np.int64))

    def _store(self, bit: np.ndarray) -> None:
        packed = np.packbits(np.r_[bit, np.zeros(-len(bit) % 64 + 64, bool)], bitorder="little").view(np.uint64)
        self.bits.append(packed)
        self.before.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
        self.zeros.append(len(bit) - int(bit.sum()))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            bit = (symbol >> (self.levels - 1 - level)) & 1
            ones = self._ones(level, i)
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns with ``symbol`` put in front."""
        start = self.begin[symbol] - self.base[symbol]
        return start + self._down(symbol, low), start + self._down(symbol, high)

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.total[high] - self.total[low]


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Positions in the order of the first ``REACH`` symbols of their suffixes, by prefix doubling."""
    rank, width = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < REACH:
        behind = np.zeros(len(text), np.int64)
        behind[:max(0, len(text) - width)] = rank[width:] + 1
        key = rank * (int(behind.max(initial=0)) + 1) + behind
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]]) if len(text) else sorted_key
        width *= 2
    return order


def repeated_intervals(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Intervals of ``least`` symbols or more in each piece that have weight 2 or more: (piece, first, last + 1).

    Matching statistics from the right: from an end position the match is extended to the left as
    far as its weight stays at 2; shorter windows inside it repeat as well, so the next end is the
    one that the first symbol which could not be reached allows.
    """
    out, piece, stop = [], np.arange(len(begin)), end.copy()
    ok = stop - begin >= least
    piece, stop = piece[ok], stop[ok]
    while len(piece):
        low, high = np.zeros(len(piece), np.int64), np.full(len(piece), index.n, np.int64)
        left = stop.copy()
        active = np.arange(len(piece))
        while len(active):
            lo, hi = index.extend(text[left[active] - 1], low[active], high[active])
            good = index.weight(lo, hi) >= 2
            active, lo, hi = active[good], lo[good], hi[good]
            low[active], high[active] = lo, hi
            left[active] -= 1
            active = active[left[active] > begin[piece[active]]]
        found = stop - left >= least
        out.append((piece[found], left[found], stop[found]))
        stop = np.minimum(stop - 1, left + least - 1)
        more = (stop - begin[piece] >= least) & (left > begin[piece])
        piece, stop = piece[more], stop[more]
    return out
