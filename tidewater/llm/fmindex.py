"""A compressed full-text index over sequences of symbols: Burrows-Wheeler transform, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

ONE, SIXTY_THREE = np.uint64(1), np.uint64(63)


class WaveletMatrix:
    """Rank of any symbol in any prefix, in one packed bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        now, n = symbols.astype(np.int64), len(symbols)
        for level in reversed(range(max(1, int(largest).bit_length()))):
            bit = (now >> level) & 1
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + (-n) % 64, np.int64)]).astype(np.uint8), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = n - int(bit.sum())
            self.levels.append((level, packed, before, zeros))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefix lengths ``at`` end among the occurrences of ``symbols``, at the lowest level."""
        at = at.astype(np.int64)
        for level, packed, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((ONE << (at.astype(np.uint64) & SIXTY_THREE)) - ONE))
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the next ``depth`` symbols or more (prefix doubling)."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, h = len(symbols), 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        behind = np.zeros(n, np.int64)
        behind[: n - h] = rank[h:] + 1
        key = rank * (n + 2) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        h *= 2
    return order


class FMIndex:
    """Index over ``symbols`` (0 separates sequences), good for patterns of up to ``depth`` symbols.

    Ordering by ``depth`` symbols is enough: which rows precede a pattern's depends on no more of them.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        # A separator at either end, so that every symbol has one before it.
        self.text = np.concatenate([[0], symbols, [0]]).astype(np.int32)
        self.depth = depth
        self.order = suffix_order(self.text, depth + 1).astype(np.int32)
        largest = int(self.text.max())
        self.wavelet = WaveletMatrix(self.text[self.order - 1], largest)
        counts = np.bincount(self.text, minlength=largest + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        every = np.arange(largest + 1)
        self.base = self.wavelet.walk(every, np.zeros(len(every), np.int64))

    def statistics(self, ends: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics at positions ``ends`` of the indexed text (as given), cut off at ``depth``.

        For each end: the length of the longest pattern ending there that occurs ``least`` times or more, and the rows
        [low, high) of its occurrences where that length is ``depth``. One backward step for all that still match.
        """
        ends = np.asarray(ends, np.int64) + 1
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64)
        live = np.arange(len(ends))
        for step in range(self.depth):
            symbol = self.text[ends[live] - step]
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            if not len(live):
                break
            both = self.wavelet.walk(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            base = self.first[symbol] - self.base[symbol]
            lo, hi = both[: len(live)] + base, both[len(live) :] + base
            on = hi - lo >= least
            live = live[on]
            low[live], high[live] = lo[on], hi[on]
            length[live] = step + 1
        return length, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest position (as given) of the occurrences in each of the rows [low, high). Equal lows have equal highs."""
        if not len(low):
            return np.zeros(0, np.int64)
        lows, at, which = np.unique(low, return_index=True, return_inverse=True)
        cuts = np.stack([lows, high[at]], axis=1).ravel()
        padded = np.append(self.order, np.iinfo(np.int32).max)
        return np.minimum.reduceat(padded, cuts)[::2][which].astype(np.int64) - 1
