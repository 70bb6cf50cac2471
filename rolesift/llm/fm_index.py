"""An FM-index over integer symbols: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


class RankBits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=before[1:])
        self.before = before

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def ones(self, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


class WaveletMatrix:
    """Ranks and symbols of a sequence by one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for shift in range(bits - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((shift, RankBits(bit)))
            self.zeros.append(len(bit) - int(np.count_nonzero(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before `at`; both are arrays."""
        first = np.zeros_like(at)
        for (shift, bits), zeros in zip(self.levels, self.zeros):
            one = ((symbol >> shift) & 1).astype(bool)
            up, low = bits.ones(at), bits.ones(first)
            at = np.where(one, zeros + up, at - up)
            first = np.where(one, zeros + low, first - low)
        return at - first

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before that place."""
        symbol, first = np.zeros_like(at), np.zeros_like(at)
        for (shift, bits), zeros in zip(self.levels, self.zeros):
            one = bits.get(at).astype(bool)
            symbol |= one.astype(at.dtype) << shift
            up, low = bits.ones(at), bits.ones(first)
            at = np.where(one, zeros + up, at - up)
            first = np.where(one, zeros + low, first - low)
        return symbol, at - first


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Starts of all suffixes in order; every 0 is a terminator, less than all later ones.

    The text ends in 0. As many symbols as 62 bits hold are compared by one sort. Only
    suffixes still equal, with no terminator so far, are sorted on by doubled prefixes.
    """
    n, width = len(text), max(1, 62 // bits)
    key, open_ = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(width):
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - k)] = text[k:]
        open_ &= ahead > 0
        key = (key << bits) | np.where(open_, ahead, 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~open_[order[1:]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = _tied(new)
    while len(tied):
        starts = order[tied]
        group, then = rank[starts], rank[starts + width]
        by = np.lexsort((then, group))
        starts, group, then = starts[by], group[by], then[by]
        order[tied] = starts
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        rank[starts] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[_tied(fresh)]
        width *= 2
    return order


def _tied(new: np.ndarray) -> np.ndarray:
    """Places that are not alone in their group, given where groups begin."""
    ends = np.ones(len(new), dtype=bool)
    ends[:-1] = new[1:]
    return np.flatnonzero(~(new & ends))


class FMIndex:
    """Backward search and location over a text of symbols 1..2**bits-1 and terminators 0."""

    def __init__(self, text: np.ndarray, bits: int):
        order = suffix_order(text, bits)
        before = np.zeros(len(text), dtype=np.int64)
        before[1:] = text[:-1]
        last = before[order]
        counts = np.bincount(text, minlength=1 << bits)
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.ranks = WaveletMatrix(last, bits)
        # Places after a terminator are sampled too, so no walk crosses one
        sampled = (order % SAMPLE_EVERY == 0) | (last == 0)
        self.sampled, self.positions = RankBits(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of one length: which occur, and their first and last+1 rows."""
        which = np.arange(len(phrases))
        low, high = self.starts[phrases[:, -1]], self.starts[phrases[:, -1] + 1]
        for at in range(phrases.shape[1] - 2, -1, -1):
            live = low < high
            which, low, high = which[live], low[live], high[live]
            symbol = phrases[which, at]
            low = self.starts[symbol] + self.ranks.rank(symbol, low)
            high = self.starts[symbol] + self.ranks.rank(symbol, high)
        live = low < high
        return which[live], low[live], high[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, walking back to a sampled one."""
        position, steps = np.empty(len(rows), dtype=np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            known = self.sampled.get(rows).astype(bool)
            position[left[known]] = self.positions[self.sampled.ones(rows[known])] + steps
            left, rows = left[~known], rows[~known]
            symbol, rank = self.ranks.symbol_and_rank(rows)
            rows, steps = self.starts[symbol] + rank, steps + 1
        return position
