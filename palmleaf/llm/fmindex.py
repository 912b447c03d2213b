"""Compact FM-index over word sequences: wavelet matrix of packed bits, backward search, matching statistics."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bit vector, 64 bits a word, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol at any position, one bit vector a bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.shifts = list(range(max(1, int(top).bit_length()) - 1, -1, -1))
        self.levels = []
        for shift in self.shifts:
            bit = (symbols >> shift) & 1
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(top + 1)
        self.base = self._descend(every, np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level in zip(self.shifts, self.levels):
            ones = level.ones(at)
            at = np.where((symbol >> shift) & 1, level.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.base[symbol]


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Place of each key among the distinct keys in order."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return out


class FMIndex:
    """Index of sequences of positive symbols, each with a weight (how often it occurs), for patterns of up to ``depth``.

    Held are the wavelet matrix of the Burrows-Wheeler transform (as many bits a symbol as symbols need), the sums of
    weights, and of the suffix order the common prefixes of neighbours (a byte each, cut at ``depth``) with the nearest
    smaller one before and after each, which give the parent of an interval. The suffix order itself is not kept.
    """

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, depth: int):
        ends = np.zeros(1, np.int64)
        text = np.concatenate([x for s in sequences for x in (s, ends)])
        self.n = n = len(text)
        # suffix order by prefix doubling from three symbols on, as far as patterns reach
        top = int(text.max())
        after = lambda k: np.concatenate([text[k:], np.zeros(min(k, n), np.int64)])[:n]
        ranks, length = [_ranked((text * (top + 1) + after(1)) * (top + 1) + after(2))], 3
        while length < depth + 1:
            nxt = np.concatenate([ranks[-1][length:], np.full(min(length, n), -1)])[:n]
            ranks.append(_ranked(ranks[-1] * (n + 2) + nxt + 1))
            length *= 2
        suffixes = np.argsort(ranks[-1])
        # longest common prefixes of neighbours, from the ranks of each length and then symbol by symbol
        a, b, common = suffixes[:-1], suffixes[1:], np.zeros(n - 1, np.int64)
        for size, rank in [*((3 << k, r) for k, r in reversed(list(enumerate(ranks)))), (1, text), (1, text)]:
            x, y = a + common, b + common
            inside = (x < n) & (y < n)
            common += size * (inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)]))
        self.common = np.concatenate([[-1], np.minimum(common, depth), [-1]]).astype(np.int8)
        at = np.arange(n + 1, dtype=np.int32)
        self.smaller_before, self.smaller_after = np.zeros(n + 1, np.int32), np.full(n + 1, n, np.int32)
        for d in range(depth + 1):
            own = np.flatnonzero(self.common == d)
            if len(own):
                cut = self.common < d
                self.smaller_before[own] = np.maximum.accumulate(np.where(cut, at, 0))[own]
                self.smaller_after[own] = np.minimum.accumulate(np.where(cut, at, n)[::-1])[::-1][own]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.wavelet = WaveletMatrix(text[suffixes - 1], top)
        per_symbol = np.repeat(weights, [len(s) + 1 for s in sequences])
        self.weight = np.concatenate([[0], np.cumsum(per_symbol[suffixes])])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns with ``symbol`` put before them."""
        both = self.starts[np.tile(symbol, 2)] + self.wavelet.rank(np.tile(symbol, 2), np.concatenate([lo, hi]))
        return both[: len(lo)], both[len(lo) :]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and length of the longest prefix of each pattern that has more rows."""
        before, after = self.common[lo], self.common[hi]
        length = np.maximum(before, after)
        return np.where(before == length, self.smaller_before[lo], lo), np.where(after == length, self.smaller_after[hi], hi), length.astype(np.int64)

    def repeated_windows(self, sequences: list[np.ndarray], window: int) -> np.ndarray:
        """(sequences, longest) flags: place i of a row says that the ``window`` symbols from i on weigh two or more in the index.

        All sequences stream through at once, from their ends. A lane holds the longest match at its position that weighs
        two; one that cannot be extended is cut to the next shorter one with more rows.
        """
        lanes = len(sequences)
        longest = max(map(len, sequences))
        symbols = np.zeros((lanes, longest), np.int64)
        for k, s in enumerate(sequences):
            symbols[k, : len(s)] = s
        at = np.array([len(s) for s in sequences]) - 1
        lo, hi, length = np.zeros(lanes, np.int64), np.full(lanes, self.n, np.int64), np.zeros(lanes, np.int64)
        found = np.zeros((lanes, longest), bool)
        live = np.flatnonzero(at >= 0)
        while len(live):
            l, h, q, i = lo[live], hi[live], length[live], at[live]
            nl, nh = self.step(symbols[live, i], l, h)
            ok = self.weight[nh] - self.weight[nl] >= 2
            # extended
            good = live[ok]
            lo[good], hi[good], length[good] = nl[ok], nh[ok], q[ok] + 1
            full = good[length[good] == window]
            found[full, at[full]] = True
            up_lo, up_hi, up = self.parent(lo[full], hi[full])
            wider = up == window - 1  # else one symbol less has the same rows
            lo[full], hi[full] = np.where(wider, up_lo, lo[full]), np.where(wider, up_hi, hi[full])
            length[full] = window - 1
            at[good] -= 1
            # not extended: a shorter match, or no match at this position
            bad = ~ok
            none = live[bad & (q == 0)]
            at[none] -= 1
            some = live[bad & (q > 0)]
            lo[some], hi[some], up = self.parent(lo[some], hi[some])
            length[some] = np.maximum(up, 0)
            live = live[at[live] >= 0]
        return found
