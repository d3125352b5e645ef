"""A compressed FM-index over integer symbols: wavelet matrix with packed ranks, searched by many lanes at once."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array by prefix doubling, and the rank of each position's first ``seed`` symbols (a power of two)."""
    n = len(seq)
    dense = n and 0 <= seq.min() and seq.max() < n
    rank = seq.astype(np.int64) if dense and seed > 1 else np.unique(seq, return_inverse=True)[1].astype(np.int64)
    seeds = rank if seed == 1 else None
    h = 1
    base = int(rank.max(initial=0)) + 2
    if seed > 2 and base**4 < 1 << 62:  # two symbols are one number, so the first sort tells four of them apart
        rank, h = rank * base + np.append(rank[1:] + 1, np.zeros(min(n, 1), np.int64)), 2
    while True:
        second = np.zeros(n, np.int64)
        second[: max(n - h, 0)] = rank[h:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + second
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        h *= 2
        if h == seed:
            seeds = rank
        if n == 0 or rank[order[-1]] == n - 1:
            return order, rank if seeds is None else seeds


class _Bits:
    """A packed bit vector with counts of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)
        self.zeros = n - int(ones.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """Index of a sequence of symbols; 0 to sigma - 1 after ranking."""

    def __init__(self, seq: np.ndarray, seed: int = 1):
        """``seed``: the length, a power of two, of the strings whose intervals are kept from the construction."""
        self.n, self.seed = len(seq), seed
        self.sa, self.seed_class = suffix_array(seq, seed)
        self.seed_start = np.concatenate([[0], np.cumsum(np.bincount(self.seed_class))])
        bwt = seq[self.sa - 1]
        self.sigma = int(seq.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=self.sigma))])
        self.levels: list[tuple[int, _Bits]] = []
        for level in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((bwt >> level) & 1).astype(np.uint8)
            self.levels.append((level, _Bits(bit)))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        every = np.arange(self.sigma)
        self.base = self._walk(every, np.zeros(self.sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.ones(i)
            i = np.where((c >> level) & 1, bits.zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of c followed by what [left, right) stands for."""
        both = self._walk(np.concatenate([c, c]), np.concatenate([left, right]))
        off = self.first[c] - self.base[c]
        m = len(c)
        return both[:m] + off, both[m:] + off

    def earliest(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The least text position in each interval, by a sparse table over the suffix array."""
        if not hasattr(self, "_least"):
            rows, h = [self.sa.astype(np.int32)], 1
            while 2 * h <= self.n:
                rows.append(np.minimum(rows[-1][:-h], rows[-1][h:]))
                h *= 2
            self._least = rows
        k = np.floor(np.log2(right - left)).astype(np.int64)
        out = np.empty(len(left), np.int64)
        for level in np.flatnonzero(np.bincount(k)):
            of = k == level
            row = self._least[level]
            out[of] = np.minimum(row[left[of]], row[right[of] - (1 << level)])
        return out


def repeated_windows(index: FMIndex, seq: np.ndarray, start: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    """Positions of the windows of ``size`` symbols that also start earlier in the text.

    Segment k has ``windows[k]`` windows from ``start[k]``. Each lane matches one segment: the interval of a
    window's last ``index.seed`` symbols is known, and the window is read backwards from there for as
    long as the string occurs more than once. Where it no longer does, no window that holds the string can
    match, so the next one starts behind its first symbol.
    """
    s, stop = start.astype(np.int64), (start + windows).astype(np.int64)
    live = s < stop
    s, stop = s[live], stop[live]
    found: list[np.ndarray] = []

    def begin(s: np.ndarray):
        at = s + size - index.seed
        c = index.seed_class[at]
        return at - 1, index.seed_start[c], index.seed_start[c + 1]

    j, left, right = begin(s) if len(s) else (s, s, s)
    while len(s):
        many = right - left > 1
        read = many & (j >= s)
        full = many & ~read
        if full.any():
            at = s[full]
            found.append(at[index.earliest(left[full], right[full]) < at])
        if read.any():
            a, b = index.extend(seq[j[read]], left[read], right[read])
            left[read], right[read] = a, b
        # j is one before the string that was read last
        s = np.where(full, s + 1, np.where(many, s, j + 2))
        j = np.where(read, j - 1, j)
        live = s < stop
        again = ~read & live
        if again.any():
            j[again], left[again], right[again] = begin(s[again])
        if not live.all():
            s, stop, j, left, right = s[live], stop[live], j[live], left[live], right[live]
    return np.concatenate(found) if found else np.zeros(0, np.int64)
