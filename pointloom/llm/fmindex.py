"""FM-index over sequences of small integers, with vectorised search of many phrases.

Symbol 0 ends a sequence; each 0 counts as different from all others, ordered by
place.  No phrase holds a 0, so sorting ends at the next 0 and the order of
suffixes is exact.  The transform is kept in a wavelet matrix of packed bits;
ranks are popcounts.
"""

from __future__ import annotations

import numpy as np

from pointloom.llm.runs import expand

#: Every so many places of the sequence are sampled for locating.
SAMPLE = 8


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Places of ``s`` in the order of their suffixes, as far as the next 0."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(s.max()).bit_length())
    wide = max(1, min(4, 63 // bits))
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(wide):
        sym = np.zeros(n, np.int64)
        sym[: max(0, n - k)] = s[k:]
        sym[~open_] = 0
        open_ &= sym > 0
        key = (key << bits) | sym
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.r_[True, sorted_key[1:] != sorted_key[:-1]] | ~open_[order]
    at = np.flatnonzero(first)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(at, np.diff(np.r_[at, n]))
    rank[n] = -1
    sizes = np.diff(np.r_[at, n])
    todo = order[np.repeat(sizes > 1, sizes)]
    h = wide
    while len(todo):
        a, b = rank[todo], rank[np.minimum(todo + h, n)]
        o = np.lexsort((b, a))
        todo, a, b = todo[o], a[o], b[o]
        new = np.r_[True, a[1:] != a[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        part = new | np.r_[True, b[1:] != b[:-1]]
        start = np.maximum.accumulate(np.where(part, np.arange(len(a)), 0))
        rank[todo] = a + (start - head)
        order[a + (np.arange(len(a)) - head)] = todo
        at = np.flatnonzero(part)
        sizes = np.diff(np.r_[at, len(a)])
        todo = todo[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


class Bits:
    """Packed bits with rank."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
        padded[: len(bit)] = bit
        self.word = np.packbits(padded, bitorder="little").view(np.uint64)
        count = np.bitwise_count(self.word).astype(np.int64)
        self.before = np.cumsum(count) - count

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place ``i``."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.word[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.word[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class FMIndex:
    def __init__(self, s: np.ndarray, symbols: int):
        """``s``: integers from 0 to ``symbols``."""
        s = np.r_[np.asarray(s, np.int64), 0]  # so that every symbol has a suffix after it
        n = self.n = len(s)
        order = suffix_order(s)
        last = s[order - 1]
        last[order == 0] = 0
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=symbols + 1))]
        self.levels: list[tuple[int, Bits, int]] = []
        for b in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            bit = (last >> b) & 1 > 0
            zeros = int(n - bit.sum())
            self.levels.append((b, Bits(bit), zeros))
            last = np.concatenate([last[~bit], last[bit]])
        kept = order % SAMPLE == 0
        kept |= np.r_[0, s][order] == 0  # where a sequence begins, as walking back ends there
        self.sampled, self.places = Bits(kept), order[kept]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol ``c`` stands before row ``i`` of the transform."""
        lo = np.zeros_like(i)
        for b, bits, zeros in self.levels:
            one = (c >> b) & 1 > 0
            r, q = bits.rank(i), bits.rank(lo)
            i, lo = np.where(one, zeros + r, i - r), np.where(one, zeros + q, lo - q)
        return i - lo

    def step(self, i: np.ndarray) -> np.ndarray:
        """From rows to the rows of the suffixes one place earlier."""
        c, lo = np.zeros_like(i), np.zeros_like(i)
        for b, bits, zeros in self.levels:
            one = bits.get(i)
            r, q = bits.rank(i), bits.rank(lo)
            i, lo = np.where(one, zeros + r, i - r), np.where(one, zeros + q, lo - q)
            c |= one.astype(np.int64) << b
        return self.first[c] + i - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of ``phrases`` (symbols above 0): the range of suffixes that begin with each."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence: number of the phrase, place in the sequence."""
        which, row = expand(lo, hi)
        place, walked = np.zeros(len(row), np.int64), 0
        todo = np.arange(len(row))
        while len(todo):
            hit = self.sampled.get(row[todo])
            done = todo[hit]
            place[done] = self.places[self.sampled.rank(row[done])] + walked
            todo = todo[~hit]
            row[todo] = self.step(row[todo])
            walked += 1
        return which, place
