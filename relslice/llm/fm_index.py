"""A compressed full-text index over sequences of word numbers, searched backwards for many queries at once.

The Burrows-Wheeler transform of the sequences lies in a wavelet matrix: a level a bit, bits packed, with two small counters
for ranks. A second wavelet matrix over the sequences' numbers answers which is the smallest in an interval; sequences are
given in rising order of rank (the document they come from), so that tells whether a match lies in an earlier document. All
queries advance together: a step is one array operation over all of them.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 1
LOOK = 8  # steps between two looks at the documents of a match
PART = 8  # windows of a query that are tried one after the other; a longer query is tried at several places at once


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least, by prefix doubling."""
    rank = text.astype(np.int64)
    k = 1
    while True:
        second = np.zeros_like(rank)
        second[:-k] = rank[k:] + 1
        key = rank * (int(second.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, k = new, 2 * k
        if k >= depth or int(rank.max()) == len(text) - 1 or k >= len(text):
            return order


class WaveletMatrix:
    """Numbers from 0 up, in as many bits as the largest needs, plus 20 bits of counters for 64 bits of each level."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(1, int(values.max()).bit_length()) if n else 1
        self.words, self.wide, self.near, self.zeros = [], [], [], []
        now = values
        for level in range(self.bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            padded = np.zeros((n // 1024 + 1) * 1024, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).reshape(-1, 16).astype(np.uint32)
            self.words.append(words)
            self.wide.append(np.concatenate([[0], np.cumsum(ones.sum(axis=1))[:-1]]).astype(np.uint32))  # ones before 1024 bits
            self.near.append((np.cumsum(ones, axis=1) - ones).astype(np.uint16).reshape(-1))  # ones before 64 bits, within 1024
            self.zeros.append(int(n - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def ones(self, level: int, place: np.ndarray) -> np.ndarray:
        """Ones of a level before each place."""
        at = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.wide[level][at >> 4].astype(np.int64) + self.near[level][at] + np.bitwise_count(self.words[level][at] & below)

    def follow(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the run of each value's occurrences ends on the last level, counting those before its place."""
        for level in range(self.bits):
            ones = self.ones(level, place)
            up = (value >> (self.bits - 1 - level)) & 1
            place = np.where(up == 1, self.zeros[level] + ones, place - ones)
        return place

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest number in each interval [low, high); none may be empty."""
        out = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            ones_low, ones_high = self.ones(level, low), self.ones(level, high)
            up = (high - ones_high) == (low - ones_low)  # no zero in it
            low = np.where(up, self.zeros[level] + ones_low, low - ones_low)
            high = np.where(up, self.zeros[level] + ones_high, high - ones_high)
            out = out * 2 + up
        return out


class FMIndex:
    def __init__(self, sequences: list[np.ndarray], depth: int):
        """sequences hold word numbers from 2 up, in rising order of rank; depth is the longest query."""
        n = sum(map(len, sequences)) + len(sequences)
        text = np.full(n, SEPARATOR, np.int64)
        owner = np.empty(n, np.int64)
        at = 0
        for number, s in enumerate(sequences):
            text[at : at + len(s)] = s
            owner[at : at + len(s) + 1] = number
            at += len(s) + 1
        order = suffix_array(text, depth + 1)
        self.n, self.size = n, int(text.max()) + 1
        self.symbols, self.owners = WaveletMatrix(text[order - 1]), WaveletMatrix(owner[order])
        every = np.arange(self.size)
        before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))[:-1]])
        self.shift = before - self.symbols.follow(every, np.zeros(self.size, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol followed by what the intervals [low, high) match. Symbols that the index lacks match nothing."""
        known = symbol < self.size
        symbol = np.where(known, symbol, 0)
        ends = self.symbols.follow(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.shift[symbol], 2)
        return ends[: len(low)], np.where(known & (symbol > 0), ends[len(low) :], ends[: len(low)])

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest sequence number in intervals that are not empty."""
        return self.owners.smallest(low, high)


def earlier_windows(index: FMIndex, ranks: np.ndarray, queries: list[np.ndarray], mine: np.ndarray, window: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Matching statistics of each query (rank mine) in sequences of smaller rank (ranks, in the index's order).

    Gives, per query, which of its windows occur there, and at the ends of stretches that were tried, the length matched
    (-1: not tried, as the outcome followed from another try). A stretch is matched from its end. Where the match breaks off
    at a place p, no window that holds what lies from there to the end can occur, so the search goes on with the window
    after p. After a hit a longer stretch is tried at once, as all windows inside a stretch that occurs occur too. The
    documents of a match are looked at every LOOK words; where they are too late, p is taken as the last place reached.
    A query is cut into parts of PART windows, which overlap by what windows do: a step costs much the same for one part and for
    thousands, so it is the longest part that counts.
    """
    whole = np.array([len(q) for q in queries], np.int64)
    begin = np.cumsum(whole) - whole
    parts = np.maximum(1, -(-(whole - window + 1) // PART))
    of = np.repeat(np.arange(len(queries)), parts)
    first = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART  # the first window of a part
    base, m = begin[of] + first, np.minimum(whole[of] - first, PART + window - 1)
    mine = mine[of]
    words = np.concatenate([*queries, np.zeros(1, np.int64)])
    flags = [np.zeros(max(0, k - window + 1), bool) for k in whole.tolist()]
    found = [flags[i][a : a + PART] for i, a in zip(of.tolist(), first.tolist())]
    lengths = np.full(len(words) + len(queries), -1, np.int64)
    spot = base + of  # where the lengths of a part begin
    start = np.zeros(len(of), np.int64)
    reach = np.ones(len(of), np.int64)  # windows that a try covers
    end = np.minimum(m, window)
    place, low, high = end.copy(), np.zeros(len(of), np.int64), np.full(len(of), index.n, np.int64)
    live = np.flatnonzero(m >= window)
    while len(live):
        lo, hi = index.extend(words[base[live] + place[live] - 1], low[live], high[live])
        place[live] -= 1
        good = lo < hi
        place[live[~good]] += 1  # the match starts after the word that failed
        low[live], high[live] = lo, hi
        look = np.flatnonzero(good & (((end[live] - place[live]) % LOOK == 0) | (place[live] == start[live])))
        if len(look):
            late = look[ranks[index.smallest(lo[look], hi[look])] >= mine[live[look]]]
            good[late] = False
            place[live[late]] += 1  # at most so many words match
        done = live[~good]
        hit = live[good & (place[live] == start[live])]
        lengths[spot[hit] + end[hit]], lengths[spot[done] + end[done]] = end[hit] - place[hit], end[done] - place[done]
        for i in hit.tolist():
            found[i][start[i] : end[i] - window + 1] = True
        long, short = done[reach[done] > 1], done[reach[done] == 1]
        start[hit] = end[hit] - window + 1
        reach[hit] = np.minimum(reach[hit] * 4, 64)
        start[short] = np.maximum(place[short], start[short] + 1)
        reach[long] = reach[long] // 4
        again = np.concatenate([hit, done])
        end[again] = np.minimum(start[again] + window - 1 + reach[again], m[again])
        reach[again[end[again] - start[again] == window]] = 1
        place[again], low[again], high[again] = end[again], 0, index.n
        live = live[start[live] + window <= m[live]]
    return flags, [lengths[a : a + k + 1] for a, k in zip((begin + np.arange(len(queries))).tolist(), whole.tolist())]
