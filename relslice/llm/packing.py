"""Packing of documents into sequences of a fixed length by a swap-based local search.

Documents longer than a sequence are cut into full pieces and a rest; nothing else is cut. Pieces are dealt at random into
groups of about GROUP pieces; each group is packed in one task. It starts with the pieces in order of arrival, each where it
leaves the least room. Then bins give to the others, the emptiest first: a bin moves a piece, exchanges one for one, or two
for one, always so that the other bin, which is no emptier, gets fuller. That raises the sum of squared fills with every step,
until the bin is empty and goes, or has no step left. Exchanges are looked up by size: for every number of tokens, the smallest
piece that could come back for them. Passes over all bins go on until the group has as few bins as its sizes allow, or two
whole passes in a row have emptied none; there is no limit on steps or passes.
Each group leaves about one bin that is not full, in about four thousand bins.

Nulls: a null text counts as empty; its only token is the end id. Repeated rows are packed each on its own and dealt to groups
one by one. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored, tidy_groups
from .tokens import batches, encoder

LENGTH = 4096
GROUP = 16_000
CHARACTERS = 300_000  # of texts encoded at a time, about; more take memory and save no time
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def in_order(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: pieces as they come, each where it leaves the least room."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms, out, n = 0, [], 0  # bit r of rooms: some bin has room r
    for size in lengths.tolist():
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen, n = capacity, n, n + 1
        if room > size:
            free[room - size].append(chosen)
            rooms |= 1 << (room - size)
        out.append(chosen)
    return np.array(out, np.int64)


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing goes below.

    Besides the sum of sizes: pieces of a size t or more stand at most capacity // t in a bin; and pieces over half a bin each need
    their own, so that smaller ones of t or more only have the room those leave."""
    if not len(sizes):
        return 0
    number = np.bincount(sizes, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    from_here = np.cumsum(number[::-1])[::-1]  # pieces of this size or more
    summed = np.cumsum((number * size)[::-1])[::-1]
    t = np.unique(sizes[sizes > 0])
    by_number = int((-(-from_here[t] // (capacity // t))).max(initial=0))
    half = capacity // 2 + 1
    t = t[t < half]
    alone = from_here[np.minimum(capacity - t + 1, capacity)] * (t > 0)  # next to these, nothing of t fits
    large, filled = from_here[half] - alone, summed[half] - summed[np.minimum(capacity - t + 1, capacity)] * (t > 0)
    small = summed[t] - summed[half]
    by_room = alone + large + np.maximum(0, -(-(small - (large * capacity - filled)) // capacity))
    return max(-(-int(sizes.sum()) // capacity), by_number, int(by_room.max(initial=0)))


class Search:
    """The state of a local search: sizes of pieces, the bin of each, and how full bins are."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, capacity: int):
        self.sizes, self.bins, self.capacity = sizes.astype(np.int64), bins.astype(np.int64), capacity
        self.fill = np.bincount(bins, weights=sizes, minlength=1).astype(np.int64)
        self.least = least_bins(self.sizes, capacity)
        self.steps = {"move": 0, "one for one": 0, "two for one": 0}

    def run(self) -> np.ndarray:
        """The bin of each piece after the last pass."""
        alive, idle = int((self.fill > 0).sum()), 0
        while idle < 2:
            emptied = 0
            for giver in np.argsort(self.fill, kind="stable").tolist():
                if alive - emptied <= self.least:
                    return self.bins
                if 0 < self.fill[giver] < self.capacity:
                    self._give(giver)
                    emptied += self.fill[giver] == 0
            alive -= emptied
            idle = 0 if emptied else idle + 1
        return self.bins

    def _give(self, giver: int) -> None:
        """Steps out of one bin, until it is empty or has none left. No bin that takes is emptier than it."""
        others = self.fill >= self.fill[giver]
        others[giver] = False
        room = np.where(others, self.capacity - self.fill, 0)
        near = np.flatnonzero(room[self.bins] > 0)  # pieces of bins that may take
        mine = np.flatnonzero(self.bins == giver).tolist()
        while mine:
            mine.sort(key=lambda i: -self.sizes[i])
            if not (self._move(mine, giver, room) or self._exchange(mine, giver, room, near)):
                return

    def _shift(self, giver: int, taker: int, by: int, room: np.ndarray) -> None:
        self.fill[giver] -= by
        self.fill[taker] += by
        room[taker] -= by

    def _move(self, mine: list[int], giver: int, room: np.ndarray) -> bool:
        """The largest piece that fits anywhere goes to where it leaves the least room."""
        most = int(room.max())
        for i in mine:
            size = int(self.sizes[i])
            if size <= most:
                taker = int(np.where(room >= size, room, self.capacity + 1).argmin())
                self.bins[i] = taker
                mine.remove(i)
                self._shift(giver, taker, size, room)
                self.steps["move"] += 1
                return True
        return False

    def _exchange(self, mine: list[int], giver: int, room: np.ndarray, near: np.ndarray) -> bool:
        """The exchange of one piece, or else of two, for one that takes most from the giver."""
        at = near[(self.bins[near] != giver) & (room[self.bins[near]] > 0)]
        if not len(at):
            return False
        theirs = self.sizes[at]
        limit = theirs + room[self.bins[at]]
        # the smallest piece that could come back for so many tokens, by size
        back = np.full(self.capacity + 1, self.capacity + 1)
        np.minimum.at(back, limit, theirs)
        back = np.minimum.accumulate(back[::-1])[::-1]
        kinds, of, number = np.unique(self.sizes[mine], return_inverse=True, return_counts=True)
        gain = kinds - back[kinds]
        k = int(gain.argmax())
        kind, out = "one for one", [k]
        if gain[k] <= 0:
            both = kinds[:, None] + kinds
            fits = (both <= self.capacity) & (np.triu(np.ones(both.shape, bool), 1) | np.diag(number > 1))
            gain = np.where(fits, both - back[np.minimum(both, self.capacity)], 0)
            k = int(gain.argmax())
            kind, out = "two for one", list(divmod(k, len(kinds)))
            if gain.flat[k] <= 0:
                return False
        size, given = int(kinds[out].sum()), []
        for x in out:
            given.append(next(mine[i] for i in np.flatnonzero(of == x).tolist() if mine[i] not in given))
        piece = int(at[np.flatnonzero((theirs == back[size]) & (limit >= size))[0]])
        taker = int(self.bins[piece])
        self.bins[given] = taker
        self.bins[piece] = giver
        for i in given:
            mine.remove(i)
        mine.append(piece)
        self._shift(giver, taker, size - int(self.sizes[piece]), room)
        self.steps[kind] += 1
        return True


def pack(lengths: np.ndarray, capacity: int = LENGTH) -> np.ndarray:
    """The bin of each piece, as few bins as the search finds."""
    return Search(lengths, in_order(lengths, capacity), capacity).run()


def _cut(path: str, end: int, capacity: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in found:
            keys = batch.column("doc_id").to_pylist()
            at = 0
            for part in batches(batch.column("text").to_pylist(), CHARACTERS):
                ids, lengths = encode.encode(part, end)
                wide = memoryview(ids.astype("<u4").tobytes())
                pieces = -(-lengths // capacity)  # of each text
                of = np.repeat(np.arange(len(part)), pieces)
                number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(lengths[of] - start, capacity)
                first = (np.cumsum(lengths) - lengths)[of] + start
                crc = [zlib.crc32(wide[a:b]) for a, b in zip((4 * first).tolist(), (4 * (first + length)).tolist())]
                ids_of = pa.array(keys[at : at + len(part)], pa.int64()).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
                at += len(part)
        give_back()

    return run


def _pack_group(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ids_crc32", "doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins = pack(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        sizes = lengths[order]
        until = np.cumsum(sizes)
        new = np.flatnonzero(np.diff(bins[order], prepend=-1))
        begin = np.repeat((until - sizes)[new], np.diff(np.append(new, len(order))))
        offset = np.zeros(len(rows), np.int64)
        offset[order] = until - sizes - begin
        rows["sequence_id"] = rows["pack_group"].to_numpy(np.int64) * 2**32 + bins
        rows["offset"] = offset
        return rows.drop(columns="pack_group")

    return run


def pack_pieces(pieces: DataFrame, capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to stored rows of (doc_id, piece, start, length, ids_crc32)."""
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(tidy_groups(_pack_group(capacity)), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end: int = 1, capacity: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cut(path, end, capacity), PIECES)
    return pack_pieces(stored(cut, "pieces"), capacity)
