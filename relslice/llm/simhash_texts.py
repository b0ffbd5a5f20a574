"""Near-duplicate texts: SimHash fingerprints find candidates, the Jaccard similarity of word shingles decides.

Two texts are near duplicates if their sets of SHINGLE-word shingles have a Jaccard similarity of SIMILARITY or more. Such
texts share nearly all words, so their fingerprints of single words, each counted once, differ in few bits (DISTANCE), while
fingerprints of long shingles would not. The bits are partitioned, and thresholds of the partitions allotted, as in simhash
(generalised pigeonhole): two fingerprints within DISTANCE meet under a key of at least one partition. Texts that meet are
compared on all 64 bits; those that have another within DISTANCE are then compared on a sketch of their shingles too (one
minimum in each of BINS bins), and what passes is verified on the shingle sets of the texts themselves.

Texts of equal words are searched once. A key with many texts is compared in blocks of at most BLOCK, dealt out as pairs of
blocks, so no task holds a whole key. Within a task a pair is passed over if it is tied already, so copies of one text give a
tree of links and not all pairs. Where the texts do not confirm a tie, its group is compared again, with ties by shingles alone.
The share of similar pairs that the fingerprints find is measured in the tests.

Texts are compared in lower case (A-Z). A null or empty text has no words; such rows are alike. Fewer words than a shingle
make one shingle. Rows with the same key column stay apart if the keys differ; the key must be unique and not null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy, tidy_groups
from .components import components
from .simhash import BITS, SAMPLE, _keys, plan

SHINGLE = 5
SIMILARITY = 0.8
DISTANCE = 7
BINS = 256
LEEWAY = 0.06  # what the sketch may be off
BLOCK = 4_096
CELL = 20_000
ROW_COST = 2_000  # a row under a key, in comparisons of two fingerprints
SKETCHED = "row long, same binary, fp long, sketch binary"


def word_hashes(text: str | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of runs of word hashes, in rising order."""
    n = max(1, len(words) - shingle + 1) if len(words) else 0
    h = np.zeros(n, np.uint64)
    for j in range(min(shingle, len(words))):
        h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)) ^ (h >> np.uint64(32)))


def word_fingerprint(words: np.ndarray) -> int:
    """Bits that over half of the distinct words have, as a signed 64-bit number."""
    if not len(words):
        return 0
    each = np.unique(words)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(each), 65_536):
        total += np.unpackbits(each[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(each)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Per bin of hash values 16 bits of the least hash in it; 0 where the bin is empty."""
    starts = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
    at = np.searchsorted(shingles, starts)
    ends = np.append(at[1:], len(shingles))
    out = np.zeros(BINS, np.uint16)
    full = at < ends
    out[full] = (shingles[at[full]] >> np.uint64(16)).astype(np.uint16) | np.uint16(1)
    return out


def _sketched(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in found:
        out: list[tuple] = []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
            words = word_hashes(text.as_py())
            out.append((row, xxh3_128_digest(words.tobytes()), word_fingerprint(words), sketch(shingle_hashes(words)).tobytes()))
        if out:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["row", "same", "fp", "sketch"])


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sets of shingle hashes (in rising order) are similar."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= SIMILARITY * (len(one) + len(two) - both)


def tied(ids: np.ndarray, fps: np.ndarray, sketches: np.ndarray, left: np.ndarray, distance: int, least: float, label: np.ndarray | None = None, test: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links (positions) that tie all texts alike: each text of `left` against all others, unless they are tied already.

    label has equal numbers where texts are tied from the start. Without a test, what the sketches do not tell apart is tied."""
    label, out = np.arange(len(ids)) if label is None else label.copy(), []
    for i in np.flatnonzero(left).tolist():
        near = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= distance) & (label != label[i]))
        if len(near):
            there = (sketches[near] | sketches[i]) != 0
            close = ((sketches[near] == sketches[i]) & there).sum(axis=1) >= least * np.maximum(there.sum(axis=1), 1)
            for j in near[close].tolist():
                if label[j] != label[i] and (test is None or test(i, j)):
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def _groups(rows: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Where each pair of blocks of one key begins and ends in sorted rows."""
    new = np.flatnonzero((rows[["part", "key", "left", "right"]].diff() != 0).any(axis=1).to_numpy())
    return zip(new.tolist(), [*new[1:].tolist(), len(rows)])


def _meet(distance: int):
    """Rows that have another within distance."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "key", "left", "right", "row"], kind="stable").reset_index(drop=True)
        fps, left, hit = rows["fp"].to_numpy(np.int64).view(np.uint64), (rows["block"] == rows["left"]).to_numpy(), np.zeros(len(rows), bool)
        for a, b in _groups(rows):
            for i in (a + np.flatnonzero(left[a:b])).tolist():
                near = np.bitwise_count(fps[a:b] ^ fps[i]) <= distance
                near[i - a] = False
                if near.any():
                    hit[a:b] |= near
                    hit[i] = True
        return pd.DataFrame({"row": np.unique(rows["row"].to_numpy(np.int64)[hit])})

    return run


def _compare(distance: int, least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "key", "left", "right", "row"], kind="stable").reset_index(drop=True)
        ids, fps, left = rows["row"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64), (rows["block"] == rows["left"]).to_numpy()
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(len(rows), BINS)
        out = []
        for a, b in _groups(rows):
            out += [(int(ids[a + i]), int(ids[a + j])) for i, j in tied(ids[a:b], fps[a:b], sketches[a:b], left[a:b], distance, least)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _verify(distance: int, least: float):
    """As _compare(), but only what the shingles themselves confirm is tied; `known` has the links that are confirmed already."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "key", "left", "right", "row"], kind="stable").reset_index(drop=True)
        ids, fps, left = rows["row"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64), (rows["block"] == rows["left"]).to_numpy()
        sketches, known = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(len(rows), BINS), rows["known"].to_numpy(np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        out = []
        for a, b in _groups(rows):
            found = tied(ids[a:b], fps[a:b], sketches[a:b], left[a:b], distance, least, known[a:b], lambda i, j, a=a: alike(sets[a + i], sets[a + j]))
            out += [(int(ids[a + i]), int(ids[a + j])) for i, j in found]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _shingled(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        each = [shingle_hashes(word_hashes(t.as_py())).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(each, pa.binary())], ["row", "shingles"])


def _similar(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links whose texts are similar; the text of an end that many links have is taken apart once in a row."""
    last, held = None, None
    for batch in found:
        keep = []
        for a, one, two in zip(batch.column("a").to_pylist(), batch.column("one"), batch.column("two")):
            if a != last:
                last, held = a, shingle_hashes(word_hashes(one.as_py()))
            keep.append(alike(held, shingle_hashes(word_hashes(two.as_py()))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _dealt(fingerprints: DataFrame, distance: int, block: int, cell_rows: int = CELL) -> DataFrame | None:
    """Rows (row, fp) under all their keys, by pairs of blocks, in cells of about cell_rows rows; None where there is nothing to compare."""
    n = fingerprints.count()
    if n < 2:
        return None
    sample = np.array([r.fp for r in fingerprints.orderBy(F.xxhash64("row")).limit(SAMPLE).collect()], np.int64)
    partitions = plan(sample, n, distance, ROW_COST)
    entries = fingerprints.select("row", "fp", F.explode(_keys(partitions, True)).alias("at")).select("row", "fp", "at.part", "at.key")
    # stored, so that a key that many texts have can be split over tasks when it is joined
    sizes = stored(entries.groupBy("part", "key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / block).cast("int")), "keys")
    of = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = entries.join(sizes, ["part", "key"]).withColumn("block", of).select("row", "fp", "part", "key", "block", other)
    cells = max(1, -(-n * len(partitions) // cell_rows))
    cell = F.pmod(F.xxhash64("part", "key", "left", "right"), F.lit(cells)).alias("cell")
    return placed.select("row", "fp", "part", "key", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).select("*", cell)


def candidates(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): rows of distinct (row, fp, sketch) that the fingerprints bring together and the sketches do not tell apart."""
    every = _dealt(distinct.select("row", "fp"), distance, block)
    if every is not None:
        met = stored(every.groupBy("cell").applyInPandas(tidy_groups(_meet(distance)), "row long").distinct(), "met")
        some = _dealt(distinct.select("row", "fp").join(met, "row", "left_semi"), distance, block)
        if some is not None:
            return some.join(distinct.select("row", "sketch"), "row").groupBy("cell").applyInPandas(tidy_groups(_compare(distance, SIMILARITY - LEEWAY)), "a long, b long").distinct()
    return distinct.sparkSession.createDataFrame([], "a long, b long")


def passed_over(near: DataFrame, links: DataFrame, distinct: DataFrame, rows: DataFrame, distance: int, block: int) -> DataFrame | None:
    """Links that candidates() passed over because of ties that did not hold; None if all did.

    Where the texts confirm less than the sketches tied, some pairs were never tried. All texts of such groups are compared again,
    now on their shingles, and only confirmed links count as ties, so no pair is left out but for those that are tied for sure."""
    failed = stored(near.join(links, ["a", "b"], "left_anti"), "failed")
    if failed.isEmpty():
        return None
    groups = stored(components(near, "a", "b"), "tied")
    doubtful = groups.join(failed.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("component").distinct()
    again = stored(groups.join(doubtful, "component", "left_semi").select(F.col("node").alias("row")), "again")
    sure = components(links, "a", "b").select(F.col("node").alias("row"), F.col("component").alias("known"))
    sets = rows.join(again, "row", "left_semi").select("row", "text").mapInArrow(tidy(_shingled), "row long, shingles binary")
    some = distinct.select("row", "fp", "sketch").join(again, "row", "left_semi").join(sets, "row").join(sure, "row", "left").withColumn("known", F.coalesce("known", "row"))
    some = stored(some, "doubtful")
    dealt = _dealt(some.select("row", "fp"), distance, max(1, block // 4), CELL // 8)  # shingles are larger than sketches
    if dealt is None:
        return None
    return stored(dealt.join(some.select("row", "sketch", "shingles", "known"), "row").groupBy("cell").applyInPandas(tidy_groups(_verify(distance, SIMILARITY - LEEWAY)), "a long, b long").distinct(), "found-again")


def near_duplicate_texts(docs: DataFrame, text: str = "text", key: str = "row", distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Per row: row, group (the smallest row that links reach, itself included)."""
    rows = docs.select(F.col(key).cast("long").alias("row"), F.col(text).alias("text"))
    told = stored(rows.mapInArrow(tidy(_sketched), SKETCHED), "sketches")
    distinct = stored(told.groupBy("same").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "distinct-texts")
    near = stored(candidates(distinct, distance, block), "candidates")
    one = near.join(rows.select(F.col("row").alias("a"), F.col("text").alias("one")), "a")
    both = one.join(rows.select(F.col("row").alias("b"), F.col("text").alias("two")), "b").select("a", "b", "one", "two")
    links = stored(both.mapInArrow(tidy(_similar), "a long, b long"), "similar")
    more = passed_over(near, links, distinct, rows, distance, block)
    labels = components(links if more is None else links.union(more), "a", "b").select(F.col("node").alias("head"), "component")
    of = told.select("row", "same").join(distinct.select("same", F.col("row").alias("head")), "same")
    return of.join(labels, "head", "left").select("row", F.coalesce("component", "head").alias("group"))
