"""SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint has 64 bits, one per bit of its shingles' XXH64 values, set where over half of them have it. To find all pairs
that differ in at most DISTANCE bits, correlated bits are grouped into m partitions with thresholds that add up to
DISTANCE - m + 1; a pair that links must be within the threshold of at least one partition. A partition of threshold -1 is not
searched. Partitions and thresholds come from a dynamic programme over candidate counts, estimated from a sample of SAMPLE
fingerprints; they change the work, never the result: every candidate is verified on all 64 bits.

Copies share a fingerprint and are searched once. A bucket with more than CROWD fingerprints is not compared pair by pair:
two fingerprints differ in at most 2 bits just when they share a neighbour at 1 bit or less, so the members of crowded
buckets are tied through such neighbours, exactly and in proportion to their number.

Nulls and empty texts have no words and the fingerprint 0, which links like any other. Rows with the same doc_id are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

BITS = 64
DISTANCE = 2
SHINGLE = 3
SEED = 42
SAMPLE = 4_000
CROWD = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one whole text, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 65_536):
        a, b = starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist()
        hashes = np.fromiter((xxh64_intdigest(joined[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal size; each takes, one by one, the bit that correlates most with those it has."""
    with np.errstate(invalid="ignore", divide="ignore"):
        like = np.abs(np.nan_to_num(np.corrcoef(bits.T)))
    np.fill_diagonal(like, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        first = max(left, key=lambda i: (like[i, sorted(left)].max(), -i))
        part = [first]
        left.remove(first)
        while len(part) < size:
            nearest = max(left, key=lambda i: (like[i, part].sum(), -i))
            part.append(nearest)
            left.remove(nearest)
        out.append(sorted(part))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one per partition, that add up to total at the least cost (dynamic programme over partitions)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (paid, chosen) in best.items():
            for e, c in cost.items():
                if spent + e not in step or paid + c < step[spent + e][0]:
                    step[spent + e] = (paid + c, [*chosen, e])
        best = step
    return best[total]


def plan(sample: np.ndarray, n: int, distance: int = DISTANCE, row_cost: float = 1.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition to search, for n fingerprints of which sample are some.

    A row under a key costs as much as row_cost comparisons."""
    bits = np.unpackbits(sample.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = bits[:1500].astype(np.float32)
    pairs = max(1, len(some) * (len(some) - 1) // 2)
    upper = np.triu_indices(len(some), 1)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, distance + 3):
        parts = group_bits(bits.astype(np.float64), m) if len(bits) > 1 else [p.tolist() for p in np.array_split(np.arange(BITS), m)]
        costs = []
        for part in parts:
            x = some[:, part]
            ones = x.sum(axis=1)
            apart = (ones[:, None] + ones[None, :] - 2 * x @ x.T)[upper]
            cost, probes = {-1: 0.0}, 0.0
            for e in range(distance + 1):
                probes += math.comb(len(part), e)
                met = float((apart <= e).sum() + 0.5) / pairs * n * n / 2
                cost[e] = row_cost * n * (1 + probes) + met
            costs.append(cost)
        paid, chosen = allocate(costs, distance - m + 1)
        if paid < best[0]:
            best = (paid, [(p, e) for p, e in zip(parts, chosen) if e >= 0])
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _masked(number: int, mask: Column):
    return lambda flip: F.struct(F.lit(number).alias("part"), F.col("fp").bitwiseXOR(flip).bitwiseAND(mask).alias("key"))


def _keys(partitions: list[tuple[list[int], int]], probing: bool) -> Column:
    """Array of (part, key) under which a fingerprint is stored, or looked for."""
    out = []
    for number, (bits, e) in enumerate(partitions):
        mask = F.lit(_signed(sum(1 << b for b in bits)))
        flips = [0] + [sum(1 << b for b in c) for k in range(1, e + 1) for c in combinations(bits, k)] if probing else [0]
        array = F.array(*[F.lit(_signed(f)) for f in flips])
        out.append(F.transform(array, _masked(number, mask)))
    return F.concat(*out)


def links(distinct: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """(a, b): links of fingerprints that join all pairs within distance into the same components.

    distinct has one row per fingerprint in column fp. Outside crowded buckets every pair is listed.
    """
    if distance > 2:
        raise ValueError("crowded buckets are tied exactly up to a distance of 2")
    n = distinct.count()
    sample = [r.fp for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    if n < 2:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    partitions = plan(np.array(sample, np.int64), n, distance)
    index = distinct.select("fp", F.explode(_keys(partitions, False)).alias("at")).select("fp", "at.part", "at.key")
    probe = distinct.select("fp", F.explode(_keys(partitions, True)).alias("at")).select("fp", "at.part", "at.key")
    sizes = stored(index.groupBy("part", "key").count().where("count > 1" if all(e == 0 for _, e in partitions) else "count > 0"), "buckets")
    lists = index.join(sizes.where(F.col("count") <= crowd), ["part", "key"]).groupBy("part", "key").agg(F.collect_list("fp").alias("members"))
    near = F.filter("members", lambda y: (y < F.col("fp")) & (F.bit_count(y.bitwiseXOR(F.col("fp"))) <= distance))
    pairs = probe.join(lists, ["part", "key"]).select(F.col("fp").alias("a"), near.alias("near")).where(F.size("near") > 0).select("a", F.explode("near").alias("b"))
    reverse = F.filter("members", lambda y: (y > F.col("fp")) & (F.bit_count(y.bitwiseXOR(F.col("fp"))) <= distance))
    if any(e > 0 for _, e in partitions):  # the smaller one may be the one that looks
        pairs = probe.join(lists, ["part", "key"]).select(F.col("fp").alias("a"), F.concat(near, reverse).alias("near")).select("a", F.explode("near").alias("b"))
    crowded = probe.join(sizes.where(F.col("count") > crowd).select("part", "key"), ["part", "key"], "left_semi").select("fp").distinct()
    around = F.concat(F.array("fp"), F.transform(F.array(*[F.lit(_signed(1 << b)) for b in range(BITS)]), lambda f: F.col("fp").bitwiseXOR(f)))
    stars = crowded.select("fp", F.explode(around if distance == 2 else F.slice(around, 1, 1 + BITS * (distance > 0))).alias("middle")).groupBy("middle").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("members"))
    tied = stars.where(F.size("members") > 1).select(F.explode("members").alias("a"), "b").where("a <> b")
    if distance < 2:
        tied = tied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return pairs.union(tied).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach)."""
    rows = stored(fingerprints(docs, text, key), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(distinct.select("fp"), distance), "a", "b").select(F.col("node").alias("fp"), "component")
    placed = distinct.join(labels, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    heads = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = placed.join(heads, "component").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(ids, "fp").select("doc_id", digits, "component_id")
