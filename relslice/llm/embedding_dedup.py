"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation is learned on at most FIT vectors so that the signs of the rotated coordinates lose least (iterative
quantisation after principal components); random rotations of the same components fill up to BITS signs, a vector's binary
code. The code's bits are cut into substrings, and this again after further rearrangements of the bits; each substring is a
table, and two vectors meet where they agree on a whole substring. Substrings grow with the number of vectors, and the number
of tables with the length of the substrings: there are as many as a pair at THRESHOLD needs to meet with probability RECALL,
if its signs differ independently. Vectors that meet are compared by their codes first, which travel without the vectors: only
those that have another within so many bits as a pair at THRESHOLD has at most (but for one in SLACK) are looked up again with
the original vectors, compared by cosine in double precision, and linked from THRESHOLD up. All vectors are in the tables; only the rotation and the components come from a sample. Tests measure recall
against brute force, with the tables of millions of vectors too.

Equal vectors are searched once and counted with their number. A bucket is compared in blocks of at most BLOCK vectors; a
bucket with more is dealt out as pairs of blocks, so that no task holds a whole bucket. A pair that meets in several tables
counts in the first of them. A task gives, per vector, its number of links and one link to the smallest vector it is tied to,
never all pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of unlike length do not link
with each other. Rows with a null vec_id are kept, without links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

THRESHOLD = 0.9
FIT = 10_000
BITS = 256
RECALL = 0.99
#: What an entry of a table costs, in comparisons of two vectors.
ENTRY = 2_000
BLOCK = 2_048
CELL = 20_000
SLACK = 1_000
ROUNDS = 30


def learn_rotation(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """dimensions x bits: principal components times the rotation that iterative quantisation settles on."""
    r = np.random.default_rng(seed)
    z = x - x.mean(axis=0) if len(x) > 1 else x
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :bits]
    v = x @ axes
    turn, _ = np.linalg.qr(r.normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return axes @ turn


def learn_rotations(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """dimensions x bits: rotations of at most 64 columns side by side. The first is learned; the others stay at their random
    start, as learned ones may settle on the same signs, which would find nothing new."""
    each = min(x.shape[1], 64)
    return np.concatenate([learn_rotation(x, each, 0 if k else ROUNDS, seed=5 + k) for k in range(-(-bits // each))], axis=1)[:, :bits]


def tables_needed(bits: int, size: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many tables of `size` bits a pair at the threshold needs to meet with probability recall.

    Tables share the bits of one code, so the number of bits in which the pair differs is drawn once for all tables.
    """
    differs = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    miss = np.array([math.comb(bits, d) * differs**d * (1 - differs) ** (bits - d) for d in range(bits + 1)])
    apart = np.array([1 - math.comb(bits - d, size) / math.comb(bits, size) for d in range(bits + 1)])
    if miss[apart == 1].sum() > 1 - recall:
        raise ValueError(f"no number of tables of {size} bits reaches a recall of {recall}")
    n = 0
    while n == 0 or miss.sum() > 1 - recall:
        miss *= apart
        n += 1
    return n


def tables(bits: int, n: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11) -> list[list[int]]:
    """Bit positions of each table, for n vectors: of the lengths from 8 bits, the one that costs least at the wanted recall."""
    best: tuple[float, int, int] = (math.inf, 0, 0)
    for size in range(8, max(9, math.ceil(math.log2(max(n, 2))))):
        count = tables_needed(bits, size, threshold, recall)
        best = min(best, (count * (ENTRY + n / 2**size), size, count))
        if count * ENTRY > best[0]:
            break
    _, size, count = best
    r, out = np.random.default_rng(seed), []
    while len(out) < count:
        turned = r.permutation(bits)
        out += [turned[a : a + size].tolist() for a in range(0, bits - size + 1, size)]
    return out[:count]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codes(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """One code per vector, in words of 64 bits; vectors are cut or filled up to the rotation's dimensions."""
    v = unit(vectors)
    d = min(v.shape[1], turn.shape[0])
    bits = (v[:, :d] @ turn[:d] >= 0).astype(np.uint8)
    full = np.zeros((len(v), -(-bits.shape[1] // 64) * 64), np.uint8)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def _masks(parts: list[list[int]], words: int) -> np.ndarray:
    """tables x words: the bits of each table."""
    return np.array([[sum(1 << b % 64 for b in p if b // 64 == w) for w in range(words)] for p in parts], np.uint64)


def bucket_keys(code: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """vectors x tables: the bits of each table, side by side."""
    bits = np.unpackbits(code.view(np.uint8), axis=1, bitorder="little")
    return np.stack([bits[:, p].astype(np.int64) @ (1 << np.arange(len(p), dtype=np.int64)) for p in parts], axis=1)


def _coded(turn: np.ndarray, parts: list[list[int]]):
    def run(found):
        for rows in found:
            if not len(rows):
                continue
            lengths = rows["embedding"].map(len)
            out = np.zeros((len(rows), -(-turn.shape[1] // 64)), np.uint64)
            for d in lengths.unique():
                at = (lengths == d).to_numpy()
                out[at] = codes(np.stack(rows["embedding"][at].to_list()), turn)
            yield rows.assign(code=list(out.view(np.int64)), keys=list(bucket_keys(out, parts)))

    return run


def block_links(x: np.ndarray, y: np.ndarray, code_x: np.ndarray, code_y: np.ndarray, earlier: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x and y of pairs that link and do not meet in an earlier table (masks of bits)."""
    near = x @ y.T >= threshold
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    apart = code_x[i] ^ code_y[j]
    first = np.ones(len(i), bool)
    for mask in earlier:
        first &= ((apart & mask) != 0).any(axis=1)
    return i[first], j[first]


def _ties(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each position, the smallest id that links reach inside the block."""
    label = ids.copy()
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        if np.array_equal(least, label):
            return label
        label = least


def most_bits(bits: int, threshold: float = THRESHOLD) -> int:
    """Bits in which the codes of a pair at the threshold differ at most, but for one pair in SLACK."""
    differs = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    left = 1.0
    for d in range(bits + 1):
        left -= math.comb(bits, d) * differs**d * (1 - differs) ** (bits - d)
        if left <= 1 / SLACK:
            return d
    return bits


def _sorted(rows: pd.DataFrame) -> tuple[np.ndarray, list[tuple[int, int]], list[np.ndarray]]:
    """Order of the rows, where each bucket or pair of blocks begins and ends in it, and the columns in that order."""
    keys = [rows[c].to_numpy(np.int64) for c in ("vec_id", "block", "right", "left", "bucket", "table")]
    order = np.lexsort(keys)
    columns = [k[order] for k in keys]
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in columns[2:]:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new).tolist()
    return order, list(zip(starts, [*starts[1:], len(rows)])), columns


def _meet(bits: int, most: int):
    """Vectors whose code has another in its bucket that differs in at most `most` bits."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        order, groups, (ids, block, right, left, *_) = _sorted(rows)
        code = np.unpackbits(np.stack(rows["code"].to_list()).astype(np.int64).view(np.uint8)[order], axis=1, bitorder="little")[:, :bits].astype(np.float32) * 2 - 1
        hit = np.zeros(len(rows), bool)
        for a, b in groups:
            same = left[a] == right[a]
            one = np.arange(a, b) if same else a + np.flatnonzero(block[a:b] == left[a])
            two = one if same else a + np.flatnonzero(block[a:b] == right[a])
            near = code[one] @ code[two].T >= bits - 2 * most
            if same:
                np.fill_diagonal(near, False)
            hit[one] |= near.any(axis=1)
            hit[two] |= near.any(axis=0)
        return pd.DataFrame({"vec_id": np.unique(ids[hit])})

    return run


def _compare(parts: list[list[int]], threshold: float):
    """One cell: many buckets, or blocks of them, one after the other."""
    masks = _masks(parts, -(-BITS // 64))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        order, groups, (ids, block, right, left, _, table) = _sorted(rows)
        x = unit(np.stack(rows["embedding"].to_list()))[order]
        code, weight = np.stack(rows["code"].to_list()).astype(np.int64).view(np.uint64)[order], rows["copies"].to_numpy(np.int64)[order]
        out = []
        for a, b in groups:
            same = left[a] == right[a]
            one = np.arange(a, b) if same else a + np.flatnonzero(block[a:b] == left[a])
            two = one if same else a + np.flatnonzero(block[a:b] == right[a])
            if len(one) < 1 + same or not len(two):
                continue
            i, j = block_links(x[one], x[two], code[one], code[two], masks[: table[a]], threshold, bool(same))
            if len(i):
                i, j = one[i] - a, two[j] - a
                n = np.zeros(b - a, np.int64)
                np.add.at(n, i, weight[a:b][j])
                np.add.at(n, j, weight[a:b][i])
                hit = n > 0
                out.append(np.stack([ids[a:b][hit], n[hit], _ties(ids[a:b], i, j)[hit]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"vec_id": found[0], "n": found[1], "tie": found[2]})

    return run


def _usable(column: str):
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _dealt(coded: DataFrame, tables_of: int) -> DataFrame:
    """(vec_id, code, dims, table, bucket, block, left, right, cell): vectors under their buckets, by pairs of blocks, in cells of
    about CELL rows; a block of a bucket, or a pair of blocks, lies in one cell."""
    bucket = ["dims", "table", "bucket"]
    entries = coded.select("vec_id", "code", F.size("embedding").alias("dims"), F.posexplode("keys").alias("table", "bucket"))
    # stored, so that a common bucket can be split over tasks when it is joined
    sizes = stored(entries.groupBy(*bucket).count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")), "vector-buckets")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = entries.join(sizes, bucket).withColumn("block", block).select("vec_id", "code", *bucket, "block", other)
    cells = max(1, -(-coded.count() * tables_of // CELL))
    cell = F.pmod(F.xxhash64(*bucket, "left", "right"), F.lit(cells)).alias("cell")
    return placed.select("vec_id", "code", *bucket, "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).select("*", cell)


def near_duplicates(vectors: DataFrame, embedding: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id that links reach), kept (it is that vec_id)."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    usable = rows.where(F.coalesce(_usable("embedding"), F.lit(False)) & F.col("vec_id").isNotNull())
    distinct = stored(usable.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    n = distinct.count()
    single = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if n == 0:
        return single.withColumn("kept", F.lit(True))
    sample = [r.embedding for r in distinct.select("embedding").orderBy(F.xxhash64("embedding")).limit(FIT).collect()]
    size = max(map(len, sample))
    fitted = unit(np.array([v for v in sample if len(v) == size]))
    turn = learn_rotations(fitted)
    parts = tables(turn.shape[1], n, threshold)
    coded = stored(distinct.mapInPandas(_coded(turn, parts), "embedding array<double>, vec_id long, copies long, code array<long>, keys array<long>"), "codes")
    met = _dealt(coded, len(parts)).groupBy("dims", "cell").applyInPandas(_meet(turn.shape[1], most_bits(turn.shape[1], threshold)), "vec_id long")
    some = stored(coded.join(stored(met.distinct(), "met"), "vec_id", "left_semi"), "met-vectors")
    full = _dealt(some, len(parts)).drop("code").join(some.select("vec_id", "embedding", "copies", "code"), "vec_id")
    found = full.groupBy("dims", "cell").applyInPandas(_compare(parts, threshold), "vec_id long, n long, tie long")
    links = stored(found.groupBy("vec_id", "tie").agg(F.sum("n").alias("n")), "vector-links")
    labels = components(links, "vec_id", "tie").select(F.col("node").alias("vec_id"), "component")
    counted = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
    result = coded.join(counted, "vec_id", "left").join(labels, "vec_id", "left")
    result = result.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    linked = usable.join(result, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(_usable("embedding"), F.lit(False)) | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
