"""Homomorphic multiset hash of documents, in DataFrame functions only.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector, and a document's fingerprint
is the sum of its paragraphs' vectors: 16 lanes modulo 2^32 that hash the paragraph as a whole, and 128 lanes that count the
hash bits of its neighbouring word pairs, written modulo 2^16. Sums do not depend on order, and a paragraph is added or taken
away by adding or subtracting its vector (combine()). Equal multisets have equal fingerprints.

Each of the 128 lanes is a sum of plus or minus one over the word pairs (twice the count less their number), so the mean
square of the difference of two fingerprints estimates how many pairs differ, and their likeness is one minus that over the
sum of their own mean squares, held within 0 and 1. It is exactly 1 for equal fingerprints. It is taken from the whole counts,
which a text cannot overflow, not from the lanes as written.

The next document is found within ranges of documents in order of doc_id. Bounds are quantiles of doc_id (SEGMENTS at most), so
that far-off ids do not widen the others; between two bounds, ranges have equal widths. A doc_id that fills several quantiles,
and null, are dealt to ranges by row.

Nulls: a null text counts as empty, which is one empty paragraph. Rows that share a doc_id follow each other in one fixed order
for the same input; rows with a null doc_id come last in falling order. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WIDE = 8  # 64-bit hashes of a whole paragraph, two lanes each
DOCS_PER_RANGE = 1_000
SUB = 1 << 40  # ranges of a segment are numbered below this
SEGMENTS = 1_000  # quantiles of doc_id that the driver holds
HALF, LOW32, LANE_BITS = 0xFFFF, 0xFFFFFFFF, 0x0000000100000001


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def whole_lanes(text: Column) -> Column:
    """16 sums, modulo 2^32, over the paragraphs."""
    lanes = []
    for seed in range(WIDE):
        hashes = F.transform(paragraphs(text), _seeded(seed))
        lanes.append(F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + h.bitwiseAND(F.lit(LOW32))).bitwiseAND(F.lit(LOW32))))
        lanes.append(F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(LOW32))))
    return F.array(*lanes)


def _seeded(seed: int):
    return lambda p: F.xxhash64(F.lit(seed), p)


def pair_hashes(text: Column) -> Column:
    """One hash per word: of the word and the next one in its paragraph."""
    words = F.transform(paragraphs(text), lambda p: F.split(p, " ", -1))
    return F.flatten(F.transform(words, lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)))))


def _pair_sums() -> list[Column]:
    """64 sums of two 32-bit counts each, over rows with hashes h and g."""
    return [F.sum(F.shiftrightunsigned(c, s).bitwiseAND(F.lit(LANE_BITS))).alias(f"{c}{s}") for c in ("h", "g") for s in range(32)]


def _pair_lanes() -> Column:
    sums = F.array(*[F.col(f"{c}{s}") for c in ("h", "g") for s in range(32)])
    return F.concat(F.transform(sums, lambda x: x.bitwiseAND(F.lit(LOW32))), F.transform(sums, lambda x: F.shiftrightunsigned(x, 32)))


def combine(a: Column, b: Column, sign: int = 1, modulus: int = 1 << 32) -> Column:
    """Lanes of a with those of b added (sign 1) or taken away (sign -1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x.cast("long") + sign * y.cast("long"), F.lit(modulus)))


def as_text(whole: Column, n: Column, pairs: Column) -> Column:
    """A fingerprint's lanes as lower-case hex digits: 16 x 8 of the wholes, 8 of the number of pairs, 128 x 4 of the pairs."""
    digits = lambda lanes, size: F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), size, "0")), "")
    return F.lower(F.concat(digits(whole, 8), F.lpad(F.hex(n), 8, "0"), digits(F.transform(pairs, lambda x: x.bitwiseAND(F.lit(HALF))), 4)))


def _square(lanes: Column) -> Column:
    """Mean square."""
    return F.aggregate(lanes, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size(lanes)


def likeness(pairs_a: Column, n_a: Column, pairs_b: Column, n_b: Column) -> Column:
    """From 0 to 1."""
    own = lambda lanes, n: _square(F.transform(lanes, lambda x: 2 * x - n))
    apart = _square(F.zip_with(pairs_a, pairs_b, lambda x, y: 2 * (x - y) - (n_a - n_b)))
    both = own(pairs_a, n_a) + own(pairs_b, n_b)
    return F.when(apart == 0, F.lit(1.0)).otherwise(F.least(F.greatest(1 - apart / both, F.lit(0.0)), F.lit(1.0)))


def with_ranges(rows: DataFrame, per_range: int, segments: int) -> DataFrame:
    """rows with `range`, which rises with doc_id (null first) and has about per_range rows; only quantiles reach the driver."""
    shares = [i / segments for i in range(segments + 1)]
    n, nulls, bounds = rows.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", shares, 10 * segments)).first()
    bounds = (bounds or [])[:: max(1, -(-segments * per_range // max(1, n)))]  # no more segments than ranges
    spread = lambda k: F.pmod(F.xxhash64("row"), F.lit(max(1, k)))
    wide = max(1, min(SUB - 1, -(-n // (max(1, len(bounds) - 1) * per_range))))
    nowhere = spread(min(SUB - 1, -(-nulls // per_range))) - SUB
    if not bounds:
        return rows.withColumn("range", nowhere)
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    segment = F.size(F.filter(held, lambda b: b <= F.col("doc_id")))
    placed = rows.withColumn("segment", segment).withColumn("low", F.get(held, F.col("segment") - 1)).withColumn("high", F.get(held, F.col("segment")))
    many = F.size(F.filter(held, lambda b: b == F.col("doc_id")))
    inside = F.floor((F.col("doc_id").cast("double") - F.col("low").cast("double")) / F.greatest(F.col("high").cast("double") - F.col("low").cast("double"), F.lit(1.0)) * wide)
    inside = F.when(many > 1, F.pmod(F.xxhash64("row"), F.least(many * wide, F.lit(SUB)))).otherwise(F.coalesce(F.least(inside, F.lit(wide)), F.lit(0)))
    # a doc_id of several quantiles has a segment of its own, just below what follows it
    number = F.when(many > 1, 2 * F.col("segment")).otherwise(2 * F.col("segment") + 1) * F.lit(SUB) + inside
    return placed.withColumn("range", F.when(F.col("doc_id").isNull(), nowhere).otherwise(number).cast("long")).drop("segment", "low", "high")


def _next_range(rows: DataFrame) -> DataFrame:
    """(range, next_range) in falling order, the first after the last. Only one row per segment is in a window without partitions."""
    ranges = rows.select("range").distinct().withColumn("segment", F.floor(F.col("range") / F.lit(SUB)))
    inside = ranges.withColumn("next_range", F.lead("range").over(Window.partitionBy("segment").orderBy(F.desc("range"))))
    down = Window.orderBy(F.desc("segment"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = ranges.groupBy("segment").agg(F.max("range").alias("top"))
    tops = tops.select("segment", F.coalesce(F.lead("top").over(down), F.max("top").over(every)).alias("top"))
    return inside.join(tops, "segment").select("range", F.coalesce("next_range", "top").alias("next_range"))


def _with_next(rows: DataFrame, order: list[Column], what: Column, name: str) -> DataFrame:
    """rows with `name`: what of the next row, within its range or at the head of the next range."""
    inside = Window.partitionBy("range").orderBy(*order)
    placed = rows.withColumn("at", F.row_number().over(inside)).withColumn(name, F.lead(F.struct(what.alias("v"))).over(inside))
    heads = placed.where("at = 1").select(F.col("range").alias("next_range"), F.struct(what.alias("v")).alias("head"))
    return placed.join(_next_range(rows.select("range")).join(heads, "next_range").drop("next_range"), "range").withColumn(name, F.coalesce(name, "head")["v"]).drop("head")


def _stored_as_dealt(df: DataFrame, name: str) -> DataFrame:
    """Store df; its joins on (range, at) may use sides that are dealt by range alone, so nothing is exchanged for them."""
    conf, setting = df.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(setting)
    conf.set(setting, "false")
    try:
        return stored(df, name)
    finally:
        conf.set(setting, before)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row, of its text and of its edited text (whose second half comes from the next document): see the module."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    ranged = with_ranges(rows, DOCS_PER_RANGE, SEGMENTS)
    near = _with_next(ranged, [F.desc("doc_id"), F.xxhash64("text"), F.col("row")], F.col("text"), "next_text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = near.select("range", "at", "doc_id", "text", edited.alias("edited"))
    wholes = both.select("range", "at", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), whole_lanes(F.col("text")).alias("whole"), whole_lanes(F.col("edited")).alias("edited_whole"))
    each = both.select("range", "at", F.explode(F.array(F.struct(F.lit(0).alias("which"), pair_hashes(F.col("text")).alias("hashes")), F.struct(F.lit(1).alias("which"), pair_hashes(F.col("edited")).alias("hashes")))).alias("x"))
    hashes = each.select("range", "at", F.col("x.which").alias("which"), F.explode("x.hashes").alias("h")).withColumn("g", F.xxhash64("h"))
    # rows are dealt by range already, so these sums need no further exchange
    sums = hashes.groupBy("range", "at", "which").agg(F.count(F.lit(1)).alias("n"), *_pair_sums()).select("range", "at", "which", "n", _pair_lanes().alias("pairs"))
    sides = sums.groupBy("range", "at").agg(*[F.first(F.when(F.col("which") == k, F.col(c)), ignorenulls=True).alias(p + c) for k, p in ((0, ""), (1, "edited_")) for c in ("n", "pairs")])
    kept = _stored_as_dealt(wholes.join(sides, ["range", "at"]), "fingerprints")
    then = _with_next(kept, [F.col("at")], F.struct("n", "pairs"), "following")
    return then.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("whole"), F.col("n"), F.col("pairs")).alias("fingerprint"),
        as_text(F.col("edited_whole"), F.col("edited_n"), F.col("edited_pairs")).alias("edited_fingerprint"),
        likeness(F.col("pairs"), F.col("n"), F.col("edited_pairs"), F.col("edited_n")).alias("near_edited"),
        likeness(F.col("pairs"), F.col("n"), F.col("following.pairs"), F.col("following.n")).alias("near_next"),
    )
