"""Removal of passages that repeat a document with a smaller id, by FM-indexes over shards.

Words are runs of characters other than blank and \\t\\n\\v\\f\\r, unchanged. A window is WINDOW consecutive words of a document.
A word goes if a window that covers it also starts in a document with a smaller doc_id; windows are judged on the input.

1. Every window has one anchor: the smallest hash among its runs of GRAM words. Equal windows have equal anchors, so windows are
   compared only with those under the same anchor. Windows in a row of a document that have the same anchor form a passage,
   also where the run of words comes again (as in texts that repeat themselves), at most LONGEST of them; copies of a passage
   (equal hashes of anchor and words) share one entry from here on.
2. A passage is trimmed to what can repeat: sorted by the words from the anchor on, the longest beginning that it shares with
   any other passage is that shared with a neighbour; likewise backwards from the anchor. Each sort is spread over tasks by
   range, with the passage as the last key, so that a common passage is spread too; the first and last passage of a task, and
   those in which the anchor comes again, are left untrimmed. What is left of N documents around a common passage is a few pieces.
3. Pieces go to shards by their anchor. Each shard indexes its pieces (FMIndex) and streams them through it; backward search
   gives the matching statistics, of which stretches of a window and more in earlier documents are reported. An anchor with
   more than a shard's words is split: its pieces are indexed in blocks, and each piece is looked up in every block.
4. Reported stretches are carried back to the copies, gathered per document, and the words in them removed.

Nulls: a null text has no words. A null doc_id is neither smaller nor larger than another, so such rows stay whole and remove
nothing. Rows that share a doc_id do not remove each other's words; each gets a row in the result. Columns of the input stay
as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, tidy, tidy_groups
from .fm_index import FMIndex, earlier_windows

WINDOW = 50
GRAM = 8
LONGEST = 256  # windows of a passage
SHARD_WORDS = 300_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # blanks to str.split() alone
ANCHORS = "anchor long, passage long, doc_id long, part long, first int, size int, at int, again boolean"
BODIES = "anchor long, passage long, rank long, whole boolean, before string, after string"
PIECES = "anchor long, passage long, rank long, piece long, shift int, size int, body string"
RESULT = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")
FOUND = "anchor long, piece long, runs array<struct<a:int,b:int,least:long>>"


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return WORD.findall(text) if OTHER_BLANKS.search(text) else text.split()


def anchors(words: list[str], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Per passage: its anchor, its first word, its number of words, its words before the anchor, whether that comes again, a hash of all its words."""
    from xxhash import xxh3_64_intdigest, xxh64_intdigest

    n = len(words)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, []
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    h = np.fromiter(map(xxh64_intdigest, raw), np.uint64, n)
    gram = min(gram, window)
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : n - gram + 1 + j]
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    wide = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(axis=1) + np.arange(len(grams) - wide + 1)
    least = grams[at]
    changed = np.concatenate([[True], least[1:] != least[:-1]])
    here = np.arange(len(at))
    begun = np.maximum.accumulate(np.where(changed, here, 0))
    new = np.flatnonzero(changed | ((here - begun) % LONGEST == 0))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    size = last - new + window
    joined = b" ".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, n) + 1)
    a = np.concatenate([[0], ends])[new].tolist()
    b = (ends[new + size - 1] - 1).tolist()
    return grams[at[new]].view(np.int64), new, size, at[new] - new, at[last] != at[new], [xxh3_64_intdigest(joined[i:j]) - 2**63 for i, j in zip(a, b)]


def _anchors(window: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            out: list[list] = [[] for _ in range(8)]
            for doc, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("text")):
                hashes, first, size, place, again, passages = anchors(words_of(text.as_py()), window)
                for column, values in zip(out, (hashes, passages, [doc] * len(first), [part] * len(first), first, size, place, again)):
                    column.append(np.asarray(values, np.int64))
            if out[0]:
                kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(out, kinds)], ["anchor", "passage", "doc_id", "part", "first", "size", "at", "again"])

    return run


def _cut_passages(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted passage of a document: those before its anchor, last first, and those from it on."""
    for batch in found:
        for text, wanted, rank in zip(batch.column("text"), batch.column("wanted").to_pylist(), batch.column("doc_id").to_pylist()):
            words = words_of(text.as_py())
            rows = []
            for w in wanted:
                said, at = words[w["first"] : w["first"] + w["size"]], w["at"]
                rows.append((w["anchor"], w["passage"], rank, w["whole"], "".join([x + " " for x in said[:at][::-1]]), "".join([x + " " for x in said[at:]])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "passage", "rank", "whole", "before", "after"])


def common_words(a: str, b: str) -> int:
    """How many words two strings begin with alike; each word is followed by a blank."""
    if a == b:
        return a.count(" ")
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a.count(" ", 0, low)


def _shared_beginnings(column: str):
    """Rows come sorted by (anchor, column). Adds `shared`: words that the row's string begins with like a neighbour's.

    It is the whole string for the first and the last row of a task, whose neighbours may lie in another."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        last: tuple[int, str] | None = None
        carried = 0

        def judged(batch: pa.RecordBatch, after: tuple[int, str] | None) -> pa.RecordBatch:
            nonlocal last, carried
            rows = list(zip(batch.column("anchor").to_pylist(), batch.column(column).to_pylist()))
            like = [common_words(x[1], y[1]) if x[0] == y[0] else 0 for x, y in zip(rows, [*rows[1:], after] if after else rows[1:])]
            left = [rows[0][1].count(" ") if last is None else carried, *like]
            right = like if after else [*like, rows[-1][1].count(" ")]
            last, carried = rows[-1], like[-1] if after else 0
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([max(x, y) for x, y in zip(left, right)], pa.int32())], [*batch.schema.names, "shared"])

        for batch in found:
            if batch.num_rows:
                if held is not None:
                    yield judged(held, (batch.column("anchor")[0].as_py(), batch.column(column)[0].as_py()))
                held = batch
        if held is not None:
            yield judged(held, None)

    return run


def _trimmed(window: int):
    """Pieces of WINDOW words and more; `shared` is that of the words before the anchor, `after_shared` that of those after."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in found:
            out = []
            for row in batch.to_pylist():
                before, after = row["before"].split(" ")[:-1], row["after"].split(" ")[:-1]
                a, b = (len(before), len(after)) if row["whole"] else (row["shared"], row["after_shared"])
                if a + b >= window:
                    body = " ".join(before[:a][::-1] + after[:b])
                    out.append((row["anchor"], row["passage"], row["rank"], xxh3_64_intdigest(body.encode("utf-8", "surrogatepass")) - 2**63, len(before) - a, a + b, body))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["anchor", "passage", "rank", "piece", "shift", "size", "body"])

    return run


def runs(flags: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Stretches of words that flagged windows cover, as (from, to)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1 + window) for a, b in zip(edges[::2], edges[1::2])]


def _search(window: int):
    """One shard: index the pieces that are its own, look all up in those of smaller documents.

    Of each piece that is indexed here the whole is reported too, as lying in its own document."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "anchor", "piece"], kind="stable").reset_index(drop=True)
        own = np.flatnonzero(rows["own"].to_numpy(bool))
        numbers: dict[str, int] = {}
        split = [words_of(body) for body in rows["body"]]
        held = [np.array([numbers.setdefault(w, len(numbers) + 2) for w in split[i]], np.int64) for i in own.tolist()]
        ranks = rows["rank"].to_numpy(np.int64)
        found: list[list[dict]] = [[] for _ in split]
        for i in own.tolist():
            found[i].append({"a": 0, "b": len(split[i]), "least": int(ranks[i])})
        asking = np.flatnonzero(ranks > ranks[own[0]]) if len(own) else own
        if len(asking):
            index = FMIndex(held, window * 2)
            for i, flags in zip(asking.tolist(), earlier_windows(index, ranks[own], [np.array([numbers.get(w, 0) for w in split[i]], np.int64) for i in asking.tolist()], ranks[asking], window)[0]):
                found[i] += [{"a": a, "b": b, "least": int(ranks[i]) - 1} for a, b in runs(flags, window)]
        return pd.DataFrame({"anchor": rows["anchor"], "piece": rows["piece"], "runs": found})

    return run


def _repeats(trimmed: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(anchor, piece, runs): stretches of words of each piece and, of each, a document number at or above the least that has it."""
    pieces = stored(trimmed.groupBy("anchor", "piece", "size").agg(F.min("rank").alias("rank"), F.first("body").alias("body")), "pieces")
    total = pieces.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    blocks = stored(pieces.groupBy("anchor").agg(F.ceil(F.sum("size") / F.lit(shard_words)).cast("int").alias("blocks")).where("blocks > 1"), "blocks")
    placed = pieces.join(blocks, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    of = F.pmod(F.xxhash64("piece"), F.col("blocks")).cast("int")
    dealt = placed.select("anchor", "piece", "rank", "body", "blocks", of.alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    shard = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("anchor", F.lit(17)), F.lit(shards))).otherwise(F.lit(shards) + F.pmod(F.xxhash64("anchor", "block"), F.lit(2**40)))
    found = dealt.select(shard.alias("shard"), "anchor", "piece", "rank", "body", (F.col("of") == F.col("block")).alias("own")).groupBy("shard").applyInPandas(tidy_groups(_search(window)), FOUND)
    return found.groupBy("anchor", "piece").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _remove(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    for batch in found:
        out = []
        for text, stretches in zip(batch.column("text"), batch.column("stretches").to_pylist()):
            words = words_of(text.as_py())
            n = len(words)
            if stretches:
                gone = np.zeros(n + 1, np.int32)
                np.add.at(gone, [s["a"] for s in stretches], 1)
                np.add.at(gone, [s["b"] for s in stretches], -1)
                stay = np.cumsum(gone[:-1]) == 0
                words = [words[i] for i in np.flatnonzero(stay)]
            kept = " ".join(words)
            out.append({"n_words": n, "n_removed": n - len(words), "kept_sha256": hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), "kept_text": kept})
        rest = [c for c in batch.schema.names if c not in ("text", "stretches")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, kind)], [*rest, "result"])


def stretches(docs: DataFrame, part: Column, text: str = "text", key: str = "doc_id", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, part, stretches): stretches (a, b) of words to remove. part tells rows of one doc_id apart."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), part.alias("part"), F.col(text).alias("text")).where("doc_id is not null")
    every = stored(rows.mapInArrow(tidy(_anchors(window)), ANCHORS), "anchors")
    # stored, as are the other sides of joins, so that both are plain exchanges and a very common key can be split over tasks
    shared = stored(every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "shared")
    held = stored(every.join(shared, "anchor"), "shared-anchors")
    heads = held.groupBy("anchor", "passage", "size").agg(F.min(F.struct("doc_id", "part", "first", "at")).alias("head"), F.max("doc_id").alias("last"), F.max("again").alias("again"))
    wanted = heads.select("head.doc_id", "head.part", F.struct("anchor", "passage", "head.first", "size", "head.at", (F.col("again") | (F.col("last") > F.col("head.doc_id"))).alias("whole")).alias("w"))
    wanted = wanted.groupBy("doc_id", "part").agg(F.collect_list("w").alias("wanted"))
    bodies = stored(rows.join(wanted, ["doc_id", "part"]).mapInArrow(tidy(_cut_passages), BODIES), "bodies")
    # by range of the words themselves; a passage that many documents hold is spread by its hash
    after = bodies.repartitionByRange("anchor", "after", "passage").sortWithinPartitions("anchor", "after", "passage").mapInArrow(tidy(_shared_beginnings("after")), BODIES + ", shared int")
    before = after.withColumnRenamed("shared", "after_shared").repartitionByRange("anchor", "before", "passage").sortWithinPartitions("anchor", "before", "passage")
    both = before.mapInArrow(tidy(_shared_beginnings("before")), BODIES + ", after_shared int, shared int")
    trimmed = stored(both.mapInArrow(tidy(_trimmed(window)), PIECES), "trimmed")
    found = stored(_repeats(trimmed, window, shard_words), "found")
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b"), r["least"].alias("least")))
    verdicts = stored(trimmed.select("anchor", "passage", "piece", "shift").join(found, ["anchor", "piece"]).select("anchor", "passage", moved.alias("runs")), "verdicts")
    later = F.filter("runs", lambda r: r["least"] < F.col("doc_id"))
    mine = F.transform(later, lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b")))
    judged = held.join(verdicts, ["anchor", "passage"]).select("doc_id", "part", mine.alias("s")).where(F.size("s") > 0)
    return judged.groupBy("doc_id", "part").agg(F.flatten(F.collect_list("s")).alias("stretches"))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, into: str = "repeats", shard_words: int = SHARD_WORDS) -> DataFrame:
    """All columns of docs and one more, `into`: n_words, n_removed, kept_sha256, kept_text (kept words, joined by one blank).

    Only a column of docs that is itself called `into` is left out."""
    part = F.xxhash64(text)
    gone = stretches(docs, part, text, key, window, shard_words)
    kept = [c for c in docs.columns if c != into]
    left = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(kept)], F.col(key).alias("key"), part.alias("of"), F.col(text).alias("text"))
    joined = left.join(gone, (F.col("key") == F.col("doc_id")) & (F.col("of") == F.col("part")), "left")
    rows = joined.select(*[f"_{i}" for i in range(len(kept))], "text", "stretches")
    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField("result", RESULT)])
    done = rows.mapInArrow(tidy(_remove), schema)
    return done.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], F.col("result").alias(into))
