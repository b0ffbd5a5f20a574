"""Token ids in blocks of patched frame-of-reference code.

A segment holds the ids of neighbouring documents. Ids are cut into blocks of BLOCK. From each block its smallest id is
subtracted; the differences are packed at the width that SHARE of them need, one bit plane after the other, and those that
need more go to an exception list. A segment starts with its counts and an index of where each block's bits and exceptions
start, so that any block can be read alone (read_block), and a table of its documents.

Documents are dealt to tasks by ranges of (doc_id, hash of the text), so that repeated, null and far-off ids are spread as any
others; each task writes its segments. Segments are rows of a Parquet table (range, segment, n_ids, body) that Spark writes and
reads, so the store may be any that Spark knows. Ranges follow doc_id; within a range, segments do. A document is never split.

Nulls: a null text counts as empty and has only the end id. Rows that share a doc_id follow each other by a hash of the text;
rows with a null doc_id come first. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import batches, encoder

BLOCK = 256
SHARE = 0.9
SEGMENT = 500_000
NO_ID = -(2**63)  # stands for a null doc_id inside a segment
MAGIC = 0x31524650  # "PFR1"
SEGMENTS = "range long, segment int, n_ids long, body binary"
ENTRIES = "range long, segment int, doc_id long, at long, n_tokens long, ids_crc32 long"


def encode_ids(ids: np.ndarray, doc_ids: np.ndarray, doc_lengths: np.ndarray) -> bytes:
    """One segment of ids and its documents."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    table = np.zeros(blocks * BLOCK, np.uint32)
    table[:n] = ids
    if n:
        table[n:] = ids[-1]
    table = table.reshape(blocks, BLOCK)
    base = table.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = table - base[:, None]
    limit = np.partition(rest, int(BLOCK * SHARE) - 1, axis=1)[:, int(BLOCK * SHARE) - 1] if blocks else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.uint8)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))]).astype(np.uint32)
    packed = np.zeros(int(starts[-1]), np.uint8)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            low = rest[rows]
            planes = np.stack([np.packbits((low >> np.uint32(j) & np.uint32(1)).astype(np.uint8), axis=1) for j in range(w)], axis=1)
            packed[starts[rows][:, None].astype(np.int64) + np.arange(int(w) * BLOCK // 8)] = planes.reshape(len(rows), -1)
    where_block, where_at = np.nonzero(over)
    patches = np.concatenate([[0], np.cumsum(np.bincount(where_block, minlength=blocks))]).astype(np.uint32)
    head = np.array([MAGIC, n, blocks, len(doc_ids), len(packed), len(where_at)], "<u4")
    parts = [head, base.astype("<u4"), width, starts.astype("<u4"), patches.astype("<u4"), packed, where_at.astype(np.uint8), rest[over].astype("<u4"), doc_ids.astype("<i8"), doc_lengths.astype("<u4")]
    return b"".join(p.tobytes() for p in parts)


class Segment:
    """The parts of a segment's body, as arrays over it."""

    def __init__(self, body: bytes):
        magic, self.n, self.blocks, docs, size, outliers = np.frombuffer(body, "<u4", 6).tolist()
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        self.base, self.width, self.starts, self.patches = take("<u4", self.blocks), take("u1", self.blocks), take("<u4", self.blocks + 1), take("<u4", self.blocks + 1)
        self.packed, self.where, self.values = take("u1", size), take("u1", outliers), take("<u4", outliers)
        self.doc_ids, self.doc_lengths = take("<i8", docs), take("<u4", docs)


def _planes(packed: np.ndarray, width: int) -> np.ndarray:
    """rows x BLOCK numbers from rows of bit planes."""
    total = np.zeros((len(packed), BLOCK), np.uint32)
    for j in range(width):
        total |= np.unpackbits(packed[:, j * BLOCK // 8 : (j + 1) * BLOCK // 8], axis=1).astype(np.uint32) << np.uint32(j)
    return total


def decode_ids(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, doc_lengths) of a segment."""
    s = Segment(body)
    rest = np.zeros((s.blocks, BLOCK), np.uint32)
    for w in np.unique(s.width):
        if w:
            rows = np.flatnonzero(s.width == w)
            rest[rows] = _planes(s.packed[s.starts[rows][:, None].astype(np.int64) + np.arange(int(w) * BLOCK // 8)], int(w))
    rest[np.repeat(np.arange(s.blocks), np.diff(s.patches.astype(np.int64))), s.where] = s.values
    return (rest + s.base[:, None]).reshape(-1)[: s.n], s.doc_ids, s.doc_lengths


def read_block(body: bytes, number: int) -> np.ndarray:
    """The ids of one block, from its own bits and exceptions alone."""
    s = Segment(body)
    if not 0 <= number < s.blocks:
        raise IndexError(f"block {number} of {s.blocks}")
    ids = _planes(s.packed[None, s.starts[number] : s.starts[number + 1]], int(s.width[number]))[0]
    mine = slice(s.patches[number], s.patches[number + 1])
    ids[s.where[mine]] = s.values[mine]
    return (ids + s.base[number])[: s.n - number * BLOCK]


def _write(path: str, end: int):
    """Rows come sorted; a segment ends with its task or after SEGMENT ids."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number, size = encoder(path), 0, 0
        ids, docs, lengths = [], [], []
        task = TaskContext.get()
        now = task.partitionId() if task else 0

        def segment() -> pa.RecordBatch:
            body = encode_ids(np.concatenate(ids), np.array(docs, np.int64), np.concatenate(lengths))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([body], pa.binary())], ["range", "segment", "n_ids", "body"])

        for batch in found:
            keys = [NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            at = 0
            for part in batches(batch.column("text").to_pylist()):
                more, each = encode.encode(part, end)
                ids.append(more)
                lengths.append(each)
                docs += keys[at : at + len(part)]
                at, size = at + len(part), size + len(more)
                if size >= SEGMENT:
                    yield segment()
                    number, size, ids, docs, lengths = number + 1, 0, [], [], []
        if docs:
            yield segment()

    return run


def _read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        for row_range, number, body in zip(batch.column("range").to_pylist(), batch.column("segment").to_pylist(), batch.column("body")):
            ids, docs, lengths = decode_ids(body.as_py())
            ends = np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths
            wide = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(wide[a:b]) for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
            k = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, row_range, np.int64)), pa.array(np.full(k, number, np.int32)), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                ["range", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, path: str, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode whole texts, append the end id to each, and store them as segments in rising order of key."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    order = ["doc_id", "h", "row"]  # row spreads equal rows
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(dealt.mapInArrow(_write(path, end), SEGMENTS), "token-segments")


def read_tokens(segments: DataFrame) -> DataFrame:
    """Per document, read from the stored segments: doc_id, start (ids before it), n_tokens, ids_crc32."""
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("range").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # one row per task that wrote goes through the window without partitions
    ranges = segments.groupBy("range").agg(F.sum("n_ids").alias("n")).select("range", F.coalesce(F.sum("n").over(before), zero).alias("range_start"))
    offsets = segments.select("range", "segment", F.coalesce(F.sum("n_ids").over(inside), zero).alias("segment_start")).join(ranges, "range")
    entries = segments.select("range", "segment", "body").mapInArrow(_read, ENTRIES)
    start = (F.col("range_start") + F.col("segment_start") + F.col("at")).alias("start")
    return entries.join(offsets, ["range", "segment"]).select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), start, "n_tokens", "ids_crc32")
