"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

A text is cut, in one pass over it, into chunks of CHUNK characters that overlap; most texts are one chunk and so one piece.
Each chunk of a longer one is pre-tokenised by itself, in parallel; where a chunk and the next one share a boundary inside
their overlap, both go on alike, so the text may be cut there. The pieces between such cuts are encoded in parallel and their
ids stream into one digest per text. If two chunks share no boundary (one pre-token longer than the overlap), the rest of that
text stays one piece.

Longer texts are stored with a number for their row first, so that all later steps, and tasks that run again, see the same
numbers. Nulls: a null text counts as empty (0 ids). Rows are kept apart even if doc_id repeats or is null. Other columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CHUNK = 16_384
OVERLAP = 512
CHUNKS = "row_key long, chunk int, chunks int, body string"
PIECES = "row_key long, doc_id long, piece int, body string"
FOUND = "row_key long, chunk int, head array<int>, tail array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def codec(path: str):
    """(encode, table of raw bytes by id) for a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, {rank: token for token, rank in ranks.items()}


def decode(ids: list[int], path: str) -> bytes:
    """The raw bytes of the ids, one after the other."""
    return b"".join(map(codec(path)[1].__getitem__, ids))


def boundaries(text: str, last: bool) -> list[int]:
    """Where pre-tokens of text end. Unless the text is a last chunk, those that more text could move are left out."""
    import public_tokenizers
    import regex

    ends = [m.end() for m in regex.compile(public_tokenizers.PATTERN).finditer(text)]
    n = len(text)
    starts = [0, *ends[:-1]]
    return ends if last else [b for a, b in zip(starts, ends) if b < n and a + 3 <= n]


def _bounds(chunk: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = batch.to_pydict()
            heads, tails = [], []
            for k, n, body in zip(rows["chunk"], rows["chunks"], rows["body"]):
                at = k * chunk
                cuts = [at + b for b in boundaries(body, k == n - 1)]
                heads.append([b for b in cuts if b <= at + OVERLAP])
                tails.append([b for b in cuts if b >= at + chunk])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("chunk"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                ["row_key", "chunk", "head", "tail"],
            )

    return run


def _chunks(chunk: int):
    """The overlapping chunks of each text."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for key, text in zip(batch.column("row_key").to_pylist(), batch.column("body")):
                body = text.as_py()
                n = -(-len(body) // chunk)
                parts = [body[k * chunk : (k + 1) * chunk + OVERLAP] for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(parts, pa.string())], ["row_key", "chunk", "chunks", "body"])

    return run


def _split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each text between its cuts."""
    for batch in found:
        for key, doc_id, text, cuts in zip(batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("body"), batch.column("cuts").to_pylist()):
            body, n = text.as_py(), len(cuts)
            parts = [body[a:b] for a, b in zip(cuts, [*cuts[1:], len(body)])]
            yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], ["row_key", "doc_id", "piece", "body"])


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """(row_key, key, piece, body): the pieces of texts longer than chunk, cut where pre-token boundaries resynchronise."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))
    longer = stored(rows.where(F.length("body") > chunk), "long-texts", compression="zstd")
    found = longer.select("row_key", "body").mapInArrow(_chunks(chunk), CHUNKS).repartition("row_key", "chunk").mapInArrow(_bounds(chunk), FOUND)
    order = Window.partitionBy("row_key").orderBy("chunk")
    cut = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head"))))
    cuts = (
        found.withColumn("cut", cut)
        .withColumn("good", F.min(F.col("cut").isNotNull().cast("int")).over(order))
        .where("good = 1")
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    )
    return longer.join(cuts, "row_key").select("row_key", "doc_id", "body", "cuts").mapInArrow(_split, PIECES)


def _narrow(ids: bytes) -> bytes:
    """32-bit ids in 16 bits each, if all of them fit, after a byte that says how wide they are."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids


def _widened(ids: bytes) -> bytes:
    return ids[1:] if ids[0] == 4 else np.frombuffer(ids, "<u2", offset=1).astype("<u4").tobytes()


def _encode(path: str, narrow: bool = False):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = codec(path)
        for batch in found:
            for row in batch.to_pylist():
                ids = np.array(encode(row["body"]), "<u4").tobytes()
                ids = _narrow(ids) if narrow else ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["row_key"]], pa.int64()), pa.array([row["doc_id"]], pa.int64()), pa.array([row["piece"]], pa.int32()), pa.array([ids], pa.binary())],
                    ["row_key", "doc_id", "piece", "ids"],
                )

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _digest_pieces(path: str):
    """Rows come sorted by (row_key, piece); one text's digests are carried over its pieces."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, n, ids_hash, raw_hash = None, None, 0, None, None
        for batch in found:
            done = []
            for key, doc_id, raw in zip(batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if key != now:
                    if now is not None:
                        done.append((doc, n, ids_hash.hexdigest(), raw_hash.hexdigest()))
                    now, doc, n, ids_hash, raw_hash = key, doc_id, 0, hashlib.sha256(), hashlib.sha256()
                ids = _widened(raw.as_py())
                ids_hash.update(ids)
                listed = np.frombuffer(ids, "<u4").tolist()
                raw_hash.update(decode(listed, path))
                n += len(listed)
            if done:
                yield _rows(done)
        if now is not None:
            yield _rows([(doc, n, ids_hash.hexdigest(), raw_hash.hexdigest())])

    return run


def _digest_texts(path: str):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = codec(path)
        for batch in found:
            done = []
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                ids = encode(body or "")
                done.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()))
            if done:
                yield _rows(done)

    return run


def encode_texts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """(row_key, doc_id, piece, ids): little-endian 32-bit ids of every piece of every text, in parallel."""
    short = docs.where(F.coalesce(F.length(text), F.lit(0)) <= chunk).select(
        (-F.monotonically_increasing_id() - 1).alias("row_key"), F.col(key).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.coalesce(F.col(text), F.lit("")).alias("body")
    )
    both = short.unionByName(pieces(docs, text, key, chunk).repartition("row_key", "piece"))
    return both.mapInArrow(_encode(path), "row_key long, doc_id long, piece int, ids binary")


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 of its whole text's ids and of the bytes decoded from them."""
    short = docs.where(F.coalesce(F.length(text), F.lit(0)) <= chunk).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))
    ids = pieces(docs, text, key, chunk).repartition("row_key", "piece").mapInArrow(_encode(path, narrow=True), "row_key long, doc_id long, piece int, ids binary")
    whole = ids.repartition("row_key").sortWithinPartitions("row_key", "piece").mapInArrow(_digest_pieces(path), DIGESTS)
    return short.mapInArrow(_digest_texts(path), DIGESTS).unionByName(whole)
