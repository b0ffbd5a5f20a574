"""Encoding, decoding, token files, packing and chat: exact round trips against the libraries."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relslice.llm import bpe_codec, chat, common, packing, queries, token_file, tokens
from relslice.llm.tokens import encoder

FOLDER = Path("/root/testdata/sf0.001")
RANKS, BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " ", "a", "  two  blanks ", "tab\tand\nbreak\n\nend\n", "I'm don't 'S they're x'", "é É́ ﬁ ß Σίσυφος", "①2③ x①", "<|endoftext|> <s>", "\x1cfs\x1f", "a\0b", "word " * 400, "x" * 3000, "漢字かな交じり", "🙂 👩‍👩‍👧"]
DOCS = "doc_id long, text string, piece string, tokens int"


def docs(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [20, 600, 32_768])
def test_round_trip_by_chunks(spark, reference, chunk):
    got = {r.doc_id: r for r in bpe_codec.round_trip(docs(spark), RANKS, chunk=chunk).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        ids = reference.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_columns_with_clashing_names_do_no_harm(spark):
    names = ("row_key", "piece", "body", "chunk", "ids", "n_tokens", "start", "length", "sequence_id", "range", "segment")
    df = docs(spark).select("doc_id", "text", *[F.lit(f"own {n}").alias(n) for n in names])
    assert bpe_codec.round_trip(df, RANKS, chunk=50).count() == len(ODD)
    assert token_file.read_tokens(token_file.write_tokens(df, BYTES)).count() == len(ODD)
    assert packing.pack_documents(df, WORDS).select("doc_id").distinct().count() == len(ODD)


def test_round_trip_of_repeated_ids_and_no_rows(spark):
    same = spark.createDataFrame([(1, "ab " * 400), (1, "cd " * 300), (None, "x")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bpe_codec.round_trip(same, RANKS, chunk=100).collect())[-1] > 300
    assert bpe_codec.round_trip(same, RANKS, chunk=100).count() == 3
    assert bpe_codec.round_trip(same.limit(0), RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab E.,'s\n\t é①1&%Σ́")), max_size=40), min_size=1, max_size=6))
@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_encode_like_whole_texts(path, texts):
    one, each = encoder(path), library(path)
    ids, lengths = one.encode(texts, 7)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*each(t), 7] for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_forgotten_pieces_come_back_the_same(path, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 6)
    one, each = tokens.PieceEncoder(path), library(path)
    for texts in (["the cat sat on the mat", "x" * 90 + " y"], ["the dog\nsat", None, "a  b"], ["on the mat the cat", ""]):
        ids, lengths = one.encode(texts, 3)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [[*each(t), 3] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=900), st.booleans())
def test_segments_decode_to_their_ids(ids, spiked):
    ids = np.array([i % 40 if spiked and k % 50 else i for k, i in enumerate(ids)], np.uint32)
    lengths = np.array([len(ids) // 2, len(ids) - len(ids) // 2])
    body = token_file.encode_ids(ids, np.array([3, 9]), lengths)
    got = token_file.decode_ids(body)
    assert got[0].tolist() == ids.tolist() and got[1].tolist() == [3, 9] and got[2].tolist() == lengths.tolist()
    blocks = -(-len(ids) // token_file.BLOCK)
    assert [i for b in range(blocks) for i in token_file.read_block(body, b).tolist()] == ids.tolist()
    with pytest.raises(IndexError):
        token_file.read_block(body, blocks)


def test_segments_are_smaller_than_their_ids():
    ids = np.random.default_rng(1).integers(0, 4000, 50_000)
    assert len(token_file.encode_ids(ids, np.array([1]), np.array([50_000]))) < 50_000 * 2


def test_token_file(spark, monkeypatch):
    monkeypatch.setattr(token_file, "SEGMENT", 300)
    got = {r.doc_id: r for r in token_file.read_tokens(token_file.write_tokens(docs(spark), BYTES)).collect()}
    each, at = library(BYTES), 0
    for i, text in enumerate(ODD):
        ids = each(text) + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_file.read_tokens(token_file.write_tokens(docs(spark).limit(0), BYTES)).count() == 0
    ties = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "doc_id long, text string")
    assert [r.start for r in token_file.read_tokens(token_file.write_tokens(ties, BYTES)).orderBy(F.col("start")).collect()] == [0, 2, 4]


def test_token_file_of_extreme_far_null_and_repeated_ids(spark):
    rows = [(-(2**63) + 5, "low"), (2**63 - 5, "high"), (2**60, "far off"), *[(i, f"text {i}") for i in range(3_000)], *[(None, "same")] * 1_500, *[(7, "again and again")] * 1_500]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        segments = token_file.write_tokens(df, BYTES)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spread = [r.n for r in segments.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()]
    assert max(spread) < 0.5 * sum(spread)
    got = token_file.read_tokens(segments).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


@pytest.mark.skipif(not FOLDER.is_dir(), reason="the given tables are not here")
def test_token_queries_over_whole_tables(spark, reference):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    seven, each, at = {r.doc_id: r for r in queries.op7_token_file(spark, str(FOLDER)).collect()}, library(BYTES), 0
    for i in sorted(rows):
        ids = [*each(rows[i]), 0]
        assert (seven[i].start, seven[i].n_tokens, seven[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    nine, each = {(r.doc_id, r.piece): r for r in queries.op9_packing(spark, str(FOLDER)).collect()}, library(WORDS)
    cut = {(i, at // 4096): ids[at : at + 4096] for i, text in rows.items() for ids in [[*each(text), 1]] for at in range(0, len(ids), 4096)}
    assert {k: (r.start, r.length, r.ids_crc32) for k, r in nine.items()} == {(i, k): (k * 4096, len(ids), crc(ids)) for (i, k), ids in cut.items()}
    assert len({r.sequence_id for r in nine.values()}) <= math.ceil(sum(map(len, cut.values())) / 4096) + 1
    two = {r.doc_id: r for r in queries.op2_bpe_round_trip(spark, str(FOLDER)).collect()}
    for i, text in rows.items():
        ids = np.array(reference.encode_ordinary(text), "<u4")
        assert (two[i].n_tokens, two[i].ids_sha256, two[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_packing(spark):
    got = packing.pack_documents(docs(spark), WORDS, capacity=64).collect()
    each = library(WORDS)
    want = {}
    for i, text in enumerate(ODD):
        ids = each(text) + [1]
        for at in range(0, len(ids), 64):
            want[i, at // 64] = (at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == math.ceil(sum(r.length for r in got) / 64)
    assert packing.pack_documents(docs(spark).limit(0), WORDS).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_local_search_never_loses_a_piece_or_adds_a_bin(lengths):
    sizes = np.array(lengths)
    first = packing.in_order(sizes, 100)
    bins = packing.Search(sizes, first, 100).run()
    fills = np.bincount(bins, weights=sizes)
    assert fills.sum() == sizes.sum() and fills.max() <= 100 and (fills**2).sum() >= (np.bincount(first, weights=sizes) ** 2).sum()
    assert math.ceil(sum(lengths) / 100) <= len(set(bins.tolist())) <= len(set(first.tolist()))


def test_local_search_empties_a_bin_by_exchanges():
    sizes = np.array([6, 3, 5, 4, 2])  # 6 3 | 5 4 | 2 fits into two bins of 10 by exchanging 3 and 4
    assert len(set(packing.Search(sizes, np.array([0, 0, 1, 1, 2]), 10).run().tolist())) == 2


def test_swaps_lower_the_number_of_bins_of_a_table(spark):
    lengths = np.random.default_rng(2).permutation(np.repeat([2900, 1196, 2500, 1596, 800], 300))
    pieces = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], packing.PIECES)
    start = len(set(packing.in_order(lengths, 4096).tolist()))
    rows = packing.pack_pieces(pieces.coalesce(1)).collect()
    by = {r.doc_id: r.sequence_id for r in rows}
    assert len(set(by.values())) < start - 5
    search = packing.Search(lengths, packing.in_order(lengths, 4096), 4096)
    search.run()
    assert search.steps["one for one"] > 10


def test_equal_rows_are_spread_over_groups(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 100, 5)] * 4_000, packing.PIECES).repartition(4)
    rows = packing.pack_pieces(pieces, group=1_000).collect()
    groups = [r.sequence_id >> 32 for r in rows]
    assert len(rows) == 4_000 and len(set(groups)) == 4 and max(map(groups.count, set(groups))) < 1_500


PARTS = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:int>>"


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_escape_is_reversible(text):
    held = chat.escape(text)
    assert chat.unescape(held) == text
    assert chat.TURN.findall(f"<s>user[INST]{held}[/INST]</s>") == [("user", held)]


def test_chat_flattens_typed_parts(spark):
    parts = [("text", "see [IMAGE 0] <s>", None, None), ("image", None, "a.png", 256), ("audio", "x", "b.wav", 40), ("document", None, "c.pdf", None), (None, "end", None, None), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (2, 0, None, [("text", None, None, 3)])], PARTS)
    first, second, third = chat.format_turns(df).orderBy("conv_id", "turn").collect()
    assert first.formatted == "<s>user[INST]see \\[IMAGE 0] \\<s>[IMAGE 0][AUDIO 1][DOCUMENT 2]end[/INST]</s>"
    assert first.expanded_tokens == 296 and [(a.place, a.type, a.ref, a.tokens) for a in first.attachments] == [(0, "image", "a.png", 256), (1, "audio", "b.wav", 40), (2, "document", "c.pdf", 0)]
    assert first.loss_start == first.loss_end and second.loss_start == second.loss_end and third.formatted == "<s>[INST][/INST]</s>"


def test_chat_parts_read_back(spark):
    parts = [("text", "see [IMAGE 0] \\ <s>", None, None), ("image", None, "a.png", 256), ("audio", None, "b.wav", 40), ("text", "end", None, None)]
    rows = [(1, 0, "user", parts), (2, 0, "user", [("text", "[IMAGE 0]", None, None)]), (3, 0, "user", [("image", None, "a.png", 256)]), (4, 0, "user", [("image", None, "c.png", 256)]), (5, 0, "assistant", [("text", "one", None, None), ("image", None, "a", 1), ("text", " two", None, None)])]
    formatted = chat.format_turns(spark.createDataFrame(rows, PARTS))
    one = formatted.where("conv_id = 1").first()
    role, back = chat.parse_turn(one.formatted, [a.asDict() for a in one.attachments])
    assert role == "user" and [(p["type"], p["text"], p["ref"], p["tokens"]) for p in back] == parts
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert len({got[i].turns_sha256 for i in (2, 3, 4)}) == 3
    assert got[5].loss_chars == 7 and got[5].loss_sha256 == hashlib.sha256(b"one two").hexdigest()


def test_chat_reads_back(spark):
    said = "</s>[INST] ok [/INST]\\"
    turns = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, "assistant", None), (None, 0, "user", "x"), (1, 1, "assistant", "é")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df.withColumn("parts", chat.text_parts("text")))).collect()}
    assert got[1].n_turns == 3 and got[2].loss_chars == 0 and got[None].n_turns == 1
    assert got[1].loss_sha256 == hashlib.sha256((said + "é").encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\nassistant\né\n".encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0).withColumn("parts", chat.text_parts("text")))).count() == 0


def test_bound_on_bins_holds_and_stops_searches_that_cannot_gain():
    def optimum(sizes, capacity):
        best = len(sizes)

        def place(i, fills):
            nonlocal best
            if len(fills) >= best:
                return
            if i == len(sizes):
                best = len(fills)
                return
            for k in range(len(fills)):
                if fills[k] + sizes[i] <= capacity:
                    place(i + 1, fills[:k] + [fills[k] + sizes[i]] + fills[k + 1 :])
            place(i + 1, [*fills, sizes[i]])

        place(0, [])
        return best

    r = np.random.default_rng(5)
    for _ in range(150):
        capacity = int(r.integers(4, 30))
        sizes = r.integers(1, capacity + 1, int(r.integers(1, 9)))
        least = packing.least_bins(sizes, capacity)
        bins = packing.pack(sizes, capacity)
        assert least <= optimum(sizes.tolist(), capacity) <= len(set(bins.tolist())) and np.bincount(bins, weights=sizes).max() <= capacity
    for sizes, n in ((np.full(16_000, 50), 198), (r.integers(1_400, 2_001, 16_000), 8_000)):
        search = packing.Search(sizes, packing.in_order(sizes, 4096), 4096)
        assert len(set(search.run().tolist())) == search.least == n and not any(search.steps.values())


def test_packing_encodes_few_texts_at_a_time(monkeypatch):
    class Seen:
        sizes: list[int] = []

        def encode(self, texts, end):
            self.sizes.append(sum(map(len, texts)))
            return np.ones(len(texts), np.uint16), np.ones(len(texts), np.int64)

    monkeypatch.setattr(packing, "encoder", lambda path: Seen())
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(["x" * 20_000] * 100)], ["doc_id", "text"])
    assert sum(b.num_rows for b in packing._cut("", 1, 4096)(iter([batch]))) == 100 and max(Seen.sizes) <= 320_000


def test_work_without_a_tokenizer_gives_up_those_of_earlier_work():
    """A worker that Spark uses again for another stage does not keep the pieces that packing has remembered."""
    path = queries.vocabulary("word_bpe_49k.json")
    batch = pa.record_batch({"doc_id": [1], "text": ["some words"]})
    assert len(list(packing._cut(path, 1, 4096)(iter([batch])))) == 1 and encoder.cache_info().currsize
    assert [b.num_rows for b in common.tidy(lambda found: found)(iter([batch]))] == [1] and not encoder.cache_info().currsize
    encoder(path)
    assert len(common.tidy_groups(lambda rows: rows)(batch.to_pandas())) == 1 and not encoder.cache_info().currsize
