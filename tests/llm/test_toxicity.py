"""Toxicity by compression distance: windows and lengths by hand, held-out accuracy, odd rows."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from relslice.llm import queries, toxicity

FOLDER = Path("/root/testdata/sf0.1")


def texts(n, seed=1):
    r = np.random.default_rng(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    bad = ["grumblefish", "Snorkwit", "plonkhead"]
    out = []
    for i in range(n):
        words = ["".join(r.choice(parts, r.integers(1, 4))) for _ in range(r.integers(20, 120))]
        toxic = bool(r.random() < 0.2)
        for _ in range(3 * toxic):
            words[r.integers(len(words))] = str(r.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_windows_cover_the_text():
    for text in (b"", b"a b", b"x" * 200, b"word and " * 50, b" " * 130):
        cut = toxicity.windows(text)
        assert b"".join(cut) == text and all(len(w) <= toxicity.WINDOW for w in cut) and len(cut) >= 1


def test_lengths_show_matches_and_nothing_else():
    d = toxicity.Distance(b"grumblefish", b"ordinary words")
    plain = d.measures("qzjxk vbpwm")
    assert plain[:15] == [0.0] * 15 and plain[-4] == 0
    assert d.measures("qz grumblefish")[0] == 1.0 and d.measures("QZ GRUMBLEFISH")[0] == 1.0
    assert d.measures("qzjxk qzjxk qzjxk qzjxk qzjxk")[0] == 0.0  # repeats within a window
    assert d.measures("so ordinary words")[0] == 0.0 and d.measures("so ordinary words")[-1] > 0


def test_stretches_against_a_plain_search():
    raw, marks = b"xx grumblefish yy grumble", {b"grumbl", b"rumble", b"umblef"}
    numbers = np.sort(np.array([toxicity.grams(m)[0] for m in marks]))
    assert toxicity.stretches(raw, numbers) == [b"grumblef", b"grumble"]
    assert toxicity.stretches(b"abc", numbers) == [] and toxicity.stretches(raw, numbers[:0]) == []


def test_held_out_texts_and_odd_rows(spark):
    rows = texts(1_500)
    odd = [(None, "grumblefish Snorkwit plonkhead"), (5_000, None), (5_001, ""), (5_002, "grumblefish " + "the and " * 30_000), (5_003, "x" * 5_000)] * 2
    docs = spark.createDataFrame([r[:2] for r in rows] + odd, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "label", "of", "fold", "h", "toxic")})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (9_999, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    label = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and sum(r.predicted == label[r.doc_id] for r in held) >= 0.97 * len(held)
    assert [r.predicted for r in got if r.doc_id is None] == [1, 1] and not any(r.held_out for r in got if r.doc_id is None)
    # labels of held-out rows change nothing, nor does the partitioning
    key = lambda r: (str(r.doc_id), r.score)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(key, got)) == sorted(map(key, toxicity.score(docs.repartition(7), other.repartition(3)).collect()))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), none).count() == 0
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, ones).collect()} <= {0.0, 1.0}


@pytest.mark.skipif(not FOLDER.is_dir(), reason="the given tables are not here")
def test_held_out_rows_of_the_table(spark):
    got = queries.op12_toxicity(spark, str(FOLDER)).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out and toxic is not null").select("predicted", "toxic").collect()
    right = sum(r.predicted and r.toxic for r in got)
    assert right >= 0.85 * sum(r.toxic for r in got) and right >= 0.85 * sum(r.predicted for r in got)
