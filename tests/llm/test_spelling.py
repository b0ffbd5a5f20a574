"""Spelling variants against a brute-force version: words, near words, forms and roots."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from relslice.llm import queries, spelling

FOLDER = Path("/root/testdata/sf0.001")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (a, b), same in holes.items():
        for w in same:
            near[w] |= same - {w}
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def some_texts(seed, n):
    r = np.random.default_rng(seed)
    words = ["colour", "color", "colours", "colouur", "collour", "colur", "aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "Façade", "facade", "façade", "ÀÈÌÒÙ", "àèìòù", "straße", "strasse", "abcde", "bcdef", "abcdef", "×÷×÷×÷"]
    words += ["".join(map(chr, r.integers(97, 100, r.integers(5, 8)))) for _ in range(300)]
    return [(i, " ".join(r.choice(words, r.integers(1, 60))) + r.choice(["", "Ѐ", "é", ".", "\n1"])) for i in range(n)]


def test_small_texts_in_many_ranges(spark):
    rows = some_texts(1, 400) + [(None, "colour color"), (None, None), (7, ""), (7, "..."), (8, "colour " * 3_000), (9, "x" * 30_000), (10, "x" * 30_000), (11, "x" * 30_000), (12, "x" * 30_001)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("word", "n", "form", "root", "nodes", "id")])
    assert found(spelling.variants(clashing)) == brute(rows)


def test_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "abc")], "doc_id long, text string")).count() == 0


def test_runs_and_hashes():
    texts = ["AbÃÿ-x", "", "y", "теst×", "é"]
    raw = [t.encode() for t in texts]
    words, text = spelling.runs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    assert [w.decode() for w in words.to_pylist()] == ["abÃÿ", "x", "y", "st×", "é"] and text.tolist() == [0, 0, 2, 3, 4]
    a, b = [b"12:", b"", b"9" * 70], [b"word", b"\xc3\xa9" * 30, b"q"]
    crc = lambda parts: np.array([zlib.crc32(x) for x in parts], np.uint32)
    assert spelling.crc_joined(crc(a), crc(b), np.array(list(map(len, b)))).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_numbers_of_nodes_over_ranges(spark):
    """A node has one number, however many ranges its words are in."""
    words = sorted({"".join(map(chr, np.random.default_rng(i).integers(97, 99, 9))) for i in range(300)})
    known = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for backwards in (False, True):
            number, rows = {}, spelling.trie(known, backwards).collect()
            for r in rows:
                turned = r.word[::-1] if backwards else r.word
                for depth, node in enumerate(r.nodes):
                    assert number.setdefault(turned[:depth], node) == node
            assert len(set(number.values())) == len(number)
            assert [r.word for r in sorted(rows, key=lambda r: r.id)] == sorted(words, key=lambda w: w[::-1] if backwards else w)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.skipif(not FOLDER.is_dir(), reason="the given tables are not here")
def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_spelling(spark, str(FOLDER))) == brute(rows)
