"""The Merkle manifest against trees built in memory, and against its SQL."""

from __future__ import annotations

import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from relslice.llm import merkle, queries

FOLDER = Path("/root/testdata/sf0.001")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])

    def path(i):
        return [(row[i >> k ^ 1], i >> k & 1) if i >> k ^ 1 < len(row) else None for k, row in enumerate(levels[:-1])]

    return levels[-1][0], path


def brute(rows):
    def leaf(r, more=0):
        values = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    trees = {}
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        ordered = sorted(by[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[lang] = (ordered, *tree([leaf(r) for r in ordered]))
    root, upper = tree([t[1] for t in trees.values()])
    out = []
    for k, (ordered, subroot, path) in enumerate(trees.values()):
        for i, r in enumerate(ordered):
            steps, folded = path(i) + upper(k), leaf(r, int(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0))
            for s in steps:
                folded = digest(folded if s is None else s[0] + folded if s[1] else folded + s[0])
            out.append((r.doc_id, leaf(r), subroot, root, digest("".join(s[0] for s in steps if s)), folded, folded == root))
    return out


def same(a, b):
    return sorted(map(str, map(tuple, a))) == sorted(map(str, map(tuple, b)))


ODD = [(None, "s", "en", 1, "a")] * 2 + [(5, None, None, None, None), (5, "x", None, 3, "é"), (7, "x", "", 3, "z" * 200_000), (2**62, "x", "zz", 2**63 - 1, "q")]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_odd_rows_and_several_levels_of_superblocks(spark, height):
    rows = ODD + [(9, "c", "en", 4, "copy")] * 20 + [(i, "d", "de", i, f"text {i}") for i in range(37)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("pos", "tree", "n", "node", "level", "block", "leaf", "row")])
    assert same(merkle.manifest(clashing, height).collect(), brute(df.collect()))


def test_one_row_and_no_row(spark):
    df = spark.createDataFrame(ODD[3:4], "doc_id long, source string, lang string, n_chars long, text string")
    (got,) = merkle.manifest(df).collect()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == digest("")
    assert merkle.manifest(df.limit(0)).count() == 0


@pytest.mark.skipif(not FOLDER.is_dir(), reason="the given tables are not here")
def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = queries.op11_merkle(spark, str(FOLDER))
    rows = con.execute(queries.OP11_SQL)
    assert [c[0] for c in rows.description] == got.columns
    assert same(got.collect(), rows.fetchall())
