"""Merkle trees over documents: one tree per language, and one over the roots of the languages.

A leaf is the digest of a row's fields. The leaves of a tree are numbered in order, and every 2 ** HEIGHT of them form a
superblock. Superblocks are reduced to one node each, level by level of superblocks, until a tree has one node. On the way
down, the nodes of each superblock are cogrouped with the outer nodes that their proofs need: one call finishes the reduction
inside the superblock, joins inner and outer siblings into proofs and folds leaves up to the root. What goes between the levels
is one row per outer node and superblock, so no task sees more than a superblock and one path.

Texts are hashed where they are read; only digests are shuffled. Leaves are numbered by ranges of (language, doc_id, leaf), so that
a language with a third of all rows, null and repeated doc_ids are spread.

Nulls: a null field is hashed as `-`; null languages form a tree of their own, the first; rows with a null doc_id come first and are
not tampered with. Rows that share a doc_id are ordered by their leaves; equal rows are leaves of their own. No rows: no result.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ONE = ""  # the tree over the roots of languages
BEYOND = 10_000  # levels over the roots of languages are numbered from here
NODES = "tree string, pos long, n long, node string"
#: What an outer node is to the nodes of its superblock; SIBLING has its side, ALONE stands for a level without sibling.
SIBLING, ALONE, SUBROOT, ROOT = "sibling", "alone", "subroot", "root"
OUTER = "tree string, block long, level int, what string, node string, left boolean"
OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, lang: str = "lang", key: str = "doc_id", count: str = "n_chars", divisor: int = 7) -> DataFrame:
    """(tree, doc_id, leaf, tampered): tampered is the leaf with one added to n_chars where divisor divides the crc32 of the
    doc_id and n_chars is not null, else null."""
    def leaf(changed: Column) -> Column:
        return F.sha2(F.concat(*[encoded(changed if c == count else F.col(c)) for c in FIELDS]), 256)

    more = (F.col(count).cast("decimal(20,0)") + 1).cast("string")
    hit = (F.crc32(F.col(key).cast("string")) % divisor == 0) & F.col(count).isNotNull()
    tree = F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(ONE))
    return docs.select(tree.alias("tree"), F.col(key).cast("long").alias("doc_id"), leaf(F.col(count)).alias("leaf"), F.when(hit, leaf(more)).alias("tampered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos (from 0 within their tree, by order) and n (rows of the tree). order has to start with tree."""
    at = F.monotonically_increasing_id()  # the task's number and the place of the row in it
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at), "ranged")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    parts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that wrote
    offsets = parts.select("tree", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return ranged.join(offsets, ["tree", "part"]).select(*[c for c in rows.columns], (F.col("at") + F.col("shift")).alias("pos"), "n")


def levels_of(n: int) -> int:
    """How often n nodes are halved until one is left."""
    return max(0, n - 1).bit_length()


def reduce_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock and of each level over them, in runs of two; a run of one is hashed alone."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return out


def _tops(height: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        n = int(group["n"].iloc[0])
        top = reduce_levels(group["node"].tolist(), min(height, levels_of(n)))[-1][0]
        return pd.DataFrame({"tree": [group["tree"].iloc[0]], "pos": [int(group["pos"].iloc[0]) >> height], "n": [-(-n >> height)], "node": [top]})

    return run


def climb(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each level of superblocks, lowest first; the one node of every tree with `top`, the level of its last superblock)."""
    levels, tops = [nodes], None
    while True:
        blocks = levels[-1].select("tree", "pos", "n", "node", F.shiftright("pos", height).alias("block")).groupBy("tree", "block")
        up = stored(blocks.applyInPandas(_tops(height), NODES), "tops")
        done = up.where("n = 1").withColumn("top", F.lit(len(levels) - 1))
        tops = done if tops is None else tops.union(done)
        rest = up.where("n > 1")
        if rest.isEmpty():
            return levels, tops
        levels.append(rest)


def _inner(pos: list[int], nodes: list[str], n: int, height: int) -> list[list[tuple[str, bool] | None]]:
    """Per node of a superblock its siblings inside, level by level: (node, stands left), None for none."""
    levels = reduce_levels(nodes, min(height, levels_of(n)))[:-1]
    paths: list[list[tuple[str, bool] | None]] = [[] for _ in pos]
    for up, row in enumerate(levels):
        for i in range(len(pos)):
            j = i >> up ^ 1
            paths[i].append((row[j], bool(i >> up & 1)) if j < len(row) else None)
    return paths


def _split(outer: pd.DataFrame) -> tuple[list[tuple[str, bool] | None], dict[str, str]]:
    """The outer path in order, and the named nodes (subroot, root)."""
    path = outer[outer["what"].isin([SIBLING, ALONE])].sort_values("level")
    named = outer[~outer["what"].isin([SIBLING, ALONE])]
    return [(x, bool(left)) if what == SIBLING else None for what, x, left in zip(path["what"], path["node"], path["left"])], dict(zip(named["what"], named["node"]))


def _outer_of(level: int, height: int):
    """For the nodes of one level of superblocks: the outer nodes of the superblock below each of them."""

    def run(group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        rows, pos = [], group["pos"].tolist()
        tree = group["tree"].iloc[0] if pos else None
        path, named = _split(outer)
        for p, inner in zip(pos, _inner(pos, group["node"].tolist(), int(group["n"].iloc[0]), height) if pos else []):
            steps = [(level * height + k, s) for k, s in enumerate(inner)] + [((level + 1) * height + k, s) for k, s in enumerate(path)]
            rows += [(tree, p, k, SIBLING, *s) if s else (tree, p, k, ALONE, None, None) for k, s in steps]
            rows += [(tree, p, -1, what, node, None) for what, node in named.items()]
        return pd.DataFrame(rows, columns=["tree", "block", "level", "what", "node", "left"])

    return run


def fold(node: str, path: list[tuple[str, bool] | None]) -> str:
    for step in path:
        node = digest(node if step is None else step[0] + node if step[1] else node + step[0])
    return node


def _finish(height: int):
    def run(group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """Proofs and folded roots of the leaves of one superblock."""
        group = group.sort_values("pos")
        pos, leaf = group["pos"].tolist(), group["leaf"].tolist()
        path, named = _split(outer)
        beyond = "".join(s[0] for s in path if s)
        proofs, folded, known = [], [], {}
        for mine, changed, inner in zip(leaf, group["tampered"], _inner(pos, leaf, int(group["n"].iloc[0]), height) if pos else []):
            top = fold(changed if isinstance(changed, str) else mine, inner)
            if top not in known:
                known[top] = fold(top, path)
            folded.append(known[top])
            proofs.append(digest("".join(s[0] for s in inner if s) + beyond))
        root = named.get(ROOT)
        return pd.DataFrame({"doc_id": group["doc_id"], "leaf": leaf, "subroot": named.get(SUBROOT), "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    return run


def descend(levels: list[DataFrame], tops: DataFrame, finish, schema: str, height: int) -> DataFrame:
    """Cogroup the nodes of each level with the outer nodes of their superblocks, from the highest level down to `finish`.

    tops: outer nodes of whole trees (OUTER without block, with `top`), which enter where the tree has one superblock."""
    spark = tops.sparkSession
    below = spark.createDataFrame([], OUTER)
    for level in reversed(range(len(levels))):
        entering = tops.where(F.col("top") == level).select("tree", F.lit(0).cast("long").alias("block"), "level", "what", "node", "left")
        outer = below.union(entering)
        nodes = levels[level].select("*", F.shiftright("pos", height).alias("block"))
        both = nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
        if not level:
            return both.applyInPandas(finish, schema)
        below = stored(both.applyInPandas(_outer_of(level, height), OUTER), "outer")
    raise ValueError("a tree has at least one level")


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf, if there is one), verified."""
    each = stored(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")  # row spreads equal rows over tasks
    placed = stored(numbered(each, ["tree", "doc_id", "leaf", "row"]).drop("row"), "placed")
    levels, subroots = climb(placed.select("tree", "pos", "n", F.col("leaf").alias("node")), height)
    # the roots of the languages are the leaves of one more tree
    over = stored(numbered(subroots.select(F.lit(ONE).alias("tree"), F.col("tree").alias("of"), "node", "top"), ["tree", "of"]), "subroots")
    upper, root = climb(over.select("tree", "pos", "n", "node"), height)
    nowhere = F.lit(None).cast("boolean").alias("left")
    entering = root.select("tree", "top", F.lit(-1).alias("level"), F.lit(ROOT).alias("what"), "node", nowhere)
    found = descend(upper, entering, _outer_of(0, height), OUTER, height)
    # what enters at the top of a language: the siblings of its root, the root of all, and its own root
    to = over.select("pos", F.col("of").alias("tree"), F.col("top").alias("into"))
    beyond = F.when(F.col("level") < 0, F.col("level")).otherwise(F.col("level") + BEYOND).alias("level")
    siblings = found.drop("tree").join(to, found["block"] == to["pos"]).select("tree", F.col("into").alias("top"), beyond, "what", "node", "left")
    own = over.select(F.col("of").alias("tree"), "top", F.lit(-1).alias("level"), F.lit(SUBROOT).alias("what"), "node", nowhere)
    return descend([placed, *levels[1:]], stored(siblings.union(own), "entering"), _finish(height), OUT, height)
