"""Connected components of a link table, by alternating large-star and small-star rounds of joins and minima.

Each round is written to the shared folder, so lineage stays short and lost executors cost one round. Minima are summed up in
parts and stored before links are joined with them, so both sides of a join are plain exchanges and a node with very many links
can be split over tasks. Links may be repeated, in either direction, or lead from a node to itself; links with a null end are
left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.union(edges.select("b", "a"))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them; each link has a > b."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    others = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(others).distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Nodes without links are not listed."""
    ends = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("l"), F.col(b).alias("r"))
    edges = stored(ends.where("l is not null and r is not null and a > b").select("a", "b").distinct(), "links")
    mark = _mark(edges)
    for _ in range(most_rounds):
        edges = stored(_small_star(stored(_large_star(edges), "stars")), "stars")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
