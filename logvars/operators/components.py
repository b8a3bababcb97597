"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _scatter(node: Column) -> Column:
    """A reversible scrambling of 64-bit ids (shifts and xors only, so no two ids meet)."""
    x = node.cast("long")
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node of ``nodes(id)`` is linked to.

    Every round sends each node to the smallest scrambled id near it, follows that link
    four times in all, and replaces the edges by the distinct edges between the nodes that
    remain.  Scrambled ids keep such chains short whatever the numbering, so a round leaves
    a fraction of the nodes and edges.  Each round is written, which cuts lineage.
    """
    scattered = edges.where("src <> dst").select(_scatter(F.col("src")).alias("a"), _scatter(F.col("dst")).alias("b"))
    links = stage(_distinct_links(scattered), "edges")
    moves = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        nearest = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near"))
        jump = stage(nearest.select("id", F.least("id", "near").alias("parent")), "parents")
        for _ in range(2):
            up = jump.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
            jump = jump.join(up, "parent").select("id", F.col("grand").alias("parent"))
        jump = stage(jump, "parents")
        moves.append(jump.select(F.col("id").alias("root"), "parent"))
        to_src = jump.select(F.col("id").alias("src"), F.col("parent").alias("a"))
        to_dst = jump.select(F.col("id").alias("dst"), F.col("parent").alias("b"))
        links = stage(_distinct_links(links.join(to_src, "src").join(to_dst, "dst").where("a <> b")), "edges")
    roots = nodes.select("id", _scatter(F.col("id")).alias("root"))
    for move in moves:
        roots = roots.join(move, "root", "left").select("id", F.coalesce("parent", "root").alias("root"))
    roots = stage(roots, "roots")
    return roots.join(roots.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def _distinct_links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
