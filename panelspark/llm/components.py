"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import step


def _turned(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, in one pass."""
    return edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node around it."""
    both = _turned(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    links = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    return down.join(least, "a").select(F.inline(links)).where("a != b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node is both an end and a centre and each end has one centre; ``edges`` (a > b) are distinct."""
    one, none = F.lit(1), F.lit(0)
    sides = F.array(F.struct(F.col("a").alias("node"), one.alias("up"), none.alias("down")),
                    F.struct(F.col("b").alias("node"), none.alias("up"), one.alias("down")))
    each = edges.select(F.inline(sides)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the component is its least node.

    Alternating large and small stars; each round is written to the checkpoint folder. Ends when the
    edges are stars around the least nodes. Loops, repeated edges and edges in both directions are allowed; null ends are ignored.
    """
    e = step(edges.where("a is not null and b is not null and a != b")
                    .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(e):
        e = step(_small_star(_large_star(e)))
    nodes = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")),
                    F.struct(F.col("b").alias("node"), F.col("b").alias("component")))
    return e.select(F.inline(nodes)).distinct()
