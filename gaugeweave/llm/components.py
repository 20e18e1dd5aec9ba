"""Connected components of a link table, each named by its smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeweave.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` to ``(node, component)`` for every id that occurs in a link.

    Each round turns a node's links to larger ids into links to the smallest of its neighbourhood, then does the
    same with its links to smaller ids (large-star and small-star). The rounds end when every link leads to a
    component's smallest id, after a number that grows with the logarithm of the longest chain. All sides are
    pre-aggregated; a hub with very many links is joined, never gathered.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        large = materialize(_large_star(edges), "large-star")
        small = materialize(_small_star(large), "small-star")
        # A star forest: no node is both the larger and the smaller end of a link, and each has one smaller end.
        centres = small.select(F.col("b").alias("a")).distinct()
        unfinished = small.join(centres, "a", "left_semi").select("a").union(
            small.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        )
        edges = small
        if unfinished.isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _least(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b): each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v"))
    linked = both.join(_least(both), "u").where("v > u AND v <> m")
    return linked.selectExpr("v AS a", "m AS b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b): each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.selectExpr("a AS u", "b AS v")
    least = _least(down)
    linked = down.join(least, "u").selectExpr("v AS a", "m AS b").union(least.selectExpr("u AS a", "m AS b"))
    return linked.where("a <> b").distinct()
