"""Connected components of an edge list, in rounds of grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acequia.session import materialize


def _nearest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, itself included; combined before the shuffle."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node reachable.

    Large-star and small-star steps by turns: a node's larger, then its smaller
    neighbours are hung on its smallest one, until nothing changes. A node with
    very many neighbours is only ever a key of a combined minimum and of a join,
    which adaptive execution splits. Each round is written to the shared folder,
    so lineage stays short and a lost executor costs a re-read.
    """
    edges = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a > b")
    edges = materialize(edges.distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.where("b > a")
            .join(_nearest(edges), "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        large = large.where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("low").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                )
            ).alias("e")
        )
        after = materialize(small.select("e.a", "e.b").where("a > b").distinct(), "edges")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after
