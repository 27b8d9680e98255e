"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its least node.

    In each round a node points to its least neighbour or itself, pointers are followed
    twice, and edges are replaced by those between the nodes pointed to. Trees have their
    least node as root, so the last node left of a component is its least. The number of
    edges shrinks in every round, and the rounds grow with the logarithm of the component's
    diameter. Neighbour minima are combined before their shuffle, and every other step is a
    plain equi-join against one row a node, whose hot side Spark can split; each round is a
    table in the shared checkpoint folder. Edges with a null end and loops say nothing beyond
    their nodes; a node that only has loops is its own component.
    """
    given = written(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    both = lambda e: e.union(e.select(F.col("b"), F.col("a")))
    labels = both(given).select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    left = given.filter("a <> b")
    while not left.isEmpty():
        parents = written(
            both(left).groupBy("a").agg(F.min("b").alias("b"))
            .select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        )
        for _ in range(2):
            parents = written(_follow(parents, parents, "parent"))
        labels = written(_follow(labels, parents, "component"))
        moved = _follow(_follow(left, parents, "a"), parents, "b")
        left = written(moved.filter("a <> b").distinct())
    return labels


def _follow(rows: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """The rows with `column` replaced by its parent, where it has one."""
    to = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_to"))
    joined = rows.join(to, rows[column] == to["_node"], "left")
    return joined.select([F.coalesce("_to", c).alias(c) if c == column else F.col(c) for c in rows.columns])
