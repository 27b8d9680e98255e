"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill import runtime


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; the component is its least node.

    In each round every node picks its least neighbour, or itself if that is less. Picks are
    followed to their ends, doubling the steps each time, so a chain of any order of nodes ends
    after a logarithm of its length. Edges then join the ends, of which a component has half as
    many as nodes at most. Minima are combined before their shuffle, and all other steps join
    against one row a node.
    """
    rest = runtime.cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    labels = _both_ways(rest).select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    rest, left = runtime.cut_and_count(rest.filter("a <> b"))
    while left:
        picks = _both_ways(rest).groupBy("a").agg(F.min("b").alias("b"))
        picks = runtime.cut_lineage(picks.select(F.col("a").alias("node"), F.least("a", "b").alias("pick")))
        moved = 1
        while moved:
            further = _renamed(picks, "pick", picks, was="_was")
            further, _, moved = runtime.cut_and_count(further, F.count_if(F.col("_was") != F.col("pick")))
            picks = further.drop("_was")
        labels = runtime.cut_lineage(_renamed(labels, "component", picks))
        joined = _renamed(_renamed(rest, "a", picks), "b", picks).filter("a <> b")
        ends = joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest, left = runtime.cut_and_count(ends.distinct())
    return labels


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a"))


def _renamed(rows: DataFrame, column: str, picks: DataFrame, was: str | None = None) -> DataFrame:
    """The rows with the nodes of `column` replaced by their picks, where they have one; `was`
    names a column that keeps the nodes."""
    named = picks.select(F.col("node").alias("_node"), F.col("pick").alias("_picked"))
    joined = rows.join(named, rows[column] == named["_node"], "left")
    kept = [F.coalesce("_picked", c).alias(c) if c == column else F.col(c) for c in rows.columns]
    return joined.select(*kept, *([F.col(column).alias(was)] if was else []))
