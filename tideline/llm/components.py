"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.llm.storage import dropped, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of it) for edges u, v of longs.

    Each round every node joins its least neighbour and the graph shrinks to the edges
    between what is left, so the rounds grow with the logarithm of the longest path.
    Null ends and loops are ignored; without edges the result is empty.
    """
    edges = materialize(edges.select("u", "v").filter("u <> v").distinct())
    labels = materialize(edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("component")))
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        parent = materialize(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")))
        step = parent.select(F.col("u").alias("component"), "p")
        merged = materialize(labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        moved = edges.join(parent, "u").select(F.col("p").alias("a"), "v")
        moved = moved.join(parent.select(F.col("u").alias("v"), "p"), "v").select("a", F.col("p").alias("b"))
        left = materialize(moved.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        dropped(labels, edges, parent)
        labels, edges = merged, left
    dropped(edges)
    return labels
