"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; longs).  Two
    nodes share a root exactly when they are connected.

    Each round points every node at the least of its neighbours, follows those
    pointers twice, and replaces both ends of every edge; self loops go.  The
    edge table shrinks geometrically, so a few rounds end it.  Tables are
    stored between rounds; a node with very many edges is pre-aggregated, and
    its joins see stored tables that AQE may split.  Nothing is collected.
    """
    named = None
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "pointers")
        for _ in range(2):
            over = up.select(F.col("node").alias("up"), F.col("up").alias("_next"))
            up = materialize(up.join(over, "up").select("node", F.col("_next").alias("up")), "pointers")
        named = up.withColumnRenamed("up", "root") if named is None else named.join(
            up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        named = materialize(named, "named")
        at = lambda end: up.select(F.col("node").alias(end), F.col("up").alias(f"_{end}"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").filter("_a <> _b")
        edges = materialize(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    return named if named is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
