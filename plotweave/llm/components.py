"""Connected components of links, by contracting the graph in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``; the component is named by its smallest node.

    Every round hooks each node to its smallest neighbour, follows that pointer twice and joins the nodes that
    met into one; rounds are logarithmic in the longest path for chains and one or two for stars. Nodes and links
    stay in tables throughout; each round's table is written to the shared folder, which also cuts the lineage.
    Repeated links and links of a node to itself are allowed; no links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(both.where(F.col("a") != F.col("b")).distinct(), "links")
    placed = edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        hooked = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
            "node", F.least("node", "least").alias("up"))
        above = hooked.select(F.col("node").alias("_mid"), F.col("up").alias("_top"))
        jump = staged(hooked.join(above, hooked["up"] == above["_mid"]).select("node", F.col("_top").alias("top")), "hooks")
        moved = jump.select(F.col("node").alias("component"), "top")
        placed = staged(
            placed.join(moved, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "placed")
        ends = [jump.select(F.col("node").alias(c), F.col("top").alias(f"_{c}")) for c in ("a", "b")]
        edges = staged(
            edges.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            .where(F.col("a") != F.col("b")).distinct(), "links")
    return placed
