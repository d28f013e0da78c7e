"""Connected components by hooking and shortcutting, as DataFrame joins.

Each round lowers the label of a node, and of the node its label points at, to the smallest label
among its neighbours, then follows labels once more (pointer jumping), so the number of rounds grows
with the logarithm of a component's diameter.  Labels live in a written table between rounds: nothing
but one count reaches the driver, and a lost executor never repeats an earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import stored


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)`` for every node with an edge; component is its smallest node.

    Loops, repeated and reversed edges change nothing; edges with a null end are ignored.  Labels
    and edges are stored tables that meet in plain joins, whose hot keys (a hub with most edges) Spark's
    adaptive execution splits; the minima behind them are taken before they travel.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(max_rounds):
        # For each node: the smallest label of its neighbours.
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b")
            .groupBy("a")
            .agg(F.min("l").alias("near"))
            .join(labels.select(F.col("node").alias("a"), "label"), "a")
        )
        # The node and the node that it points at both take it.
        hooked = (
            near.select(F.col("a").alias("node"), F.least("near", "label").alias("l"))
            .unionByName(near.select(F.col("label").alias("node"), F.least("near", "label").alias("l")))
            .groupBy("node")
            .agg(F.min("l").alias("label"))
        )
        hooked = stored(hooked, "labels")
        # Shortcut: the label of the label.
        roots = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = stored(hooked.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        changed = (
            jumped.join(labels.select("node", F.col("label").alias("was")), "node", "left")
            .filter("was IS NULL OR was <> label")
            .isEmpty()
        )
        labels = jumped
        if changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
