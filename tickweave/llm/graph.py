"""Connected components of an edge table by contraction; no step holds a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, root), root being the smallest id that node reaches.

    Each round lets every node point at its smallest neighbour, follows the pointers to their ends by
    doubling, and replaces both ends of each edge with those. Edges inside one tree vanish, so at most
    half of the nodes that still have edges remain after a round. Hubs are only met by partial minima
    and by sort-merge joins, which adaptive execution splits. Loops and repeated edges are harmless;
    an empty table gives an empty table.
    """
    live = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not live.isEmpty():
        pointers = _roots(live)
        if labels is None:
            labels = pointers.select("node", F.col("parent").alias("root"))
        else:
            step = pointers.select(F.col("node").alias("root"), F.col("parent").alias("next"))
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        ends = [pointers.select(F.col("node").alias(x), F.col("parent").alias(f"r{x}")) for x in ("a", "b")]
        moved = live.join(ends[0], "a").join(ends[1], "b").where("ra != rb")
        after = materialize(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop_scratch(live)
        live = after
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _roots(edges: DataFrame) -> DataFrame:
    """(node, parent): where the chain of smallest neighbours that starts at node ends."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    now = materialize(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"), F.lit(True).alias("moved")), "pointers")
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        after = materialize(now.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "pointers")
        drop_scratch(now)
        now = after
        if now.where("moved").isEmpty():
            return now
