"""Connected components by label propagation with pointer jumping, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns a and b. Returns ``node`` and ``component``, the smallest node reachable.

    Each round takes the smallest label among neighbours (a map-side combined minimum, so a hub is
    no hot key) and then the label's own label; rounds are written to the shared folder, which cuts
    lineage and outlives executors. What a round changed is counted as it is written.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, changed = scratch.counted(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumn("changed", F.lit(True)), "changed")
    while changed:
        seen = labels.select("node", F.col("label").alias("was"))
        near = edges.join(seen, edges.b == seen.node).groupBy("a").agg(F.min("was").alias("near"))
        step = seen.join(near, seen.node == near.a).select("node", "was", F.least("was", "near").alias("via"))
        jump = seen.select(F.col("node").alias("via"), F.col("was").alias("beyond"))
        labels, changed = scratch.counted(step.join(jump, "via").select("node", F.least("via", "beyond").alias("label"), (F.least("via", "beyond") < F.col("was")).alias("changed")), "changed")
    scratch.kept()
    scratch.clear()
    return labels.select("node", F.col("label").alias("component"))


def components_with(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` of earlier links with further ones: of the graph whose nodes are the components, only what the further links join is worked on."""
    at = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    over = components(between)
    moved = found.join(over.select(F.col("node").alias("component"), F.col("component").alias("over")), "component", "left").select("node", F.coalesce("over", "component").alias("component"))
    return written(moved.unionByName(over.join(found, "node", "left_anti")))
