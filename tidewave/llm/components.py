"""Connected components of an undirected graph of bounded degree, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, few, materialize


def linked(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have an edge: label is the smallest node reachable, itself included.

    edges has `a`, `b`, either way round, repeats allowed. Each round a node takes the smallest label among its neighbours' and its own,
    then that node's label so far, until nothing changes. Labels live in Spark tables, checkpointed each round; only the count of
    changes comes to the driver. A graph of BROADCAST_ROWS edges at most lies in one partition, so that its rounds shuffle nothing.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, forget=True)
    if both.count() <= BROADCAST_ROWS:
        both = materialize(both.coalesce(1), forget=True)
    labels = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")).sortWithinPartitions("node"), forget=True)
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        heads = labels.select(F.col("node").alias("label"), F.col("label").alias("head"))
        jumped = stepped.join(heads, "label").select("node", F.least("label", "head").alias("label"), "was")
        labels = materialize(jumped.sortWithinPartitions("node"), forget=True)  # else planning keeps all equal orders of all rounds
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of distinct `node`s: the smallest node reachable. No edges: every node is its own label."""
    return nodes.join(linked(edges), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after more edges between its nodes: components of labels become one, with the smallest label."""
    if edges.isEmpty():
        return labels
    for x in "ab":
        edges = edges.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"_{x}")), x)
    found = linked(edges.filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    moved = labels.join(few(found.select(F.col("node").alias("label"), F.col("label").alias("_to"))), "label", "left")
    return materialize(moved.select("node", F.coalesce("_to", "label").alias("label")).sortWithinPartitions("node"), forget=True)
