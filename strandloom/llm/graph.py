"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import cut


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of the edges (a, b), two long columns; a label is shared by
    exactly the nodes of one component.

    Each round hooks every node to the smallest of itself and its neighbours, then replaces both ends of each
    edge by what they hooked to; edges within one label vanish. Fingerprints and hashes, the nodes
    here, are in no order along a path, so the graph shrinks by a factor each round. Minima are
    pre-aggregated before shuffling, and both sides of each join are plain tables, so Spark can
    split the partitions of a node with very many edges. Only whether an edge is left reaches the driver.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), f"{name}-hook")
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            to = hook.select(F.col("a").alias("label"), "p")
            labels = labels.join(to, "label", "left")
            labels = cut(labels.select("node", F.coalesce("p", "label").alias("label")), f"{name}-labels")
        left = edges.join(hook.withColumnRenamed("p", "pa"), "a")
        ends = left.join(hook.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        edges = cut(ends.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), f"{name}-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
