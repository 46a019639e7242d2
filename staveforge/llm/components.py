"""Connected components over an edge table by contraction, all on joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node that is reachable.

    In each round every node points to the smallest of itself and its neighbours, pointers are doubled until they end
    at roots, and edges go on between roots only, so those within one label drop out and at most half of the nodes
    stay. Steps are written tables, so a lost executor repeats one step at most. Empty edges give no rows.
    """
    e = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while True:
        both = e.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = scratch.write(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("label")), "up")
        while up.where("label <> node").select("label").join(up.where("label <> node").select(F.col("node").alias("label")), "label", "left_semi").limit(1).count():
            nxt = scratch.write(up.join(up.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.col("far").alias("label")), "up")
            scratch.drop(up)
            up = nxt
        if labels is None:
            labels = up
        else:
            nxt = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.coalesce("far", "label").alias("label"))
            nxt = scratch.write(nxt, "labels")
            scratch.drop(labels)
            labels = nxt
        ends = e.join(up.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(up.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        rest = scratch.write(ends.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        scratch.drop(e)
        e = rest
        if not e.limit(1).count():
            scratch.drop(e)
            return labels


def extend(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """labels after edges (a, b) between nodes have come in; only the labels that these edges join are worked on."""
    named = edges
    for c in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(c, F.coalesce(f"l{c}", c)).drop(f"l{c}")
    joined = components(named, scratch)
    moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    new = joined.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return scratch.write(moved.unionByName(new), "labels")
