"""Connected components of an edge table, by rounds of DataFrame joins.

Defined cases: loops make their node a component of its own, repeated edges and both directions count once, an empty
table gives an empty result; nodes are longs and not null; chains and stars of any size take at most log2 rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vartide.llm import common


def _stars(both: DataFrame) -> DataFrame:
    """node and root for every node of symmetric edges without loops: each node hooks onto its least neighbour.

    Following least neighbours can only end in two nodes that are each other's; the smaller one becomes the
    root. Pointers are then doubled until every node points at its root."""
    least = common.materialize(both.groupBy("a").agg(F.min("b").alias("up")), "least")
    above = least.select(F.col("a").alias("up"), F.col("up").alias("far"))
    hooked = least.join(above, "up").select(F.col("a").alias("node"), F.when(F.col("far") == F.col("a"), F.least("a", "up")).otherwise(F.col("up")).alias("root"))
    hooked = common.materialize(hooked, "hooked")
    while True:
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("far"))
        fresh = common.materialize(hooked.join(jump, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).cast("int").alias("changed")), "hooked")
        moved = fresh.agg(F.sum("changed")).first()[0]
        hooked = fresh.select("node", "root")
        if not moved:
            return hooked


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) for every node of edges (a, b: long).

    Each round hooks every root onto its least neighbour and contracts the edges to roots. A root that still
    has an edge merges with at least one other, so roots halve: rounds are at most log2 of the nodes, and
    doubling steps in a round as well. Tables are written to the shared folder; nothing but counts
    reaches the driver."""
    both = common.materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    both = both.filter("a <> b")
    while not both.isEmpty():
        stars = _stars(both)
        to = lambda x: stars.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))  # noqa: E731, B023
        labels = labels.join(stars.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        labels = common.materialize(labels, "labels")
        both = both.join(to("a"), "a").join(to("b"), "b").filter("root_a <> root_b")
        both = common.materialize(both.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return common.materialize(labels.join(least, "label").select("node", F.col("least").alias("label")), "labels")


def extend(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """`components` of the edges behind labels and more edges (a, b): only the labels that these join are
    looked at again."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    new = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    labels = common.materialize(labels.unionByName(new), "labels")
    end = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}"))
    joined = edges.join(end("a"), "a").join(end("b"), "b").filter("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
    higher = components(common.materialize(joined, "edges")).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return common.materialize(labels.join(higher, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")
