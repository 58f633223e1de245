"""Connected components of an edge list, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to another; root: its component's least node.

    edges: columns a and b of one orderable type. Self loops, repeats and nulls
    are dropped; an empty table gives an empty table.

    Each round, every node takes the least node among itself and its neighbours,
    then every edge is replaced by one between its ends' choices and one that
    ties each node to its choice. Least labels so travel twice as far each round
    on chains, and a star is done in one. Aggregation is partial before each
    shuffle and joins are plain equi-joins that the adaptive planner can split,
    so a node with very many neighbours is no group in one task.
    """
    ties = durable(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    if ties.isEmpty():
        return ties.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # labels: node -> the least node known to be connected to it
    labels = durable(
        ties.select(F.col("b").alias("node"), F.col("a").alias("root"))
        .union(ties.select(F.col("a"), F.col("a")))
        .groupBy("node")
        .agg(F.min("root").alias("root"))
    )
    while True:
        # pointer jumping: follow the label of the label
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = labels.join(up, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        left = jumped.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = jumped.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        seen = ties.join(left, "a").join(right, "b").select("a", "b", "ra", "rb")
        # an end takes the other end's label, and so does the node its own label names
        offers = seen.where("ra <> rb").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("node"), F.least("ra", "rb").alias("root")),
                    F.struct(F.col("b").alias("node"), F.least("ra", "rb").alias("root")),
                    F.struct(F.greatest("ra", "rb").alias("node"), F.least("ra", "rb").alias("root")),
                )
            ).alias("o")
        ).select("o.node", "o.root")
        new = durable(jumped.union(offers).groupBy("node").agg(F.min("root").alias("root")))
        changed = new.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old")
        if changed.isEmpty():
            return new
        labels = new
