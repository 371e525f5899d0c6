"""Connected components of an edge table, by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that a task takes at least.
TASK_EDGES = 50_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of edges (a, b: long). No edge, no row.

    Every round hangs each node under its smallest neighbour (or itself), follows parents' parents up to
    the roots, and contracts the edges; at least half of the nodes that still have an edge vanish, so
    that the rounds grow with the logarithm of the nodes, and the steps of a round with that of the
    longest way up. What a step leaves is kept in the shared folder, which cuts the lineage and puts an
    exchange on both sides of the next join, so that adaptive execution can split a node that very many
    others hang under. A small graph takes few tasks a step. Repeated edges and loops change nothing.
    """
    edges = common.durable(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    tasks = 1 + edges.count() // TASK_EDGES

    def durable(df: DataFrame) -> DataFrame:  # what follows has no more rows than twice the edges
        return common.durable(df.coalesce(tasks))

    labels = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")))
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grandparent"))
            jumped = durable(parents.join(above, "parent").select("node", F.col("grandparent").alias("parent"), (F.col("grandparent") < F.col("parent")).alias("moved")))
            parents = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        up = parents.select(F.col("node").alias("component"), F.col("parent").alias("higher"))
        labels = durable(labels.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component")))
        of_a, of_b = (parents.select(F.col("node").alias(x), F.col("parent").alias(f"to_{x}")) for x in "ab")
        moved = edges.join(of_a, "a").select("to_a", "b").distinct().join(of_b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = durable(moved.where("a <> b").distinct())
    return labels
