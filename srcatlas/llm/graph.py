"""Connected components of an edge table, as joins that shrink it; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) with a > b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour (a minimum, so a node with a third of all edges is
    combined before the shuffle), follows the hooks to their roots and replaces edges by edges between roots.
    A chain of hooks halves per step and edges between roots vanish geometrically. Every round's tables are
    written to the shared folder, which cuts the lineage."""
    left = written(_pairs(edges), "edges")
    labels: DataFrame | None = None
    while left.limit(1).count():
        hooks = written(left.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = hooks.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            jumped = written(jumped, "hooks")
            moved = jumped.where("moved").limit(1).count()
            hooks = jumped.select("node", "root")
            if not moved:
                break
        if labels is None:
            labels = hooks.select("node", F.col("root").alias("component"))
        else:
            up = hooks.select(F.col("node").alias("component"), "root")
            known = labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            labels = written(known.unionByName(hooks.select("node", F.col("root").alias("component")).join(labels.select("node"), "node", "left_anti")), "labels")
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        moved_edges = left.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        left = written(_pairs(moved_edges), "edges")
    spark = edges.sparkSession
    if labels is None:
        kind = edges.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    # roots never hook, so they have no label of their own yet
    roots = labels.select(F.col("component").alias("node"), "component").distinct().join(labels.select("node"), "node", "left_anti")
    return labels.unionByName(roots)
