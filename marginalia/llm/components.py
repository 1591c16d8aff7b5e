"""Connected components of a graph given as edges between 64-bit node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut_lineage


def _jumped(parents: DataFrame) -> DataFrame:
    """Every node's parent replaced by the parent's parent."""
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
    return parents.join(above, "parent", "left").select("node", F.coalesce("_above", "parent").alias("parent"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node id reachable) for nodes of the edges ``a``, ``b``.

    In each round every node hooks onto its smallest neighbour, paths are shortened, and the
    edges are drawn anew between what is left: the number of nodes at least halves. Tables
    are written between rounds, all steps are joins and partial aggregations, and nothing but
    whether edges are left comes to the driver. Loops, repeated edges and edges with a null end
    (which is no node) do no harm.
    """
    ends = edges.select(F.col("a").cast("bigint").alias("u"), F.col("b").cast("bigint").alias("v")).where("u <> v")
    left = cut_lineage(ends.union(ends.select("v", "u")).distinct())
    labels = left.select(F.col("u").alias("node"), F.col("u").alias("component")).limit(0)
    first = True
    while not left.isEmpty():
        hooked = left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_v"))
        parents = cut_lineage(hooked.select("node", F.least("node", "_v").alias("parent")))
        parents = cut_lineage(_jumped(parents))
        parents = cut_lineage(_jumped(parents))
        if first:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            known = parents.select(F.col("node").alias("component"), "parent")
            labels = labels.join(known, "component", "left")
            labels = cut_lineage(labels.select("node", F.coalesce("parent", "component").alias("component")))
        first = False
        u = parents.select(F.col("node").alias("u"), F.col("parent").alias("_u"))
        v = parents.select(F.col("node").alias("v"), F.col("parent").alias("_v"))
        drawn = left.join(u, "u").join(v, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
        left = cut_lineage(drawn.where("u <> v").distinct())
    return labels
