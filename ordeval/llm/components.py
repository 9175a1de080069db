"""Connected components of an edge table by contraction, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordeval.llm.common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the same for all nodes of a component.

    A round points each node at its least neighbour, follows the pointers to their ends, and replaces the
    edges by those between different ends; it at least halves the nodes that still have edges. Tables are
    staged in the shared folder, so neither lineage nor driver memory grows with the rounds.
    """
    live = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pointers = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
    while True:
        ahead = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = staged(pointers.join(ahead, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        pointers = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            break
    ends = pointers.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    other = pointers.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = staged(
        live.join(ends, "a").join(other, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    )
    if between.isEmpty():
        return pointers
    upper = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return pointers.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
