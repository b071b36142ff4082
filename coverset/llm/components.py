"""Connected components of an edge table, wholly on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.llm.common import drop_table
from coverset.session import materialise


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _follow(parent: DataFrame) -> DataFrame:
    """Parents of parents until none moves: the depth halves each round."""
    spark = parent.sparkSession
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = parent.join(up, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root"), F.coalesce(F.col("next") < F.col("root"), F.lit(False)).alias("moved")
        )
        jumped = materialise(jumped)
        drop_table(spark, parent)
        parent = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the least node reachable, for every node that has an edge ``(a, b)``.

    Each round hooks every node to its least neighbour, follows the pointers
    to their end and contracts the edges. Nothing is collected: a round costs
    a grouped minimum and joins on node ids, and a node with very many edges
    is pre-aggregated (minimum) or split by the engine's skew join. Repeated
    edges and loops are ignored; no edges give an empty table.
    """
    spark = edges.sparkSession
    rest = materialise(_clean(edges))
    labels = None
    while not rest.isEmpty():
        low = rest.select(F.col("a").alias("node"), F.col("a").alias("root")).unionByName(
            rest.select(F.col("b").alias("node"), F.col("a").alias("root"))
        )
        roots = _follow(materialise(low.groupBy("node").agg(F.min("root").alias("root"))))
        if labels is None:
            labels = roots
        else:
            moved = roots.select(F.col("node").alias("root"), F.col("root").alias("to"))
            newer = materialise(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            drop_table(spark, labels)
            labels = newer
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        fewer = materialise(
            _clean(rest.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        )
        drop_table(spark, rest)
        rest = fewer
    if labels is None:
        labels = rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
