"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.session import materialise

# Up to this many (contracted) edges are finished by one local pass.
SMALL_EDGES = 200_000


def _finish(edges: DataFrame) -> DataFrame:
    """``(label, root)`` of a checked small edge table."""
    pairs = edges.toArrow()
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    labels = np.unique(np.concatenate([a, b]))
    parent = np.arange(len(labels))
    left, right = np.searchsorted(labels, a), np.searchsorted(labels, b)
    while True:
        low = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, parent[left], low)
        np.minimum.at(parent, parent[right], low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        if np.array_equal(before, parent):
            break
    rows = list(zip(labels.tolist(), labels[parent].tolist()))
    return edges.sparkSession.createDataFrame(rows, "label long, root long")


def _roots(edges: DataFrame) -> DataFrame:
    """``(label, root)``: every label hooked to its least neighbour, pointers followed to the end."""
    both = edges.select(F.col("a").alias("label"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("label"), F.col("a").alias("other"))
    )
    parent = materialise(
        both.groupBy("label").agg(F.min("other").alias("low")).select("label", F.least("label", "low").alias("root"))
    )
    while True:
        up = parent.select(F.col("label").alias("root"), F.col("root").alias("next"))
        jumped = materialise(parent.join(up, "root").select("label", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        parent = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return parent


def component_roots(edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """``(label, root)`` for every node that has an edge ``(a, b)`` of a durable table."""
    if edges.limit(small_edges + 1).count() <= small_edges:
        return _finish(edges)
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    return connected_components(ends, edges, small_edges).select(F.col("id").alias("label"), F.col("comp").alias("root"))


def connected_components(nodes: DataFrame, edges: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """``(id, comp)``: the least node id reachable from every node of ``nodes`` (``id``).

    Edges ``(a, b)`` are contracted in rounds: hook to the least neighbour,
    follow the pointers, relabel, drop inner and repeated edges.
    """
    mapping = nodes.select("id", F.col("id").alias("comp"))
    rest = materialise(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    )
    while True:
        n = rest.count()
        if n == 0:
            return mapping
        roots = _finish(rest) if n <= small_edges else _roots(rest)
        moved = roots.select(F.col("label").alias("comp"), "root")
        mapping = materialise(
            mapping.join(moved, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
        )
        if n <= small_edges:
            return mapping
        for end in ("a", "b"):
            rest = rest.join(roots.select(F.col("label").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        rest = materialise(
            rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        )
