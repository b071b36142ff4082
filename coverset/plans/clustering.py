"""One entry for all clustering methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.functions.metrics import as_items, metric_named
from coverset.operators.assignment import target_size, to_labels
from coverset.operators.butina import butina
from coverset.operators.density import density_cluster
from coverset.operators.kmeans import kmeans
from coverset.operators.maxmin import maxmin

METHODS = ("butina", "kmeans", "maxmin", "density")


@dataclass
class Clustering:
    """Outcome of ``cluster``; a failure is a status and a message, not an exception."""

    status: str
    message: str
    assignment: DataFrame | None = None  # id, cluster_id[, is_center]
    centers: DataFrame | None = None  # cluster_id, center
    picks: DataFrame | None = None  # id, pick_order, pick_dist


def cluster(
    df: DataFrame,
    method: str,
    metric: str = "tanimoto",
    id_col: str = "id",
    item_col: str = "item",
    ratio: float = 1.0,
    fixed: int | None = None,
    **params,
) -> Clustering:
    """Cluster the usable rows of ``df`` by name.

    ``kmeans`` and ``maxmin`` aim at ``target_size(n, ratio, fixed)``. K-means
    and density clustering are Euclidean whatever ``metric`` says. MaxMin labels
    are the pick order, -1 for rows that were not picked.
    """
    if method not in METHODS:
        return Clustering("error", f"unknown method {method!r}; choose from {METHODS}")
    try:
        used = metric if method in ("butina", "maxmin") else "euclidean"
        metric_named(used)
        items = as_items(df, id_col, item_col, used)
        if items.isEmpty():
            return Clustering("error", "no usable rows")
        if method == "butina":
            found = butina(items, used, params.pop("cutoff", 0.4), **params)
            return Clustering("success", "butina clustering done", found)
        if method == "density":
            return Clustering("success", "density clustering done", density_cluster(items, **params))
        k = target_size(items.count(), ratio, fixed)
        if method == "kmeans":
            fitted = kmeans(items, k, **params)
            return Clustering("success", f"k-means done with {k} clusters", fitted.assignment, fitted.centers)
        picks = maxmin(items, k, used, **params)
        labels = to_labels(items, picks).select("id", F.col("label").alias("cluster_id"), (F.col("label") >= 0).alias("is_center"))
        return Clustering("success", f"{k} rows picked", labels, picks=picks)
    except Exception as failure:  # noqa: BLE001 - reported through the status
        return Clustering("error", f"{method} failed: {failure}")
