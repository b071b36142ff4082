"""End-to-end choice of a representative subset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.functions.metrics import as_items
from coverset.operators.assignment import target_size
from coverset.operators.butina import butina
from coverset.operators.density import density_cluster
from coverset.operators.kmeans import kmeans
from coverset.operators.maxmin import maxmin
from coverset.operators.representatives import medoids, nearest_to_centers, nearest_to_means
from coverset.session import materialise


def select_subset(
    df: DataFrame,
    method: str = "butina",
    metric: str = "tanimoto",
    id_col: str = "id",
    item_col: str = "item",
    ratio: float = 1.0,
    fixed: int | None = None,
    **params,
) -> DataFrame:
    """``(id)`` of the chosen rows.

    ``butina`` takes the medoid of every cluster, ``kmeans`` the member nearest
    to each centre, ``maxmin`` its picks, ``density`` the member nearest to each
    cluster mean.
    """
    if method not in ("butina", "kmeans", "maxmin", "density"):
        raise ValueError(f"unknown method {method!r}")
    used = metric if method in ("butina", "maxmin") else "euclidean"
    items = as_items(df, id_col, item_col, used)
    if items.isEmpty():
        return items.select("id")
    if method == "butina":
        labels = materialise(butina(items, used, params.pop("cutoff", 0.4), **params))
        return medoids(items.join(labels, "id"), used).select("id")
    if method == "density":
        labels = materialise(density_cluster(items, **params))
        return nearest_to_means(items.join(labels, "id")).select("id")
    k = target_size(items.count(), ratio, fixed)
    if method == "maxmin":
        return maxmin(items, k, used, **params).select("id")
    fitted = kmeans(items, k, **params)
    return nearest_to_centers(items.join(fitted.assignment, "id"), fitted.centers).select("id")


def run_summary(df: DataFrame, subset: DataFrame, valid_col: str = "is_valid", id_col: str = "id") -> DataFrame:
    """One row: records, valid records, representatives and their share in percent of the valid records."""
    chosen = subset.select(F.col(id_col)).distinct().withColumn("picked", F.lit(True))
    joined = df.join(chosen, id_col, "left")
    valid = F.count_if(F.col(valid_col))
    picked = F.count_if(F.col("picked"))
    return joined.agg(
        F.count("*").alias("records"),
        valid.alias("valid"),
        picked.alias("representatives"),
        F.when(valid > 0, 100.0 * picked / F.greatest(valid, F.lit(1))).otherwise(F.lit(0.0)).alias("subset_percent"),
    )
