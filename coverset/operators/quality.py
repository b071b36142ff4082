"""Quality of a clustering: separation, compactness and sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverset.functions.metrics import metric_named
from coverset.operators.cells import OneCell, blocked, summed
from coverset.operators.coverage import selection_spread
from coverset.operators.representatives import label_means, labelled_items, similarity_sums
from coverset.session import lookup_join, materialise


def _sq(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def _labelled(df, label_col, id_col, item_col, noise, metric="euclidean") -> DataFrame:
    return materialise(labelled_items(df, label_col, id_col, item_col, metric, noise))


def _silhouette(labelled: DataFrame, block_rows: int | None) -> DataFrame:
    m = metric_named("euclidean")

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        far = m.matrix(m.load(x["item"]), m.load(y["item"]))
        labels, at = np.unique(y["label"].to_numpy(), return_inverse=True)
        one_hot = np.zeros((y.num_rows, len(labels)))
        one_hot[np.arange(y.num_rows), at] = 1.0
        return pa.table(
            {
                "id": np.repeat(x["id"].to_numpy(), len(labels)),
                "own": np.repeat(x["label"].to_numpy(), len(labels)),
                "label": np.tile(labels, x.num_rows),
                "total": (far @ one_hot).reshape(-1),
            }
        )

    cell = OneCell()
    partial = blocked(
        cell.left(labelled), cell.right(labelled), kernel, "id long, own long, label long, total double", True, block_rows, True,
        combine=summed(["id", "own", "label"], ["total"]),
    )
    sizes = materialise(labelled.groupBy("label").agg(F.count("*").alias("n")))
    sums = partial.groupBy("id", "own", "label").agg(F.sum("total").alias("total"))
    joined = lookup_join(sums, sizes, "label", "id", bytes_per_row=32)
    same = F.col("own") == F.col("label")
    per_row = joined.groupBy("id").agg(
        F.max(F.when(same, F.col("n"))).alias("own_n"),
        F.max(F.when(same, F.col("total"))).alias("own_total"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
    )
    a = F.col("own_total") / F.greatest(F.col("own_n") - 1, F.lit(1))
    top = F.greatest(a, F.col("b"))
    # A member alone in its cluster scores 0.
    score = F.when((F.col("own_n") > 1) & (top > 0), (F.col("b") - a) / top).otherwise(F.lit(0.0))
    return per_row.filter("b IS NOT NULL").agg(F.avg(score).alias("silhouette_score"))


def silhouette(
    df: DataFrame,
    label_col: str = "cluster_id",
    id_col: str = "id",
    item_col: str = "item",
    noise: str = "drop",
    exact: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """Mean silhouette, one row; null with fewer than two clusters.

    Exact Euclidean distances are summed per row and cluster inside bounded
    block pairs. ``exact=False`` uses Spark ML's linear evaluator instead,
    which works on squared distances and gives a different figure.
    """
    labelled = _labelled(df, label_col, id_col, item_col, noise)
    if exact:
        return _silhouette(labelled, block_rows)
    spark = df.sparkSession
    if labelled.select("label").distinct().limit(2).count() < 2:
        return spark.createDataFrame([(None,)], "silhouette_score double")
    rows = labelled.select(array_to_vector("item").alias("features"), F.col("label").cast("double").alias("prediction"))
    return spark.createDataFrame([(float(ClusteringEvaluator().evaluate(rows)),)], "silhouette_score double")


def _davies_bouldin(labelled: DataFrame, block_rows: int | None) -> DataFrame:
    m = metric_named("euclidean")
    means = materialise(label_means(labelled))
    dist = m.column(F.col("item"), F.col("mean"))
    spread = lookup_join(labelled, means.select("label", "mean"), "label", "id").groupBy("label").agg(F.avg(dist).alias("spread"))
    clusters = means.join(spread, "label").select(F.col("label").alias("id"), F.col("mean").alias("item"), "spread")

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        far = m.matrix(m.load(x["item"]), m.load(y["item"]))
        total = x["spread"].to_numpy()[:, None] + y["spread"].to_numpy()[None, :]
        # Clusters with one mean are not compared, like a zero spread.
        ratio = np.divide(total, far, out=np.zeros_like(far), where=far > 0)
        ratio[x["id"].to_numpy()[:, None] == y["id"].to_numpy()[None, :]] = -np.inf
        return pa.table({"id": x["id"], "worst": ratio.max(1)})

    clusters = materialise(clusters)
    cell = OneCell()
    worst = blocked(cell.left(clusters), cell.right(clusters), kernel, "id long, worst double", True, block_rows, True)
    per = worst.groupBy("id").agg(F.max("worst").alias("worst")).filter(F.col("worst") >= 0)
    return per.agg(F.avg("worst").alias("davies_bouldin_score"))


def davies_bouldin(
    df: DataFrame, label_col: str = "cluster_id", id_col: str = "id", item_col: str = "item", noise: str = "drop",
    block_rows: int | None = None,
) -> DataFrame:
    """Davies-Bouldin index, one row; null with fewer than two clusters."""
    return _davies_bouldin(_labelled(df, label_col, id_col, item_col, noise), block_rows)


def _calinski_harabasz(labelled: DataFrame) -> DataFrame:
    means = materialise(label_means(labelled))
    dist = metric_named("euclidean").column(F.col("item"), F.col("mean"))
    within = lookup_join(labelled, means.select("label", "mean"), "label", "id").agg(F.sum(dist * dist).alias("within"))
    positions = means.select("n", F.posexplode("mean").alias("pos", "x"))
    # n |mean|^2 summed over clusters less n |overall mean|^2, per dimension.
    overall = positions.groupBy("pos").agg(
        F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("q"), F.sum("n").alias("n")
    )
    between = overall.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("between"))
    counts = means.agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    # Three one-row tables.
    one = within.withColumn("one", F.lit(1)).join(between.withColumn("one", F.lit(1)), "one").join(counts.withColumn("one", F.lit(1)), "one")
    k, n = F.col("k"), F.col("n")
    score = F.when(F.col("within") > 0, F.col("between") * (n - k) / (F.col("within") * F.greatest(k - 1, F.lit(1)))).otherwise(F.lit(1.0))
    return one.select(F.when((k > 1) & (n > k), score).alias("calinski_harabasz_score"))


def calinski_harabasz(
    df: DataFrame, label_col: str = "cluster_id", id_col: str = "id", item_col: str = "item", noise: str = "drop"
) -> DataFrame:
    """Calinski-Harabasz index, one row; null with fewer than two clusters."""
    return _calinski_harabasz(_labelled(df, label_col, id_col, item_col, noise))


def cluster_sizes(df: DataFrame, label_col: str = "cluster_id") -> DataFrame:
    """One row: number of clusters and mean, least, greatest and deviation of their sizes; -1 is left out."""
    sizes = df.filter(F.col(label_col) >= 0).groupBy(label_col).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_clusters"),
        F.avg("n").alias("avg_cluster_size"),
        F.min("n").cast("double").alias("min_cluster_size"),
        F.max("n").cast("double").alias("max_cluster_size"),
        F.stddev_pop("n").alias("std_cluster_size"),
    )


def inertia(
    df: DataFrame,
    centers: DataFrame | None = None,
    label_col: str = "cluster_id",
    id_col: str = "id",
    item_col: str = "item",
    center_id_col: str = "cluster_id",
    center_col: str = "center",
) -> DataFrame:
    """One row: summed squared distance of the rows to their own centre (the cluster mean unless given)."""
    labelled = labelled_items(df, label_col, id_col, item_col, "euclidean")
    if centers is None:
        points = materialise(label_means(labelled).select("label", F.col("mean").alias("center")))
    else:
        points = centers.select(F.col(center_id_col).cast("long").alias("label"), F.col(center_col).cast("array<double>").alias("center"))
    dist = metric_named("euclidean").column(F.col("item"), F.col("center"))
    return lookup_join(labelled, points, "label", "id").agg(F.sum(dist * dist).alias("inertia"))


def intra_similarity(
    df: DataFrame,
    metric: str = "euclidean",
    label_col: str = "cluster_id",
    id_col: str = "id",
    item_col: str = "item",
    block_rows: int | None = None,
) -> DataFrame:
    """One row: ``1 - distance`` averaged over all pairs within clusters; null when there is no pair."""
    sums = similarity_sums(_labelled(df, label_col, id_col, item_col, "drop", metric), metric, block_rows)
    pairs = F.sum("n_others")
    return sums.agg(
        F.when(pairs > 0, F.sum("total") / F.greatest(pairs, F.lit(1))).alias("avg_intra_cluster_similarity")
    )


def _long(one_row: DataFrame) -> DataFrame:
    return one_row.select([F.col(c).cast("double").alias(c) for c in one_row.columns]).unpivot(
        [], one_row.columns, "metric", "value"
    )


def evaluate(
    df: DataFrame,
    method: str | None = None,
    label_col: str = "cluster_id",
    id_col: str = "id",
    item_col: str = "item",
    centers: DataFrame | None = None,
    noise: str = "drop",
) -> DataFrame:
    """``(metric, value)`` rows for one assignment.

    Silhouette, Davies-Bouldin, Calinski-Harabasz and sizes always; inertia for
    ``"kmeans"``, pair similarity for ``"butina"``, spread of the picks for
    ``"maxmin"`` (picks are the rows labelled 0 and above).
    """
    labelled = _labelled(df, label_col, id_col, item_col, noise)
    names = {"label_col": "label", "id_col": "id", "item_col": "item"}
    parts = [
        _silhouette(labelled, None),
        _davies_bouldin(labelled, None),
        _calinski_harabasz(labelled),
        cluster_sizes(labelled, "label"),
    ]
    if method == "kmeans":
        parts.append(inertia(labelled, centers, **names))
    elif method == "butina":
        parts.append(intra_similarity(labelled, **names))
    elif method == "maxmin":
        parts.append(selection_spread(df, df.filter(F.col(label_col) >= 0), "euclidean", id_col, item_col))
    elif method is not None and method != "density":
        raise ValueError(f"unknown method {method!r}")
    out = _long(parts[0])
    for part in parts[1:]:
        out = out.unionByName(_long(part))
    return out.filter("value IS NOT NULL")
