"""K-means: on Spark ML, from given centres, and by mini-batches for large tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.functions.metrics import as_items
from coverset.operators.assignment import dense_index, seeded_order
from coverset.operators.minibatch import minibatch_kmeans
from coverset.operators.nearest import assign_to_centers
from coverset.operators.representatives import label_means
from coverset.session import discard, materialise

# Starts of which the best is kept below MINI_ROWS rows.
RESTARTS = 3
# From so many rows on k-means goes by mini-batches (a fixed value of the workload).
MINI_ROWS = 10_000
PARALLEL_FITS = 5


@dataclass
class KMeansResult:
    assignment: DataFrame  # id, cluster_id
    centers: DataFrame  # cluster_id, center
    cost: float
    model: object | None


def kmeans(
    df: DataFrame,
    k: int,
    seed: int = 42,
    max_iter: int = 100,
    restarts: int = RESTARTS,
    id_col: str = "id",
    item_col: str = "item",
    start: str = "parallel",
    mini_rows: int = MINI_ROWS,
) -> KMeansResult:
    """Euclidean k-means of all rows; rows keep their label in ``cluster_id``.

    Below ``mini_rows`` rows it is fitted from ``restarts`` seeds of the parallel
    k-means++ start and the lowest cost is kept. A larger table goes by
    mini-batches, whose centres stay a table however many there are.
    ``start="rows"`` begins with the first ``k`` rows in seeded order instead and
    repeats whole rounds (``kmeans_from``), which is the same on every cluster.
    """
    if start not in ("parallel", "rows"):
        raise ValueError(f"unknown start {start!r}")
    plain = as_items(df, id_col, item_col, "euclidean")
    if start == "rows":
        ranked = dense_index(plain.select("id", F.col("item").alias("center")), seeded_order("id", seed), "cluster_id").filter(F.col("cluster_id") < k)
        return kmeans_from(plain, ranked.select("cluster_id", "center"), max_iter)
    if plain.limit(mini_rows).count() >= mini_rows:
        return KMeansResult(*minibatch_kmeans(plain, k, None, max_iter, seed), None)
    items = plain.withColumn("vector", array_to_vector("item"))
    items = items.select("id", "vector").persist()
    n = items.count()
    if n == 0:
        raise ValueError("no usable rows to cluster")

    def fit(step: int):
        model = KMeans(
            featuresCol="vector", predictionCol="cluster_id", k=min(k, n), seed=seed + step, maxIter=max_iter
        ).fit(items)
        return float(model.summary.trainingCost), step, model

    # Independent starts share the cluster, like the folds of a cross-validation.
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        cost, _, model = min(pool.map(inheritable_thread_target(df.sparkSession)(fit), range(max(restarts, 1))), key=lambda r: r[:2])
    # One centre per cluster: k rows, made and held by the fitted model.
    centers = df.sparkSession.createDataFrame(
        [(c, [float(v) for v in center]) for c, center in enumerate(model.clusterCenters())],
        "cluster_id long, center array<double>",
    )
    source = plain.withColumn("vector", array_to_vector("item"))
    assignment = model.transform(source.select("id", "vector")).select("id", F.col("cluster_id").cast("long").alias("cluster_id"))
    items.unpersist()
    return KMeansResult(assignment, centers, cost, model)


def kmeans_from(
    df: DataFrame,
    centers: DataFrame,
    max_iter: int = 20,
    tol: float = 1e-12,
    id_col: str = "id",
    item_col: str = "item",
) -> KMeansResult:
    """Euclidean k-means from given starting centres ``(cluster_id, center)``.

    Rows and centres stay tables: each round assigns the rows (centres are
    broadcast only if measured to be small) and averages the clusters with
    map-side combining. A centre without rows stays where it is. It ends after
    ``max_iter`` rounds, or when no centre moves by more than the root of ``tol``.
    """
    items = materialise(as_items(df, id_col, item_col, "euclidean"))
    now = materialise(centers.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("center").cast("array<double>").alias("center")))
    mean = F.coalesce("mean", "center")
    moved = F.aggregate(F.zip_with("center", mean, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    for _ in range(max_iter):
        placed = assign_to_centers(items, now).select("id", F.col("cluster_id").alias("label"))
        means = label_means(items.join(placed, "id")).select(F.col("label").alias("cluster_id"), "mean")
        fresh = materialise(now.join(means, "cluster_id", "left").select("cluster_id", mean.alias("center"), moved.alias("moved")))
        discard(now)
        now = fresh.drop("moved")
        if fresh.filter(F.col("moved") > tol).isEmpty():
            break
    placed = materialise(assign_to_centers(items, now))
    cost = placed.agg(F.sum(F.col("dist") * F.col("dist"))).first()[0]
    return KMeansResult(placed.select("id", "cluster_id"), now, float(cost or 0.0), None)
