"""Mini-batch k-means for large tables and very many clusters: rows, candidates and centres stay tables."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverset.functions.metrics import as_items
from coverset.operators.assignment import dense_index, seeded_order
from coverset.operators.nearest import assign_to_centers
from coverset.operators.representatives import label_means
from coverset.session import checkpoint_dir, discard, materialise

# Rounds of the parallel start, and candidates drawn in each for every centre.
SEED_ROUNDS, OVERSAMPLE = 4, 2.0
# So few candidates (counted) are reduced to centres by weighted k-means++ in one local pass.
LOCAL_CANDIDATES = 20_000
# Rows of a batch: so many for each centre, at least the least, and the table in at most so many batches.
ROWS_A_CENTER, LEAST_BATCH, MOST_BATCHES = 20, 1_000, 100
# Batches without a better smoothed cost before the end.
PATIENCE = 10


def uniform(seed: int, step: int | Column, id_col: str = "id") -> Column:
    """A number in (0, 1) that depends on seed, step and id alone."""
    part = F.lit(step) if isinstance(step, int) else step
    return (F.pmod(F.xxhash64(F.lit(seed), part, id_col), F.lit(2**52)) + 0.5) / float(2**52)


def _plus_plus(candidates: DataFrame, k: int, seed: int) -> list[int]:
    """Ids of ``k`` of a checked small table ``(id, item, weight)``, drawn by weight times squared distance."""
    held = candidates.orderBy("id").toArrow()
    ids, weight = held["id"].to_numpy(), held["weight"].to_numpy().astype(float)
    x = np.array(held["item"].to_pylist(), dtype=float)
    rng = np.random.default_rng(seed)
    far, picked = np.full(len(ids), np.inf), []
    chance = weight
    for _ in range(min(k, len(ids))):
        total = chance.sum()
        at = int(np.searchsorted(np.cumsum(chance), rng.random() * total)) if total > 0 else int(np.flatnonzero(far > -1)[0])
        at = min(at, len(ids) - 1)
        picked.append(at)
        far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
        far[at] = -1.0  # taken
        chance = weight * np.maximum(far, 0.0)
    return ids[picked].tolist()


def seed_centers(
    items: DataFrame, k: int, seed: int = 42, rounds: int = SEED_ROUNDS, oversample: float = OVERSAMPLE, local: int = LOCAL_CANDIDATES
) -> DataFrame:
    """``(cluster_id, center)``: ``k`` distinct rows of durable ``items`` ``(id, item)``, spread over the data.

    The parallel k-means++ start: in each round a row becomes a candidate with a
    chance proportional to its squared distance from the candidates so far, and
    every row then looks for its nearest candidate among the new ones only. Each
    candidate weighs the rows that are nearest to it. Up to ``local`` candidates
    are reduced by weighted k-means++; more by a weighted draw without
    replacement over the table, so that ``k`` centres never meet in one place.
    Draws depend on seed and ids, not on the partitioning. Fewer distinct rows
    than ``k`` give as many centres.
    """
    distinct = materialise(items.groupBy("item").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "item", "copies"))
    n = distinct.limit(k + 1).count()
    if n <= k:
        chosen = distinct.select("id", F.col("item").alias("center"))
        return materialise(dense_index(chosen, [F.col("id")], "cluster_id").select("cluster_id", "center"))
    first = distinct.orderBy(*seeded_order("id", seed)).limit(1)
    fresh = materialise(first.select("id", "item"))
    candidates = fresh
    near = None
    for step in range(rounds):
        found = assign_to_centers(distinct, fresh, center_id_col="id", center_col="item").select("id", F.col("cluster_id").alias("to"), "dist")
        if near is not None:
            older = near.select("id", F.col("to").alias("to0"), F.col("dist").alias("dist0"))
            closer = F.col("dist") < F.col("dist0")
            found = found.join(older, "id").select("id", F.when(closer, F.col("to")).otherwise(F.col("to0")).alias("to"), F.least("dist", "dist0").alias("dist"))
        now = materialise(found.join(distinct.select("id", "copies"), "id"))
        if near is not None:
            discard(near)
        near = now.select("id", "to", "dist", "copies")
        cost = near.agg(F.sum(F.col("copies") * F.col("dist") * F.col("dist"))).first()[0] or 0.0
        if cost <= 0:
            break
        chance = F.lit(oversample * k / cost) * F.col("copies") * F.col("dist") * F.col("dist")
        drawn = near.filter((F.col("dist") > 0) & (uniform(seed, step) < chance)).select("id")
        fresh = materialise(distinct.join(drawn, "id").select("id", "item"))
        if fresh.isEmpty():
            break
        candidates = candidates.unionByName(fresh)
    candidates = materialise(candidates)
    count = candidates.count()
    if count < k:
        # Too few were drawn: other rows follow in seeded order.
        others = distinct.select("id", "item").join(candidates.select("id"), "id", "left_anti")
        extra = dense_index(others, seeded_order("id", seed)).filter(F.col("index") < k - count).select("id", "item")
        candidates = materialise(candidates.unionByName(extra))
        chosen = candidates
    else:
        owners = assign_to_centers(distinct, candidates, center_id_col="id", center_col="item").join(distinct.select("id", "copies"), "id")
        weights = owners.groupBy(F.col("cluster_id").alias("id")).agg(F.sum("copies").alias("weight"))
        weighed = materialise(candidates.join(weights, "id"))
        if count <= local:
            picked = items.sparkSession.createDataFrame([(i,) for i in _plus_plus(weighed, k, seed)], "id long")
            chosen = weighed.join(F.broadcast(picked), "id")  # at most as many as candidates, which were counted
        else:
            race = -F.log(uniform(seed, -1)) / F.col("weight")
            chosen = dense_index(weighed.withColumn("race", race), [F.col("race"), F.col("id")]).filter(F.col("index") < k)
    named = dense_index(chosen.select("id", F.col("item").alias("center")), [F.col("id")], "cluster_id")
    return materialise(named.select(F.col("cluster_id").cast("long").alias("cluster_id"), "center"))


def minibatch_centers(
    items: DataFrame,
    start: DataFrame,
    batch_rows: int | None = None,
    max_batches: int = 100,
    seed: int = 42,
    patience: int = PATIENCE,
) -> DataFrame:
    """``(cluster_id, center)`` after mini-batch updates from ``start``.

    The table is written once in batches by a hash of the id, so a step reads
    its batch alone. A step assigns the batch (centres are sent to the tasks if
    measured to be small, else searched by a pivot tree) and moves every centre
    towards the mean of its rows by their share of all rows it has had so far.
    A centre without rows stays. It ends after ``max_batches`` steps, or when the smoothed
    cost of a row has not fallen for ``patience`` steps.
    """
    spark = items.sparkSession
    n, k = items.count(), start.count()
    size = batch_rows or max(LEAST_BATCH, ROWS_A_CENTER * k)
    batches = max(1, min(MOST_BATCHES, n // size))
    path = os.path.join(checkpoint_dir(spark), f"coverset-{uuid.uuid4().hex}")
    dealt = items.select("id", "item", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(batches)).cast("int").alias("batch"))
    dealt.write.partitionBy("batch").parquet(path)
    stored = spark.read.parquet(path)
    now = materialise(start.select("cluster_id", "center", F.lit(0).cast("long").alias("seen")))
    mean = F.zip_with("center", "mean", lambda c, m: c + (m - c) * F.col("n") / (F.col("seen") + F.col("n")))
    smooth, best, waited = None, float("inf"), 0
    for step in range(max_batches):
        rows = stored.filter(F.col("batch") == step % batches).select("id", "item")
        placed = materialise(assign_to_centers(rows, now).select("id", F.col("cluster_id").alias("label"), "dist"))
        cost = placed.agg(F.avg(F.col("dist") * F.col("dist"))).first()[0]
        if cost is None:
            continue  # an empty batch
        sums = label_means(rows.join(placed.select("id", "label"), "id")).select(F.col("label").alias("cluster_id"), "n", "mean")
        moved = now.join(sums, "cluster_id", "left").select(
            "cluster_id", F.when(F.col("n").isNull(), F.col("center")).otherwise(mean).alias("center"), (F.col("seen") + F.coalesce("n", F.lit(0))).alias("seen")
        )
        fresh = materialise(moved)
        discard(now)
        discard(placed)
        now = fresh
        share = min(1.0, 2.0 * size / (n + 1))
        smooth = cost if smooth is None else smooth * (1 - share) + cost * share
        waited = 0 if smooth < best else waited + 1
        best = min(best, smooth)
        if waited >= patience:
            break
    return now.select("cluster_id", "center")


def minibatch_kmeans(
    df: DataFrame,
    k: int,
    batch_rows: int | None = None,
    max_batches: int = 100,
    seed: int = 42,
    id_col: str = "id",
    item_col: str = "item",
    start: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, float]:
    """``(assignment, centers, cost)`` of mini-batch k-means; every row gets its nearest centre at the end."""
    items = materialise(as_items(df, id_col, item_col, "euclidean"))
    if items.isEmpty():
        raise ValueError("no usable rows to cluster")
    begin = seed_centers(items, k, seed) if start is None else start.select(F.col("cluster_id").cast("long").alias("cluster_id"), "center")
    centers = minibatch_centers(items, begin, batch_rows, max_batches, seed)
    placed = materialise(assign_to_centers(items, centers))
    cost = placed.agg(F.sum(F.col("dist") * F.col("dist"))).first()[0]
    return placed.select("id", "cluster_id"), centers, float(cost or 0.0)
