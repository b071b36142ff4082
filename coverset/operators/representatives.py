"""One representative row per cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.functions.metrics import as_items, metric_named
from coverset.operators.cells import blocked, opened, packed, summed
from coverset.session import lookup_join, materialise

# Rows of a cluster that is summed beside others, and rows whose pairs are held at a time.
SMALL, SMALL_ROWS = 64, 8192

RULES = ("first", "random", "medoid", "nearest_center", "nearest_mean")


def labelled_items(
    df: DataFrame, label_col: str, id_col: str, item_col: str, metric: str, noise: str = "drop"
) -> DataFrame:
    """``(id, item, label)``; ``noise="drop"`` leaves out rows labelled -1."""
    m = metric_named(metric)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(item_col).cast(m.item_type).alias("item"),
        F.col(label_col).cast("long").alias("label"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & m.usable(F.col("item")))
    if noise == "drop":
        return rows.filter("label >= 0")
    if noise != "as_cluster":
        raise ValueError(f"unknown noise rule {noise!r}")
    return rows


def label_means(labelled: DataFrame) -> DataFrame:
    """``(label, n, mean)`` with map-side combining, so a hot label costs one record per task."""
    vectors = labelled.select("label", array_to_vector("item").alias("v"))
    return vectors.groupBy("label").agg(F.count("*").alias("n"), Summarizer.mean(F.col("v")).alias("m")).select(
        "label", "n", vector_to_array("m").alias("mean")
    )


def _equal_ids(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of equal ids."""
    order = np.argsort(two, kind="stable")
    first, last = np.searchsorted(two[order], one, "left"), np.searchsorted(two[order], one, "right")
    n = last - first
    i = np.repeat(np.arange(len(one)), n)
    return i, order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(i))]


def _small_sums(m):
    """Sums within the clusters of sorted rows; the clusters have at most ``SMALL`` rows, so all of a slice are done at once."""

    def sums(table: pa.Table) -> pa.Table:
        label, ids = table["label"].to_numpy(), table["id"].to_numpy()
        block = m.load(opened(table)["item"])
        starts = np.searchsorted(label, label, "left")
        n = np.searchsorted(label, label, "right") - starts
        total, others = np.zeros(len(label)), np.zeros(len(label), np.int64)
        for lo in range(0, len(label), SMALL_ROWS):
            rows = np.arange(lo, min(lo + SMALL_ROWS, len(label)))
            i = np.repeat(rows, n[rows])
            j = np.repeat(starts[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(len(i))
            keep = ids[i] != ids[j]
            i, j = i[keep], j[keep]
            others += np.bincount(i, minlength=len(label))
            total += np.bincount(i, weights=1.0 - m.exact(block, block, i, j), minlength=len(label))
        return pa.table({"id": ids, "label": label, "n": others, "total": total})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            held = here if held is None else pa.concat_tables([held, here])
            # The last cluster may go on in the next batch.
            whole = int(np.searchsorted(held["label"].to_numpy(), held["label"][-1].as_py(), "left")) if held.num_rows else 0
            if whole >= SMALL_ROWS:
                yield from sums(held.slice(0, whole)).to_batches()
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from sums(held).to_batches()

    return run


SUMS = "id long, label long, n long, total double"


def similarity_sums(labelled: DataFrame, metric: str, block_rows: int | None = None) -> DataFrame:
    """``(id, label, n_others, total)``: summed similarity to the other rows of the cluster.

    A cluster is cut into blocks and summed inside each block pair, in one
    order. Clusters of at most ``SMALL`` rows go to a task whole, many at a time.
    """
    m = metric_named(metric)

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = m.load(x["item"]), m.load(y["item"])
        ids, others = x["id"].to_numpy(), y["id"].to_numpy()
        mine, theirs = m.similarity_sums(a, b)
        if x["left_block"][0] != x["right_block"][0]:
            # Equal ids are in one block; this pair stands for its mirror image too.
            n = np.repeat([len(others), len(ids)], [len(ids), len(others)])
            label = np.full(len(n), x["cell"][0].as_py())
            return pa.table({"id": np.concatenate([ids, others]), "label": label, "n": n, "total": np.concatenate([mine, theirs])})
        i, j = _equal_ids(ids, others)
        n = len(others) - np.bincount(i, minlength=len(ids))
        own = np.bincount(i, weights=m.similarity_of(a, b, i, j), minlength=len(ids))
        return pa.table({"id": ids, "label": x["cell"], "n": n, "total": np.where(n > 0, mine - own, 0.0)})

    large = labelled.groupBy("label").agg(F.count("*").alias("rows")).filter(F.col("rows") > SMALL).select("label", F.lit(True).alias("is_large"))
    placed = lookup_join(labelled, materialise(large), "label", "id", bytes_per_row=16, how="left")
    side = placed.filter("is_large").select(F.col("label").alias("cell"), "id", "item")
    found = blocked(side, side, kernel, SUMS, False, block_rows, once=True, combine=summed(["id", "label"], ["n", "total"]))
    spark = labelled.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    few = packed(placed.filter("is_large IS NULL").select("label", "id", "item"))
    found = found.unionByName(few.repartition(parts, "label").sortWithinPartitions("label").mapInArrow(_small_sums(m), SUMS))
    return found.groupBy("id", "label").agg(F.sum("n").alias("n_others"), F.sum("total").alias("total"))


def medoids(
    df: DataFrame,
    metric: str = "tanimoto",
    label_col: str = "cluster_id",
    id_col: str = "id",
    item_col: str = "item",
    block_rows: int | None = None,
) -> DataFrame:
    """``(cluster_id, id, score)``: the member with the highest mean similarity to the others.

    Means within 1e-9 tie and go to the lowest id; a single member scores null.
    """
    labelled = materialise(labelled_items(df, label_col, id_col, item_col, metric))
    sums = similarity_sums(labelled, metric, block_rows)
    scored = sums.withColumn("score", F.when(F.col("n_others") > 0, F.col("total") / F.greatest("n_others", F.lit(1))))
    key = F.struct(F.round(F.coalesce("score", F.lit(0.0)), 9), -F.col("id"))
    return (
        scored.groupBy(F.col("label").alias("cluster_id"))
        .agg(F.max_by(F.struct("id", "score"), key).alias("best"))
        .select("cluster_id", "best.id", "best.score")
    )


def nearest_to_centers(
    df: DataFrame,
    centers: DataFrame,
    label_col: str = "cluster_id",
    id_col: str = "id",
    item_col: str = "item",
    center_id_col: str = "cluster_id",
    center_col: str = "center",
) -> DataFrame:
    """``(cluster_id, id, dist)``: the member nearest to its own cluster's centre; ties to the lowest id."""
    labelled = labelled_items(df, label_col, id_col, item_col, "euclidean")
    points = centers.select(
        F.col(center_id_col).cast("long").alias("label"), F.col(center_col).cast("array<double>").alias("center")
    )
    dist = metric_named("euclidean").column(F.col("item"), F.col("center"))
    joined = lookup_join(labelled, points, "label", "id").select("label", "id", dist.alias("dist"))
    return (
        joined.groupBy(F.col("label").alias("cluster_id"))
        .agg(F.min(F.struct("dist", "id")).alias("best"))
        .select("cluster_id", "best.id", "best.dist")
    )


def nearest_to_means(
    df: DataFrame, label_col: str = "cluster_id", id_col: str = "id", item_col: str = "item"
) -> DataFrame:
    """``(cluster_id, id, dist)``: the member nearest to the mean of its cluster; noise is left out."""
    means = label_means(labelled_items(df, label_col, id_col, item_col, "euclidean"))
    means = materialise(means.select(F.col("label").alias("cluster_id"), F.col("mean").alias("center")))
    return nearest_to_centers(df, means, label_col, id_col, item_col)


def first_members(df: DataFrame, label_col: str = "cluster_id", id_col: str = "id", center_flag: str | None = None) -> DataFrame:
    """``(cluster_id, id)``: the flagged centre, else the lowest id."""
    later = ~F.col(center_flag) if center_flag else F.lit(True)
    rows = df.filter(F.col(label_col) >= 0)
    return (
        rows.groupBy(F.col(label_col).cast("long").alias("cluster_id"))
        .agg(F.min(F.struct(later.alias("later"), F.col(id_col).cast("long").alias("id"))).alias("best"))
        .select("cluster_id", "best.id")
    )


def random_members(df: DataFrame, seed: int = 42, label_col: str = "cluster_id", id_col: str = "id") -> DataFrame:
    """``(cluster_id, id)``: a member drawn by ``seed``, the same one every time."""
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return (
        df.filter(F.col(label_col) >= 0)
        .groupBy(F.col(label_col).cast("long").alias("cluster_id"))
        .agg(F.min(F.struct(ticket.alias("ticket"), F.col(id_col).cast("long").alias("id"))).alias("best"))
        .select("cluster_id", "best.id")
    )


def representatives(df: DataFrame, rule: str = "medoid", centers: DataFrame | None = None, **params) -> DataFrame:
    """``(cluster_id, id, ...)`` by one of the rules in ``RULES``."""
    if rule == "first":
        return first_members(df, **params)
    if rule == "random":
        return random_members(df, **params)
    if rule == "medoid":
        return medoids(df, **params)
    if rule == "nearest_center":
        if centers is None:
            raise ValueError("rule 'nearest_center' needs centers")
        return nearest_to_centers(df, centers, **params)
    if rule == "nearest_mean":
        return nearest_to_means(df, **params)
    raise ValueError(f"unknown rule {rule!r}; choose from {RULES}")
