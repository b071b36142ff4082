"""Scoring of arriving rows against fitted results. Nothing here keeps state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coverset.functions.metrics import as_items
from coverset.operators.nearest import _broadcast_nearest, nearest, small_refs
from coverset.operators.reduction import Reducer
from coverset.session import BROADCAST_BYTES


def reduce_stream(stream: DataFrame, reducer: Reducer, name: str | None = None) -> DataFrame:
    """Apply a fitted scaler and PCA to a stream."""
    return reducer.transform(stream, name)


def assign_stream(
    stream: DataFrame,
    centers: DataFrame,
    threshold: float,
    metric: str = "euclidean",
    id_col: str = "id",
    item_col: str = "item",
    center_id_col: str = "cluster_id",
    center_col: str = "center",
) -> DataFrame:
    """``(id, cluster_id, dist, is_far)`` of arriving rows: nearest centre and whether it is beyond ``threshold``.

    Stateless and map-only, so it runs on a stream as on a table. The centres
    must be few enough to send to every task; with more of them use
    ``assign_batches``, which joins each micro-batch by cells.
    """
    items = as_items(stream, id_col, item_col, metric)
    points = as_items(centers, center_id_col, center_col, metric)
    table = small_refs(points, BROADCAST_BYTES)
    if table is None:
        raise ValueError("too many centres to send to every task: use assign_batches")
    found = _broadcast_nearest(items, table, metric, ["id"])
    return _flagged(found, threshold)


def _flagged(found: DataFrame, threshold: float) -> DataFrame:
    return found.select("id", F.col("ref_id").alias("cluster_id"), "dist", (F.col("dist") > threshold).alias("is_far"))


def assign_batches(
    stream: DataFrame,
    centers: DataFrame,
    threshold: float,
    path: str,
    checkpoint: str,
    metric: str = "euclidean",
    id_col: str = "id",
    item_col: str = "item",
    center_id_col: str = "cluster_id",
    center_col: str = "center",
) -> StreamingQuery:
    """Like ``assign_stream`` for any number of centres, written to ``path`` per micro-batch.

    A batch replaces its own ``batch=<n>`` folder, so a retried one is not doubled.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = nearest(batch, centers, metric, id_col, item_col, center_id_col, center_col)
        _flagged(found, threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
