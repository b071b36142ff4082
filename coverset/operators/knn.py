"""The k nearest other rows of every row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverset.functions.metrics import as_items, metric_named
from coverset.operators.cells import MAX_BLOCK, OneCell, blocked
from coverset.operators.pivots import grow, prunes
from coverset.session import materialise

PAIR = "id long, other long, dist double"


def nearest_k_in_block(m, x: pa.Table, y: pa.Table, k: int) -> dict:
    """Up to ``k`` nearest other rows per left row, ties to the lowest id."""
    a, b = m.load(x["item"]), m.load(y["item"])
    ids, others = x["id"].to_numpy(), y["id"].to_numpy()
    near = m.matrix(a, b)
    near[ids[:, None] == others[None, :]] = np.inf
    take = min(k, len(others))
    limit = np.partition(near, take - 1, axis=1)[:, take - 1:take]
    i, j = np.nonzero((near <= limit + 2.0 * m.slack(a, b)) & np.isfinite(near))
    d = near[i, j] if m.name == "tanimoto" else m.exact(a, b, i, j)
    order = np.lexsort((others[j], d, i))
    i, j, d = i[order], j[order], d[order]
    starts = np.searchsorted(i, i, side="left")
    keep = np.arange(len(i)) - starts < k
    return {"id": ids[i[keep]], "other": others[j[keep]], "dist": d[keep]}


def _shorter(k: int):
    """The ``k`` best of the rows that several blocks found."""

    def run(made: pa.Table) -> pa.Table:
        ids, others, d = (made[c].to_numpy() for c in ("id", "other", "dist"))
        order = np.lexsort((others, d, ids))
        ids = ids[order]
        return made.take(order[np.arange(len(ids)) - np.searchsorted(ids, ids, side="left") < k])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """Merge block results; Spark cuts each group to ``k`` before the shuffle."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "other")))
    return ranked.filter(F.col("rank") <= k)


def k_nearest(
    df: DataFrame,
    k: int,
    metric: str = "euclidean",
    id_col: str = "id",
    item_col: str = "item",
    block_rows: int | None = None,
) -> DataFrame:
    """``(id, other, dist, rank)``: exact ``k`` nearest other rows, rank from 1.

    Larger inputs are cut into the leaves of a pivot tree. A row first searches
    its own leaf; the distance of its ``k``-th find there, or of the ``k``-th
    nearest pivot on its way, limits which other leaves can still hold a nearer
    row.
    """
    m = metric_named(metric)
    items = as_items(df, id_col, item_col, metric)

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        return pa.table(nearest_k_in_block(m, x, y, k))

    # Cosine distance is no metric; its bounds would not hold for nearest rows.
    items = items if metric == "cosine" else materialise(items)
    tree = None if metric == "cosine" else grow(items, m, block_rows or MAX_BLOCK)

    def everywhere() -> DataFrame:
        cell = OneCell()
        return _best(blocked(cell.left(items), cell.right(items), kernel, PAIR, True, block_rows, True, combine=_shorter(k)), k)

    if tree is None:
        return everywhere()
    # One more, as the row itself may be a pivot.
    placed = materialise(tree.home(items, nearest_of=k + 1))
    plain = placed.select("cell", "id", "item")
    own = materialise(_best(blocked(plain, plain, kernel, PAIR, False, block_rows, combine=_shorter(k)), k))
    found = own.groupBy("id").agg(F.max("dist").alias("last"), F.count("*").alias("n"))
    limits = found.select("id", F.when(F.col("n") >= k, F.col("last")).alias("last"))
    asking = placed.select("id", "item", F.col("cell").alias("own"), "limit").join(limits, "id", "left")
    asking = asking.withColumn("limit", F.least("limit", F.coalesce("last", F.lit(float("inf"))))).drop("last")
    asking = materialise(asking)
    if not prunes(tree, asking, items.count(), block_rows or MAX_BLOCK):
        return everywhere()
    asked = tree.visit(asking).filter(F.col("cell") != F.col("own")).select("cell", "id", "item")
    return _best(own.select("id", "other", "dist").unionByName(blocked(asked, plain, kernel, PAIR, False, block_rows, combine=_shorter(k))), k)
