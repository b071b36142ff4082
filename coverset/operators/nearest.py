"""Nearest reference of every row, and similarity to every reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from coverset.functions.metrics import SizedSets, as_items, metric_named, unpack_sets
from coverset.operators.cells import MAX_BLOCK, OneCell, blocked, packed, row_bytes
from coverset.operators.pivots import grow, prunes
from coverset.session import BROADCAST_BYTES, materialise

TILE = 2048


def small_refs(refs: DataFrame, limit: int) -> pa.Table | None:
    """The reference table itself when its measured size is under ``limit`` bytes."""
    size = refs.agg(F.sum(F.size("item") * 8 + 24).alias("bytes")).first()["bytes"] or 0
    return refs.toArrow() if size <= limit else None


def small_sets(refs: DataFrame, limit: int) -> SizedSets | None:
    """The reference sets as bitmaps when they are under ``limit`` bytes so."""
    size = refs.agg(F.sum(row_bytes(refs)).alias("bytes")).first()["bytes"] or 0
    if not 0 < size <= limit:
        return None
    table, m = packed(refs).toArrow().combine_chunks(), metric_named("tanimoto")
    parts = [m.load(unpack_sets(table["item"].slice(lo, TILE))) for lo in range(0, table.num_rows, TILE)]
    return SizedSets(parts, table["id"].to_numpy()) if all(map(SizedSets.fits, parts)) else None


def best_in_block(m, a, b, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least distance and its reference per row of ``a``; ties to the lowest id."""
    if m.name == "tanimoto" and SizedSets.fits(b):
        return SizedSets([b], ids).nearest(a)
    rows = len(a)
    best = np.full(rows, np.inf)
    who = np.full(rows, np.iinfo(np.int64).max)
    for lo in range(0, len(ids), TILE):
        part = m.take(b, np.arange(lo, min(lo + TILE, len(ids))))
        part_ids = ids[lo:lo + TILE]
        near = m.matrix(a, part)
        if m.name == "tanimoto":
            i, j = np.nonzero(near == near.min(1, keepdims=True))
            d = near[i, j]
        else:
            i, j = np.nonzero(near <= near.min(1, keepdims=True) + 2.0 * m.slack(a, part))
            d = m.exact(a, part, i, j)
        order = np.lexsort((part_ids[j], d, i))
        first = order[np.unique(i[order], return_index=True)[1]]
        d, ref = d[first], part_ids[j[first]]
        better = (d < best) | ((d == best) & (ref < who))
        best[better], who[better] = d[better], ref[better]
    return best, who


def _nearer(made: pa.Table) -> pa.Table:
    """The nearest of the references that several blocks found."""
    ids = made["id"].to_numpy()
    order = np.lexsort((made["ref_id"].to_numpy(), made["dist"].to_numpy(), ids))
    return made.take(order[np.unique(ids[order], return_index=True)[1]])


def _broadcast_nearest(items: DataFrame, refs: pa.Table | SizedSets, metric: str, keep: list[str]) -> DataFrame:
    m = metric_named(metric)
    shared = items.sparkSession.sparkContext.broadcast(refs)
    fields = [f for f in items.schema.fields if f.name in keep]
    schema = StructType(fields + [StructField("ref_id", LongType()), StructField("dist", DoubleType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if not isinstance(held, SizedSets):
            b, ids = m.load(held["item"]), held["id"].to_numpy()
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                part = batch.slice(lo, TILE)
                a = m.load(part.column("item"))
                best, who = held.nearest(a) if isinstance(held, SizedSets) else best_in_block(m, a, b, ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(name) for name in keep] + [pa.array(who), pa.array(best)],
                    names=keep + ["ref_id", "dist"],
                )

    return items.mapInArrow(search, schema)


def _pivot_nearest(items: DataFrame, refs: DataFrame, metric: str, block_rows: int | None) -> DataFrame:
    """Both sides partitioned: a row visits only the cells that can hold its nearest."""
    m = metric_named(metric)
    # Cosine distance is no metric; its bounds would not hold for nearest rows.
    tree = None if m.name == "cosine" else grow(materialise(refs), m, block_rows or MAX_BLOCK)
    if tree is not None:
        # The nearest pivot on the way home is itself a reference: an upper bound.
        bounded = materialise(tree.home(items, nearest_of=1).drop("cell"))
        if not prunes(tree, bounded, refs.count(), block_rows or MAX_BLOCK):
            tree = None
    single = tree is None
    if single:
        left, right = OneCell().left(items), OneCell().right(refs)
    else:
        left, right = tree.visit(bounded).drop("limit"), materialise(tree.home(refs))

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        best, who = best_in_block(m, m.load(x["item"]), m.load(y["item"]), y["id"].to_numpy())
        return pa.table({"id": x["id"], "dist": best, "ref_id": who})

    found = blocked(left, right, kernel, "id long, dist double, ref_id long", single, block_rows, single, combine=_nearer)
    return (
        found.groupBy("id")
        .agg(F.min(F.struct("dist", "ref_id")).alias("best"))
        .select("id", "best.ref_id", "best.dist")
    )


def nearest(
    df: DataFrame,
    refs: DataFrame,
    metric: str = "tanimoto",
    id_col: str = "id",
    item_col: str = "item",
    ref_id_col: str | None = None,
    ref_item_col: str | None = None,
    broadcast_limit: int = BROADCAST_BYTES,
    block_rows: int | None = None,
) -> DataFrame:
    """``(id, ref_id, dist)``: the nearest reference of every row, ties to the lowest id.

    References whose measured size (of sets: as bitmaps) is under ``broadcast_limit`` bytes
    are sent to every task and the scan stays map-only. More references are joined by cells.
    """
    items = as_items(df, id_col, item_col, metric)
    points = as_items(refs, ref_id_col or id_col, ref_item_col or item_col, metric)
    if metric == "tanimoto" and (sets := small_sets(points, broadcast_limit)) is not None:
        return _broadcast_nearest(items, sets, metric, ["id"])
    table = small_refs(points, broadcast_limit)
    if table is None:
        return _pivot_nearest(items, points, metric, block_rows)
    if table.num_rows == 0:
        return items.limit(0).select("id", F.lit(0).cast("long").alias("ref_id"), F.lit(0.0).alias("dist"))
    return _broadcast_nearest(items, table, metric, ["id"])


def assign_to_centers(
    df: DataFrame,
    centers: DataFrame,
    metric: str = "euclidean",
    id_col: str = "id",
    item_col: str = "item",
    center_id_col: str = "cluster_id",
    center_col: str = "center",
) -> DataFrame:
    """``(id, cluster_id, dist)`` of the nearest centre."""
    found = nearest(df, centers, metric, id_col, item_col, center_id_col, center_col)
    return found.withColumnRenamed("ref_id", "cluster_id")


def reference_space_long(
    df: DataFrame,
    refs: DataFrame,
    metric: str = "tanimoto",
    id_col: str = "id",
    item_col: str = "item",
    ref_id_col: str | None = None,
    ref_item_col: str | None = None,
    broadcast_limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, ref_id, value)`` for every row and reference.

    ``value`` is a similarity for tanimoto and cosine and a distance for
    euclidean. The output has one record per row and reference by definition.
    """
    m = metric_named(metric)
    items = as_items(df, id_col, item_col, metric)
    points = as_items(refs, ref_id_col or id_col, ref_item_col or item_col, metric)

    def pairs(ids, a, ref_ids, b):
        values = m.matrix(a, b) if metric == "euclidean" else m.similarity(a, b)
        return {
            "id": np.repeat(ids, len(ref_ids)),
            "ref_id": np.tile(ref_ids, len(ids)),
            "value": values.reshape(-1),
        }

    schema = "id long, ref_id long, value double"
    table = small_refs(points, broadcast_limit)
    if table is None:
        def kernel(x, y):
            return pa.table(pairs(x["id"].to_numpy(), m.load(x["item"]), y["id"].to_numpy(), m.load(y["item"])))

        return blocked(OneCell().left(items), OneCell().right(points), kernel, schema, one_cell=True)
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        b, ref_ids = m.load(shared.value["item"]), shared.value["id"].to_numpy()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                a, ids = m.load(part.column("item")), part.column("id").to_numpy()
                for at in range(0, len(ref_ids), TILE):
                    some = np.arange(at, min(at + TILE, len(ref_ids)))
                    yield pa.RecordBatch.from_pydict(pairs(ids, a, ref_ids[some], m.take(b, some)))

    return items.mapInArrow(run, schema)


# Values of the reference space that a task holds at a time.
SPACE_VALUES = 1 << 22


def _space_rows(items: DataFrame, refs: pa.Table, metric: str) -> DataFrame:
    """``(id, features)`` map-side: some rows against one tile of references after the other, straight into the array."""
    m = metric_named(metric)
    shared = items.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, n = m.load(shared.value["item"]), shared.value.num_rows
        rows = max(1, min(TILE, SPACE_VALUES // max(n, 1)))
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                a = m.load(part.column("item"))
                out = np.empty((part.num_rows, n))
                for at in range(0, n, TILE):
                    some = m.take(b, np.arange(at, min(at + TILE, n)))
                    out[:, at : at + TILE] = m.matrix(a, some) if metric == "euclidean" else m.similarity(a, some)
                ends = pa.array(np.arange(0, out.size + 1, n, dtype=np.int32) if n else np.zeros(part.num_rows + 1, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], names=["id", "features"])

    return items.select("id", "item").mapInArrow(run, "id long, features array<double>")


def reference_space(
    df: DataFrame,
    refs: DataFrame,
    metric: str = "tanimoto",
    id_col: str = "id",
    item_col: str = "item",
    ref_id_col: str | None = None,
    ref_item_col: str | None = None,
    rescale: bool = False,
    broadcast_limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, features)``: similarity to each reference, in reference id order.

    References under ``broadcast_limit`` bytes are sent to every task, which
    writes the rows' arrays itself: nothing is shuffled. Repeated ids are a row each time then.

    With ``metric="euclidean"`` similarities are distances rescaled over the
    whole result, ``1 - d / max(d)``; for the other metrics ``rescale`` does the
    same with ``1 - similarity``.
    """
    items = as_items(df, id_col, item_col, metric)
    points = as_items(refs, ref_id_col or id_col, ref_item_col or item_col, metric)
    table = small_refs(points, broadcast_limit)
    if table is not None:
        wide = _space_rows(items, table.sort_by("id"), metric)
    else:
        long = reference_space_long(df, refs, metric, id_col, item_col, ref_id_col, ref_item_col, broadcast_limit)
        wide = long.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ref_id", "value"))).alias("pairs"))
        wide = wide.select("id", F.transform("pairs", lambda p: p["value"]).alias("features"))
    if metric != "euclidean" and not rescale:
        return wide
    if metric != "euclidean":
        wide = wide.withColumn("features", F.transform("features", lambda x: 1.0 - x))
    wide = materialise(wide)
    top = wide.agg(F.max(F.array_max("features"))).first()[0] or 0.0
    scaled = (lambda d: 1.0 - d / F.lit(float(top))) if top > 0 else (lambda d: F.lit(1.0))
    return wide.withColumn("features", F.transform("features", scaled))
