"""Principal components of wide, sparse rows: a range finder by distributed products, no d x d matrix anywhere."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.session import materialise

# Columns beyond the wanted components, products with the covariance, and rows multiplied at a time.
EXTRA, ROUNDS, TILE = 16, 8, 1024
# Rows of a product that travel as one record.
STRIPE = 256


def _dense(column: pa.Array, width: int, sparse: bool) -> np.ndarray:
    """Rows as a dense tile: values, or ones at the listed positions."""
    offsets = column.offsets.to_numpy()
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    if not sparse:
        return flat.reshape(len(column), width).astype(np.float64, copy=False)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), np.diff(offsets)), flat] = 1.0
    return out


def _summed(items: DataFrame, compute, rows: int, columns: int) -> np.ndarray:
    """Sum over all rows of the ``rows x columns`` matrices that ``compute`` makes of tiles.

    A task adds up its own tiles and gives stripes of the sum, which are added
    up by stripe; the result is a matrix of the stated size, whatever the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                total += compute(batch.column(0).slice(at, TILE))
        stripes = list(range(0, rows, STRIPE))
        values = [total[s : s + STRIPE].reshape(-1) for s in stripes]
        ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(stripes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))], names=["stripe", "v"])

    def add(group: pa.Table) -> pa.Table:
        flat = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        total = flat.reshape(group.num_rows, -1).sum(0)
        return pa.table({"stripe": group["stripe"][:1], "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = items.mapInArrow(run, "stripe long, v array<double>").groupBy("stripe").applyInArrow(add, "stripe long, v array<double>")
    out = np.zeros((rows, columns))
    for r in parts.collect():
        out[r.stripe : r.stripe + STRIPE] = np.array(r.v).reshape(-1, columns)
    return out


@dataclass
class RangePCA:
    """Fitted components ``[width, k]``, the mean and the shares of the variance."""

    width: int
    sparse: bool
    mean: np.ndarray
    components: np.ndarray
    ratios: list[float]

    def transform(self, df: DataFrame, item_col: str = "item", name: str = "features") -> DataFrame:
        """Adds the projected rows as ``array<double>``, batch by batch; null rows stay null. Works on streams too."""
        width, sparse, place, shift = self.width, self.sparse, self.components, self.mean @ self.components

        @F.pandas_udf("array<double>")
        def project(rows):
            out, held = [None] * len(rows), [k for k, r in enumerate(rows) if r is not None]
            for at in range(0, len(held), TILE):
                some = held[at : at + TILE]
                kind = pa.list_(pa.int32() if sparse else pa.float64())
                made = _dense(pa.array([rows.iloc[k] for k in some], kind), width, sparse) @ place - shift
                for k, row in zip(some, made):
                    out[k] = row.tolist()
            return type(rows)(out)

        return df.withColumn(name, project(F.col(item_col).cast("array<int>" if sparse else "array<double>")))


def range_pca(df: DataFrame, k: int, width: int, sparse: bool = False, item_col: str = "item", rounds: int = ROUNDS, extra: int = EXTRA, seed: int = 42) -> RangePCA:
    """Leading ``k`` principal components of rows of ``width`` values.

    ``sparse`` rows list the positions that are 1 (as fingerprints do), and are
    made dense one tile at a time. A random basis of ``k + extra`` columns is
    multiplied with the covariance ``rounds`` times: each product is one pass
    whose tasks send ``width x (k + extra)`` numbers, instead of the square of
    the width. With ``k + extra >= width`` the result is exact. Components have
    their largest value positive. Null rows are left out; an empty table is an error.
    """
    kind = "array<int>" if sparse else "array<double>"
    items = materialise(df.select(F.col(item_col).cast(kind).alias("item")).filter("item IS NOT NULL"))
    n = items.count()
    if n == 0:
        raise ValueError("no rows to reduce")
    sums = _summed(items, lambda c: np.stack([(x := _dense(c, width, sparse)).sum(0), (x * x).sum(0)], 1), width, 2)
    mean = sums[:, 0] / n
    spread = float((sums[:, 1] - n * mean * mean).sum())
    size = min(width, k + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]

    def product(basis: np.ndarray) -> np.ndarray:
        def tile(c: pa.Array) -> np.ndarray:
            x = _dense(c, width, sparse) - mean
            return x.T @ (x @ basis)

        return _summed(items, tile, width, size)

    made = product(basis)
    for _ in range(0 if size == width else rounds):
        basis = np.linalg.qr(made)[0]
        made = product(basis)
    values, turn = np.linalg.eigh((basis.T @ made + made.T @ basis) / 2.0)
    order = np.argsort(-values)[:k]
    components = basis @ turn[:, order]
    components *= np.where(components[np.abs(components).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    return RangePCA(width, sparse, mean, components, [float(v) / spread if spread > 0 else 0.0 for v in np.maximum(values[order], 0.0)])
