"""Distributions of properties, distances and similarities, as tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverset.functions.metrics import Bitmaps, as_items, metric_named
from coverset.operators.cells import OneCell, blocked, summed
from coverset.operators.nearest import reference_space_long
from coverset.operators.neighbours import copy_groups
from coverset.session import finite, materialise


def property_compare(df: DataFrame, subset: DataFrame, properties: list[str]) -> DataFrame:
    """``(property, source, n, mean, std)`` of the library and the subset, without null, NaN or infinite values.

    All properties of a side are summed in one scan.
    """
    def side(rows: DataFrame, source: str) -> DataFrame:
        values = [F.when(finite(F.col(p).cast("double")), F.col(p).cast("double")).alias(p) for p in properties]
        long = rows.select(*values).unpivot([], properties, "property", "value").filter("value IS NOT NULL")
        return long.select("property", F.lit(source).alias("source"), "value")

    both = side(df, "library").unionByName(side(subset, "subset"))
    return both.groupBy("property", "source").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def histogram_table(
    df: DataFrame,
    column: str,
    bins: int = 50,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """``(bin, lower, upper, n, density)`` over equal bins from ``low`` to ``high``.

    Bounds default to the least and greatest finite value; the last bin is
    closed on both sides. Every bin is listed, empty ones too.
    """
    spark = df.sparkSession
    values = df.select(F.col(column).cast("double").alias("x")).filter(finite("x"))
    if low is None or high is None:
        seen = values.agg(F.min("x"), F.max("x")).first()
        low = seen[0] if low is None else low
        high = seen[1] if high is None else high
    schema = "bin long, lower double, upper double, n long, density double"
    if low is None or high is None:
        return spark.createDataFrame([], schema)
    if high == low:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.width_bucket("x", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    counts = values.filter(F.col("x").between(low, high)).groupBy((at - 1).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    grid = spark.range(bins).withColumnRenamed("id", "bin")
    # Both other sides have at most `bins` rows.
    filled = grid.join(F.broadcast(counts), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    filled = filled.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")
    return filled.select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"),
        "n",
        F.when(F.col("total") > 0, F.col("n") / (F.col("total") * width)).otherwise(F.lit(0.0)).alias("density"),
    )


WIDE_POINTS = 64


def kde_table(df: DataFrame, column: str, points: int = 32, bandwidth: float | None = None, cut: float = 3.0) -> DataFrame:
    """``(point, x, density)``: Gaussian density curve on an even grid.

    The default bandwidth is Scott's rule, ``std * n^(-1/5)``; the grid reaches
    ``cut`` bandwidths past the extremes. A grid of up to ``WIDE_POINTS`` points
    is summed side by side in one scan; a finer one is exploded and combined
    map-side.
    """
    spark = df.sparkSession
    values = df.select(F.col(column).cast("double").alias("x")).filter(finite("x"))
    n, std, low, high = values.agg(F.count("*"), F.stddev_samp("x"), F.min("x"), F.max("x")).first()
    schema = "point long, x double, density double"
    h = bandwidth if bandwidth is not None else (std or 0.0) * n ** -0.2 if n else 0.0
    if not n or h <= 0:
        return spark.createDataFrame([], schema)
    start, stop = low - cut * h, high + cut * h
    grid = [start + (stop - start) * i / (points - 1) for i in range(points)]
    factor = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    if points > WIDE_POINTS:
        spread = values.select(F.col("x").alias("v"), F.posexplode(F.lit(grid)).alias("point", "x"))
        bump = F.exp(-0.5 * F.pow((F.col("v") - F.col("x")) / F.lit(h), F.lit(2.0)))
        return spread.groupBy(F.col("point").cast("long").alias("point"), "x").agg((F.sum(bump) * factor).alias("density"))
    sums = [
        F.sum(F.exp(-0.5 * F.pow((F.col("x") - F.lit(g)) / F.lit(h), F.lit(2.0)))).alias(f"p{i}") for i, g in enumerate(grid)
    ]
    cells = F.array(*[F.struct(F.lit(g).alias("x"), (F.col(f"p{i}") * factor).alias("density")) for i, g in enumerate(grid)])
    return values.agg(*sums).select(F.posexplode(cells).alias("point", "cell")).select(
        F.col("point").cast("long").alias("point"), "cell.x", "cell.density"
    )


# Codes of a shared and a joint count that are counted in an array.
MAX_CODES = 1 << 23


def _by_copies(copies: np.ndarray) -> list[np.ndarray]:
    """Positions of the items that are there once, and of the others."""
    return [rows for rows in (np.flatnonzero(copies == 1), np.flatnonzero(copies != 1)) if len(rows)]


def _weights(left: np.ndarray, right: np.ndarray, once: np.ndarray | None) -> np.ndarray | None:
    """Row pairs that each pair of items stands for, as marks where that is one or none; ``once`` marks the pairs that count."""
    if (left == 1).all() and (right == 1).all():
        return once
    both = left[:, None] * right[None, :].astype(float)
    return both if once is None else np.where(once, both, 0.0)


def _tally(codes: np.ndarray, weight: np.ndarray | None, least: int = 0) -> np.ndarray:
    if weight is not None and weight.dtype == bool:
        codes, weight = codes[weight], None
    return np.bincount(codes.reshape(-1), None if weight is None else weight.reshape(-1), least)


def _table(shared: np.ndarray, total: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table({"shared": shared, "whole": total - shared, "n": n.astype(np.int64)})


def _counted(a, b, left: np.ndarray, right: np.ndarray, once: np.ndarray | None) -> pa.Table:
    """Pairs, weighted by copies, for each number of shared positions and of positions in either set."""
    span, low = int(min(a.sizes.max(), b.sizes.max())) + 1, int(a.sizes.min() + b.sizes.min())
    size = (int(a.sizes.max() + b.sizes.max()) - low + 1) * span
    if not isinstance(a, Bitmaps) or size > MAX_CODES:
        shared = metric_named("tanimoto").shared(a, b).astype(np.int64)
        codes, at = np.unique((a.sizes[:, None] + b.sizes[None, :]) * span + shared, return_inverse=True)
        return _table(codes % span, codes // span, _tally(at.reshape(shared.shape), _weights(left, right, once), len(codes)))
    # By the sum of the sizes and what is shared: sets of like size are counted close to each other.
    one, two, n = ((a.sizes - a.sizes.min()) * span).astype(np.int32), ((b.sizes - b.sizes.min()) * span).astype(np.int32), np.zeros(size)
    for rows, columns, shared in a.shared(b):
        first = int(one[rows].min() + two[columns].min())
        weight = _weights(left[rows], right[columns], None if once is None else once[rows, columns])
        found = _tally(shared + (one[rows] - np.int32(first))[:, None] + two[None, columns], weight)
        n[first : first + len(found)] += found
    codes = np.flatnonzero(n)
    return _table(codes % span, codes // span + low, n[codes])


def _recounted(made: pa.Table) -> pa.Table:
    """Counts of several pieces as one row for each ``(shared, whole)``."""
    shared, whole = made["shared"].to_numpy(), made["whole"].to_numpy()
    span = int(whole.max(initial=0)) + 1
    if (int(shared.max(initial=0)) + 1) * span > MAX_CODES:
        return summed(["shared", "whole"], ["n"])(made)
    codes, n = shared * span + whole, np.zeros((int(shared.max(initial=0)) + 1) * span, np.int64)
    np.add.at(n, codes, made["n"].to_numpy())
    codes = np.flatnonzero(n)
    return pa.table({"shared": codes // span, "whole": codes % span, "n": n[codes]}).cast(made.schema)


def similarity_stats(
    df: DataFrame, id_col: str = "id", item_col: str = "item", block_rows: int | None = None
) -> DataFrame:
    """One row: pairs, mean, median and deviation of Tanimoto similarity over all unordered row pairs.

    Similarities are ratios of small counts, so each block pair is reduced to
    counts per ``(shared, union)`` before the shuffle and the exact median comes
    from those counts. Identical rows are compared once and weighted.
    """
    m = metric_named("tanimoto")
    groups = materialise(copy_groups(as_items(df, id_col, item_col, "tanimoto"), "tanimoto"))

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = m.load(x["item"]), m.load(y["item"])
        left, right = x["copies"].to_numpy(), y["copies"].to_numpy()
        once = None
        if x["left_block"][0] == x["right_block"][0]:
            once = x["id"].to_numpy()[:, None] < y["id"].to_numpy()[None, :]
        one, two = Bitmaps.of(a), Bitmaps.of(b)
        if one is None or two is None:
            return _counted(a, b, left, right, once)
        # Nearly all items are there once: those pairs need no weights.
        made = [
            _counted(m.take(one, i), m.take(two, j), left[i], right[j], None if once is None else once[np.ix_(i, j)])
            for i in _by_copies(left) for j in _by_copies(right)
        ]
        return pa.concat_tables(made)

    cell = OneCell()
    across = blocked(cell.left(groups), cell.right(groups), kernel, "shared long, whole long, n long", True, block_rows, True, True, _recounted)
    size = F.size("item").cast("long")
    copies = groups.filter(F.col("copies") > 1).groupBy(size.alias("shared"), size.alias("whole")).agg(
        F.sum(F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("n")
    )
    value = F.when(F.col("whole") > 0, F.col("shared") / F.greatest("whole", F.lit(1))).otherwise(F.lit(0.0))
    counts = materialise(
        across.unionByName(copies).groupBy(value.alias("sim")).agg(F.sum("n").alias("n"))
    )
    # One row per distinct ratio of two bit counts, however many rows there are.
    running = Window.orderBy("sim").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("upto", F.sum("n").over(running)).withColumn("one", F.lit(1))
    total = counts.agg(F.sum("n").alias("pairs"), (F.sum(F.col("sim") * F.col("n")) / F.sum("n")).alias("mean")).withColumn("one", F.lit(1))
    both = placed.join(F.broadcast(total), "one")
    low, high = F.floor((F.col("pairs") - 1) / 2), F.floor(F.col("pairs") / 2)
    return both.agg(
        F.max("pairs").alias("pairs"),
        F.max("mean").alias("mean"),
        (
            (
                F.min(F.when(F.col("upto") > low, F.col("sim"))) + F.min(F.when(F.col("upto") > high, F.col("sim")))
            ) / 2.0
        ).alias("median"),
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("sim") - F.col("mean"), F.lit(2.0))) / F.max("pairs")).alias("std"),
    )


def similarity_long(
    df: DataFrame, metric: str = "tanimoto", id_col: str = "id", item_col: str = "item"
) -> DataFrame:
    """``(id_a, id_b, similarity)`` in both orders with the diagonal, for a heat map of a picked set.

    The output is the square of the input, so pass the picks, not the library.
    """
    long = reference_space_long(df, df, metric, id_col, item_col)
    value = 1.0 - F.col("value") if metric == "euclidean" else F.col("value")
    return long.select(
        F.col("id").alias("id_a"), F.col("ref_id").alias("id_b"), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias("similarity")
    )
