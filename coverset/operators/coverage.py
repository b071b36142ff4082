"""How well a subset stands for the whole: distances to the nearest pick."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverset.operators.nearest import nearest
from coverset.operators.quantiles import SMALL_ROWS, quantiles, ranked_values
from coverset.session import materialise


def _distances(df, subset, metric, id_col, item_col) -> DataFrame:
    return materialise(nearest(df, subset, metric, id_col, item_col).select("dist"))


def _median(distances: DataFrame, small_rows: int) -> float | None:
    values = distances.select(F.lit(0).cast("long").alias("grp"), F.col("dist").alias("x"))
    found = quantiles(values, [0.5], small_rows)
    return found[0][0] if found else None


def nearest_summary(
    df: DataFrame,
    refs: DataFrame,
    metric: str = "tanimoto",
    id_col: str = "id",
    item_col: str = "item",
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """One row: mean, max and median distance to the nearest reference."""
    d = _distances(df, refs, metric, id_col, item_col)
    median = F.lit(_median(d, small_rows)).cast("double")
    return d.agg(
        F.avg("dist").alias("mean_distance"), F.max("dist").alias("max_distance"), median.alias("median_distance")
    )


def coverage(
    df: DataFrame,
    subset: DataFrame,
    threshold: float = 0.4,
    metric: str = "tanimoto",
    id_col: str = "id",
    item_col: str = "item",
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """One row of coverage figures of ``subset`` over ``df``.

    A row is covered when its nearest pick is at most ``threshold`` away. A
    radius is the value at 0-based rank ``floor(share * n)`` of the sorted
    distances; ``hybrid_score`` is the covered share times ``1 - mean / max``.
    """
    d = _distances(df, subset, metric, id_col, item_col)
    n = d.count()
    if n == 0:
        radii = [None, None]
    else:
        radii = ranked_values(d, "dist", [math.floor(0.9 * n), math.floor(0.95 * n)], n, small_rows)
    found = d.agg(
        F.avg(F.when(F.col("dist") <= threshold, 1.0).otherwise(0.0)).alias("coverage_ratio"),
        F.avg("dist").alias("mean_distance"),
        F.max("dist").alias("max_distance"),
    )
    spread = F.when(F.col("max_distance") > 0, 1.0 - F.col("mean_distance") / F.col("max_distance")).otherwise(F.lit(1.0))
    return found.select(
        "coverage_ratio",
        "mean_distance",
        "max_distance",
        F.lit(_median(d, small_rows)).cast("double").alias("median_distance"),
        F.lit(radii[0]).cast("double").alias("radius_90"),
        F.lit(radii[1]).cast("double").alias("radius_95"),
        (F.col("coverage_ratio") * spread).alias("hybrid_score"),
    )


def selection_spread(
    df: DataFrame,
    selected: DataFrame,
    metric: str = "euclidean",
    id_col: str = "id",
    item_col: str = "item",
) -> DataFrame:
    """One row: selected share, and mean, max and deviation of the distance to the nearest pick."""
    flagged = nearest(df, selected, metric, id_col, item_col)
    picks = selected.select(F.col(id_col).cast("long").alias("id")).distinct().count()
    return flagged.agg(
        (F.lit(float(picks)) / F.nullif(F.count("*"), F.lit(0))).cast("double").alias("selected_ratio"),
        F.avg("dist").alias("avg_min_distance"),
        F.max("dist").alias("max_min_distance"),
        F.stddev_pop("dist").alias("std_min_distance"),
    )
