"""Report on how well a subset stands for its library."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from coverset.functions.filters import take_subset
from coverset.operators.coverage import coverage
from coverset.operators.distributions import histogram_table, property_compare
from coverset.operators.nearest import nearest
from coverset.session import materialise


@dataclass
class Validation:
    coverage: DataFrame  # one row
    properties: DataFrame | None  # property, source, n, mean, std
    nearest: DataFrame  # id, ref_id, dist
    histogram: DataFrame  # of the nearest distances


def validate_subset(
    df: DataFrame,
    ids: DataFrame,
    properties: list[str] | None = None,
    metric: str = "tanimoto",
    threshold: float = 0.4,
    id_col: str = "id",
    item_col: str = "item",
    bins: int = 50,
) -> Validation:
    """Coverage, property comparison and nearest distances of the rows named by ``ids``."""
    subset = materialise(take_subset(df, ids, id_col))
    found = materialise(nearest(df, subset, metric, id_col, item_col))
    return Validation(
        coverage(df, subset, threshold, metric, id_col, item_col),
        property_compare(df, subset, properties) if properties else None,
        found,
        histogram_table(found, "dist", bins),
    )
