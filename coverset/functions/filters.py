"""Row filters and validity flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverset.session import finite

# Fixed default bounds: weight 100 to 1000, at most 100 atoms.
DEFAULT_BOUNDS = {"weight": (100.0, 1000.0), "atoms": (None, 100)}


def in_range(column: str, low: float | None, high: float | None) -> Column:
    """Inclusive bounds; ``None`` leaves a side open, a null value fails."""
    c = F.col(column)
    if low is not None and high is not None:
        return c.between(low, high)
    if low is not None:
        return c >= low
    return c <= high if high is not None else c.isNotNull()


def range_filter(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Keep rows inside all ``{column: (low, high)}`` bounds; reaches the scan as a pushed filter."""
    return df.filter(reduce(lambda a, b: a & b, [in_range(c, lo, hi) for c, (lo, hi) in bounds.items()], F.lit(True)))


def flag_valid(
    df: DataFrame,
    required: list[str],
    bounds: dict[str, tuple[float | None, float | None]] | None = None,
    name: str = "is_valid",
) -> DataFrame:
    """Keep every row and say in ``name`` whether it may be used.

    A row is valid when its required columns are present (numbers finite,
    arrays of finite numbers) and the bounds hold.
    """
    types = dict(df.dtypes)
    tests = []
    for c in required:
        if types[c] in ("double", "float"):
            tests.append(finite(c))
        elif types[c] in ("array<double>", "array<float>"):
            tests.append(F.col(c).isNotNull() & F.forall(c, finite))
        else:
            tests.append(F.col(c).isNotNull())
    for c, (lo, hi) in (bounds or {}).items():
        tests.append(in_range(c, lo, hi))
    return df.withColumn(name, F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False)))


def valid_rows(df: DataFrame, name: str = "is_valid") -> DataFrame:
    """Rows flagged valid, without the flag."""
    return df.filter(F.col(name)).drop(name)


def take_subset(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``df`` whose id is in ``ids`` (first column)."""
    chosen = ids.select(F.col(ids.columns[0]).alias(id_col))
    return df.join(chosen, id_col, "left_semi").select(df.columns)


def zero_if_missing(column: Column) -> Column:
    """Null and NaN become 0."""
    return F.coalesce(F.nanvl(column, F.lit(0.0)), F.lit(0.0))
