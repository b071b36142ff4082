"""Per-row statistics of numeric arrays, and block concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_stats_columns(column: str) -> dict[str, Column]:
    """Mean, population deviation, least and greatest value; zeros for an empty or null array."""
    values = F.coalesce(F.col(column).cast("array<double>"), F.array().cast("array<double>"))
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    mean = F.when(n > 0, total / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    squares = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return {
        "mean": mean,
        "std": F.when(n > 0, F.sqrt(squares / F.greatest(n, F.lit(1)))).otherwise(F.lit(0.0)),
        "min": F.coalesce(F.array_min(values), F.lit(0.0)),
        "max": F.coalesce(F.array_max(values), F.lit(0.0)),
    }


def array_stats(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Add ``<prefix>_mean``, ``_std``, ``_min`` and ``_max`` of an array column."""
    head = prefix or column
    return df.withColumns({f"{head}_{k}": c for k, c in array_stats_columns(column).items()})


def array_stats_block(column: str) -> Column:
    """The four statistics as one array, for ``combine_blocks``."""
    return F.array(*array_stats_columns(column).values())


def fixed_width(block: Column, width: int) -> Column:
    """``block`` with exactly ``width`` values: zeros for null, missing or NaN values; a longer block is an error."""
    filled = F.transform(
        F.coalesce(block.cast("array<double>"), F.array().cast("array<double>")),
        lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)),
    )
    padded = F.concat(filled, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(filled), F.lit(0))))
    long = F.raise_error(F.format_string("a block of %d values is wider than its %d places", F.size(filled), F.lit(width)))
    return F.when(F.size(filled) > width, long.cast("array<double>")).otherwise(padded)


def combine_blocks(df: DataFrame, blocks: list[tuple[str | list[str], int]], name: str = "features") -> DataFrame:
    """Concatenate feature blocks per row into one ``array<double>``.

    A block is ``(array column, width)`` or ``([numeric columns], width)``.
    Blocks keep their width, so a missing one leaves zeros in its own place. A
    named numeric column that does not exist counts as 0.
    """
    parts = []
    for source, width in blocks:
        if isinstance(source, str):
            parts.append(fixed_width(F.col(source), width))
        else:
            values = [F.col(c).cast("double") if c in df.columns else F.lit(0.0) for c in source]
            parts.append(fixed_width(F.array(*values), width))
    return df.withColumn(name, F.concat(*parts))
