"""Feature scaling fitted in one pass and applied as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverset.operators.quantiles import SMALL_ROWS, quantiles

SCALERS = ("standard", "minmax", "robust")


@dataclass(frozen=True)
class Affine:
    """``(x - shift) / scale`` per position."""

    shift: list[float]
    scale: list[float]

    def column(self, item: Column) -> Column:
        moved = F.zip_with(item, F.lit(self.shift), lambda x, s: x - s)
        return F.zip_with(moved, F.lit(self.scale), lambda x, s: x / s)

    def then_centered(self, mean: list[float]) -> "Affine":
        """The same followed by subtracting ``mean``."""
        return Affine([s + m * c for s, m, c in zip(self.shift, mean, self.scale)], self.scale)


def _summary(items: DataFrame, *names: str) -> dict[str, list[float]]:
    vectors = items.select(array_to_vector("item").alias("v"))
    row = vectors.select(Summarizer.metrics(*names).summary(F.col("v")).alias("s")).first()["s"]
    return {name: [float(x) for x in row[name].toArray()] if name != "count" else row[name] for name in names}


def fit_scaler(items: DataFrame, scaler: str | None, small_rows: int = SMALL_ROWS) -> Affine | None:
    """Fit on ``(id, item)`` rows; an unknown name means no scaling (``None``).

    ``standard`` uses the population deviation, ``minmax`` maps to [0, 1] and
    ``robust`` uses the median and the interpolated quartile range. A feature
    without spread gets scale 1.
    """
    if scaler not in SCALERS or items.isEmpty():
        return None

    def positive(values):
        return [v if v > 0 else 1.0 for v in values]

    if scaler == "standard":
        s = _summary(items, "count", "mean", "variance")
        n = s["count"]
        deviations = [(v * (n - 1) / n) ** 0.5 if n > 1 else 0.0 for v in s["variance"]]
        return Affine(s["mean"], positive(deviations))
    if scaler == "minmax":
        s = _summary(items, "min", "max")
        return Affine(s["min"], positive([b - a for a, b in zip(s["min"], s["max"])]))
    long = items.select(F.posexplode("item").alias("grp", "x")).select(F.col("grp").cast("long").alias("grp"), "x")
    found = quantiles(long, [0.25, 0.5, 0.75], small_rows)
    columns = [found[g] for g in sorted(found)]
    return Affine([c[1] for c in columns], positive([c[2] - c[0] for c in columns]))


def scale(
    df: DataFrame,
    scaler: str = "standard",
    item_col: str = "item",
    name: str | None = None,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Scale a vector column in place (or into ``name``)."""
    items = df.select(F.col(item_col).cast("array<double>").alias("item")).filter("item IS NOT NULL")
    fitted = fit_scaler(items, scaler, small_rows)
    if fitted is None:
        return df.withColumn(name or item_col, F.col(item_col))
    return df.withColumn(name or item_col, fitted.column(F.col(item_col).cast("array<double>")))


