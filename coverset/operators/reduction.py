"""Scaling and principal components, fitted once and applied to batches or streams."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverset.operators.quantiles import SMALL_ROWS
from coverset.operators.scaling import Affine, _summary, fit_scaler

log = logging.getLogger(__name__)

# Fixed defaults: 50 components, standard scaling, 95 % of the variance.
N_COMPONENTS, SCALER, VARIANCE_RATIO = 50, "standard", 0.95


@dataclass
class Reducer:
    """Scaler plus PCA over an ``array<double>`` column.

    ``fit`` keeps the fewest components whose cumulated share of the variance
    reaches ``variance_ratio``, at most ``n_components``. Disabled, unfitted or
    with an unknown method, ``transform`` passes the values through.
    """

    item_col: str = "item"
    n_components: int = N_COMPONENTS
    variance_ratio: float = VARIANCE_RATIO
    scaler: str | None = SCALER
    method: str = "pca"
    enabled: bool = True
    small_rows: int = SMALL_ROWS
    affine: Affine | None = None
    model: PCAModel | None = None
    kept: int = 0
    ratios: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame) -> "Reducer":
        if not self.enabled:
            return self
        items = df.select(F.col(self.item_col).cast("array<double>").alias("item")).filter(
            F.col("item").isNotNull() & ~F.exists("item", lambda x: x.isNull() | F.isnan(x))
        )
        first = items.first()
        if first is None:
            return self
        width = len(first["item"])
        self.affine = fit_scaler(items, self.scaler, self.small_rows)
        if self.method != "pca":
            log.warning("unknown reduction method %r: features stay as they are", self.method)
            return self
        affine = self.affine or Affine([0.0] * width, [1.0] * width)
        # Spark's PCA does not centre what it transforms, so centring joins the scaler.
        if self.scaler != "standard" or self.affine is None:
            scaled = items.select(affine.column(F.col("item")).alias("item"))
            affine = affine.then_centered(_summary(scaled, "mean")["mean"])
        self.affine = affine
        vectors = items.select(array_to_vector(affine.column(F.col("item"))).alias("_v"))
        self.model = PCA(k=min(self.n_components, width), inputCol="_v", outputCol="_pc").fit(vectors)
        self.ratios = [float(r) for r in self.model.explainedVariance.toArray()]
        self.kept = len(self.ratios)
        if self.variance_ratio < 1.0:
            total = 0.0
            for count, ratio in enumerate(self.ratios, 1):
                total += ratio
                if total >= self.variance_ratio:
                    self.kept = count
                    break
        return self

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Reduced features in ``name`` (default: in place). Stateless, so streams work too."""
        name = name or self.item_col
        if not self.enabled or (self.affine is None and self.model is None):
            return df.withColumn(name, F.col(self.item_col))
        moved = F.col(self.item_col).cast("array<double>")
        if self.affine is not None:
            moved = self.affine.column(moved)
        if self.model is None:
            return df.withColumn(name, moved)
        placed = self.model.transform(df.withColumn("_v", array_to_vector(moved)))
        return placed.withColumn(name, F.slice(vector_to_array("_pc"), 1, self.kept)).drop("_v", "_pc")

    def variance_table(self, spark) -> DataFrame:
        """``(component, ratio, cumulative, kept)``, one row per fitted component."""
        rows = [(i + 1, r, i < self.kept) for i, r in enumerate(self.ratios)]
        table = spark.createDataFrame(rows, "component long, ratio double, kept boolean")
        # At most n_components rows.
        running = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return table.withColumn("cumulative", F.sum("ratio").over(running)).select("component", "ratio", "cumulative", "kept")

    def save(self, spark, path: str) -> None:
        state = {
            "item_col": self.item_col, "n_components": self.n_components, "variance_ratio": self.variance_ratio,
            "scaler": self.scaler, "method": self.method, "enabled": self.enabled, "kept": self.kept, "ratios": self.ratios,
            "shift": self.affine.shift if self.affine else None, "scale": self.affine.scale if self.affine else None,
            "has_model": self.model is not None,
        }
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "state"))
        if self.model is not None:
            self.model.write().overwrite().save(os.path.join(path, "pca"))

    @classmethod
    def load(cls, spark, path: str) -> "Reducer":
        state = json.loads(spark.read.text(os.path.join(path, "state")).first()["value"])
        shift, scale = state.pop("shift"), state.pop("scale")
        model = PCAModel.load(os.path.join(path, "pca")) if state.pop("has_model") else None
        return cls(**state, affine=Affine(shift, scale) if shift is not None else None, model=model)


def pca_reduce(
    df: DataFrame,
    n_components: int = N_COMPONENTS,
    variance_ratio: float = VARIANCE_RATIO,
    item_col: str = "item",
    name: str | None = None,
    scaler: str | None = None,
) -> DataFrame:
    """Principal components of a vector column in one call."""
    return Reducer(item_col, n_components, variance_ratio, scaler).fit(df).transform(df, name)


def projection_table(
    df: DataFrame,
    subset: DataFrame,
    n_components: int = 2,
    id_col: str = "id",
    item_col: str = "item",
    label_col: str | None = None,
) -> DataFrame:
    """``(id, source, label, selected, pc1, pc2[, pc3])`` of library and subset rows.

    Both are stacked, projected by one joint PCA, and told apart by ``source``
    (``"library"`` or ``"subset"``). A library row is ``selected`` when its id
    is in the subset.
    """
    def side(rows: DataFrame, source: str) -> DataFrame:
        label = F.col(label_col).cast("long") if label_col and label_col in rows.columns else F.lit(None).cast("long")
        return rows.select(
            F.col(id_col).cast("long").alias("id"), F.lit(source).alias("source"), label.alias("label"),
            F.col(item_col).cast("array<double>").alias("item"),
        )

    picked = subset.select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("selected", F.lit(True))
    stacked = side(df, "library").unionByName(side(subset, "subset"))
    reducer = Reducer("item", n_components, 1.0, None).fit(stacked)
    placed = reducer.transform(stacked, "pc").join(picked, "id", "left")
    pcs = [F.get("pc", F.lit(k)).alias(f"pc{k + 1}") for k in range(n_components)]
    return placed.select("id", "source", "label", F.coalesce("selected", F.lit(False)).alias("selected"), *pcs)
