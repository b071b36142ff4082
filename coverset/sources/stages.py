"""Tables, models and small values kept between the stages of a run."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from coverset.operators.reduction import Reducer


class StageStore:
    """A run folder on shared storage. Loading a name that was never saved gives ``None``."""

    def __init__(self, spark: SparkSession, root: str, run: str):
        self.spark = spark
        self.root = os.path.join(root, f"run={run}")

    def _path(self, kind: str, name: str) -> str:
        return os.path.join(self.root, kind, name)

    def save_table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path("tables", name))
        return self.load_table(name)

    def load_table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path("tables", name))
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def save_json(self, name: str, value) -> None:
        row = self.spark.createDataFrame([(json.dumps(value),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(self._path("values", name))

    def load_json(self, name: str):
        try:
            return json.loads(self.spark.read.text(self._path("values", name)).first()["value"])
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def save_reducer(self, name: str, reducer: Reducer) -> None:
        reducer.save(self.spark, self._path("models", name))

    def load_reducer(self, name: str) -> Reducer | None:
        try:
            return Reducer.load(self.spark, self._path("models", name))
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
