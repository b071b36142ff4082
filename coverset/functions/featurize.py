"""Hook for a user's own per-row featuriser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType, _parse_datatype_string


def featurize(
    df: DataFrame,
    fn: Callable[[dict], dict | None],
    schema: str | StructType,
    keep: list[str],
    partitions: int | None = None,
) -> DataFrame:
    """Call ``fn`` with every row as a dict, in Arrow batches on the executors.

    The result has the ``keep`` columns, the fields of ``schema`` and
    ``is_valid``. A row for which ``fn`` fails or returns ``None`` stays, with
    nulls. Batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    fields = (_parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    kept = [f for f in df.schema.fields if f.name in keep]
    out = StructType(
        kept + [StructField(f.name, f.dataType, True) for f in fields] + [StructField("is_valid", BooleanType(), False)]
    )
    names = [f.name for f in fields]

    def one(row: dict) -> dict | None:
        try:
            return fn(row)
        except Exception:  # noqa: BLE001 - a bad row must not end the job
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [one(row) for row in batch.to_dict("records")]
            made = batch[[f.name for f in kept]].reset_index(drop=True)
            for name in names:
                made[name] = pd.Series([None if r is None else r.get(name) for r in results], dtype=object)
            made["is_valid"] = [r is not None for r in results]
            yield made

    source = df.repartition(partitions) if partitions else df
    return source.mapInPandas(run, out)


def count_valid(df: DataFrame, name: str = "is_valid") -> DataFrame:
    """One row ``(total, valid)``."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(name)).alias("valid"))
