"""Reading libraries and writing results."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coverset.functions.filters import take_subset

# Fixed schema of the sample library table.
LIBRARY_SCHEMA = "SMILES string, Name string, MolWeight double"

FORMATS = {".csv": "csv", ".sdf": "sdf", ".parquet": "parquet", ".pq": "parquet"}


def library_format(path: str) -> str:
    """Format by lower-cased file extension; a folder without one is parquet."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if not ext:
        return "parquet"
    if ext not in FORMATS:
        raise ValueError(f"unsupported library format {ext!r}; choose from {sorted(FORMATS)}")
    return FORMATS[ext]


def read_library(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: str | StructType | None = LIBRARY_SCHEMA,
    infer: bool = False,
    required: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Scan a library: CSV with header, SDF records or parquet.

    CSV columns are matched by their header names in any order: those of
    ``schema`` get its types (missing ones are null), all others stay as text. A
    file without the ``required`` column is an error; by default that is the
    schema's first column, and none if the types are found. ``infer=True`` reads the
    file twice to find the types; ``multi_line=True`` allows line breaks inside
    quotes, and then a file is one task. For parquet the stored schema is used.
    """
    fmt = (fmt or library_format(path)).lower()
    if fmt == "csv":
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        raw = reader.option("inferSchema", bool(infer or schema is None)).csv(path)
        found = infer or schema is None
        wanted = [] if found else (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        required = required or (wanted[0].name if wanted else None)
        if required and required not in raw.columns:
            raise ValueError(f"{path} has no column {required!r}")
        if found:
            return raw
        known = [
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted
        ]
        return raw.select(*known, *[F.col(f"`{c}`") for c in raw.columns if c not in {f.name for f in wanted}])
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "sdf":
        from coverset.sources.records import read_sdf_records

        return read_sdf_records(spark, path)
    raise ValueError(f"unsupported library format {fmt!r}")


def run_id(at: datetime | None = None) -> str:
    """Time stamp for output names, e.g. ``20240131_235959`` (UTC)."""
    return (at or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def write_subset(
    df: DataFrame,
    ids: DataFrame,
    path: str,
    id_col: str = "id",
    fmt: str = "parquet",
    compression: str | None = None,
    run: str | None = None,
) -> str:
    """Write the chosen rows under ``path/run=<run id>`` and return that folder.

    ``sdf`` writes the texts of the ``record`` column.
    """
    target = os.path.join(path, f"run={run or run_id()}")
    chosen = take_subset(df, ids, id_col)
    if fmt == "sdf":
        from coverset.sources.records import write_sdf_records

        write_sdf_records(chosen, target, compression)
        return target
    writer = chosen.write
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(target)
    elif fmt == "parquet":
        writer.parquet(target)
    else:
        raise ValueError(f"unsupported output format {fmt!r}")
    return target


def metrics_long(df: DataFrame) -> DataFrame:
    """``(metric, value)`` rows from a one-row table of numbers."""
    numbers = df.select([F.col(c).cast("double").alias(c) for c in df.columns])
    return numbers.unpivot([], df.columns, "metric", "value")


def write_metrics(df: DataFrame, path: str, fmt: str = "text") -> str:
    """Write metrics as ``metric: value`` lines or JSON rows.

    ``df`` is ``(metric, value)`` or one wide row.
    """
    long = df if df.columns == ["metric", "value"] else metrics_long(df)
    if fmt == "text":
        long.select(F.concat_ws(": ", "metric", F.col("value").cast("string"))).coalesce(1).write.text(path)
    elif fmt == "json":
        long.coalesce(1).write.json(path)
    else:
        raise ValueError(f"unsupported metrics format {fmt!r}")
    return path
