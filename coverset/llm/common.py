"""What the operators share: words, bounded Arrow slices, durable tables, splits and a small logistic fit."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coverset.session import attach

# Rows handled at a time inside a task; bounds what a slice holds beside the Arrow batch itself.
SLICE_ROWS = 256

ASCII_SPACE = b" \t\n\r\x0b\x0c"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Lower-cased letters, digits and every byte of a non-ASCII character stay; the rest parts words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters; A-Z lower-cased."""
    return utf8(text).translate(WORD_BYTES).split()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores is dealt over all cores; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unused(name: str, taken: list[str]) -> str:
    """``name``, or a longer one that no column has in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def append(df: DataFrame, fields: str, compute: Callable[[list], list], inputs: list[str]) -> DataFrame:
    """``df`` with computed columns: ``compute`` gets the lists of the input columns, slice by slice."""
    extra = StructType.fromDDL(fields)
    schema = StructType(df.schema.fields + extra.fields)
    places = [df.columns.index(c) for c in inputs]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(f.name, to_arrow_type(f.dataType)) for f in extra.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch])):
                made = compute([part.column(i).to_pylist() for i in places])
                arrays = [pa.array(v, type=kind) for v, (_, kind) in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *arrays], names=[*part.schema.names, *(n for n, _ in kinds)]
                )
            pa.default_memory_pool().release_unused()  # several workers share an executor's memory

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The contract's split: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` wrote and nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.1, steps: int = 40):
    """Damped Newton steps; returns the means, scales and weights (bias last)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    design = np.c_[(x - mean) / scale, np.ones(len(x))]
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    w, sign = np.zeros(design.shape[1]), 2.0 * y - 1.0

    def loss(w):
        return (weight * np.logaddexp(0.0, -sign * (design @ w))).sum() + 0.5 * (penalty * w * w).sum()

    now = loss(w)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -35, 35)))
        slope = design.T @ (weight * (p - y)) + penalty * w
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step, t = np.linalg.solve(bend, slope), 1.0
        while (then := loss(w - t * step)) > now and t > 1e-4:
            t /= 2
        if now - then < 1e-7 * max(1.0, abs(now)):
            break
        w, now = w - t * step, then
    return mean, scale, w


def logistic(model, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1.0 / (1.0 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -35, 35)))
