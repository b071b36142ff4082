"""Session helpers: shipping the package, cutting lineage, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its measured size stays under this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024

# Replicas of the small side in a salted join.
SALTS = 16

_SHIPPED = "spark.coverset.shipped"


def attach(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers (once per application)."""
    if spark.conf.get(_SHIPPED, "") == spark.sparkContext.applicationId:
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="coverset-"), "coverset.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("coverset", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    # local-cluster has executors of its own, which do not share a temporary folder.
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="coverset-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends at durable files, so a lost executor costs only its own
    tasks, and later plans see the real size of the table.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"coverset-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` wrote and nothing reads any more."""
    for path in {os.path.dirname(f) for f in table.inputFiles()}:
        discard_path(table.sparkSession, path)


def discard_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fits_broadcast(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is known, by counting, to be small enough to broadcast."""
    rows = limit // max(bytes_per_row, 1)
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    salt_by: str,
    bytes_per_row: int = 1024,
    how: str = "inner",
) -> DataFrame:
    """Add the columns of ``table`` (one row per ``key``) to ``rows``.

    A small table is broadcast. A larger one is replicated over a few salts, so
    that a key holding a large share of ``rows`` is spread over several tasks.
    """
    if fits_broadcast(table, bytes_per_row):
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
        .join(salted, [key, "_salt"], how)
        .drop("_salt")
    )


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a scan with fewer partitions than cores; a larger scan is left alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def finite(column: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
