"""Compare every query with its SQL on one data folder: ``python -m workload.compare <dir> [names]``."""

from __future__ import annotations

import math
import sys
import threading
import time

import duckdb
import pandas as pd

from workload.oracle import ORACLE
from workload.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in row) for row in frame[names].itertuples(index=False)]
    return sorted(rows, key=lambda row: tuple((v is not None, str(type(v)) if isinstance(v, str) else "", v) for v in row if True))


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """``None`` when equal, else what differs."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} against {sorted(theirs.columns)}"
    a, b = rows_of(mine), rows_of(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    kinds = {c: (str(mine[c].dtype), str(theirs[c].dtype)) for c in mine.columns if mine[c].dtype.kind != theirs[c].dtype.kind}
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, e.g. {wrong[0]} kinds {kinds}"
    return f"kinds {kinds}" if kinds and a else None


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    con = connect(sf)
    for name in names:
        start = time.time()
        watch = threading.Timer(90, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        watch.start()
        try:
            mine = QUERIES[name](spark, sf).toPandas()
            took = time.time() - start
            if name not in ORACLE:
                print(f"rows  {name} {took:.1f}s {len(mine)} rows", flush=True)
                continue
            start = time.time()
            theirs = con.execute(ORACLE[name]).df()
            found = difference(mine, theirs)
            print(f"{'ok   ' if found is None else 'DIFF '} {name} spark {took:.1f}s sql {time.time() - start:.1f}s {len(mine)} rows {found or ''}"[:700], flush=True)
        except Exception as failure:  # noqa: BLE001
            print(f"FAIL  {name} {time.time() - start:.1f}s {failure}"[:700], flush=True)
        finally:
            watch.cancel()


if __name__ == "__main__":
    main()
