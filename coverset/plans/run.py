"""From a library to a written, validated subset."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame

from coverset.functions.arrays import combine_blocks
from coverset.functions.filters import range_filter
from coverset.operators.reduction import Reducer
from coverset.plans.selection import select_subset
from coverset.plans.validation import Validation, validate_subset
from coverset.session import materialise
from coverset.sources.library import run_id, write_metrics, write_subset


@dataclass
class Run:
    items: DataFrame  # the filtered rows with their features in ``item``
    subset: DataFrame  # id
    validation: Validation
    subset_path: str
    metrics_path: str


def run_selection(
    library: DataFrame,
    out: str,
    blocks: list[tuple[str | list[str], int]],
    ranges: dict[str, tuple[float | None, float | None]] | None = None,
    reducer: Reducer | None = None,
    method: str = "maxmin",
    metric: str = "euclidean",
    properties: list[str] | None = None,
    threshold: float = 0.4,
    fmt: str = "csv",
    compression: str | None = None,
    run: str | None = None,
    id_col: str = "id",
    **params,
) -> Run:
    """Filter, combine feature blocks, reduce, select, validate and write.

    ``library`` has an id column and the columns of ``blocks``. The chosen rows
    go to ``out/run=<run id>`` with the library's columns, the coverage figures
    to ``out/metrics/run=<run id>``. ``params`` go to ``select_subset``.
    """
    run = run or run_id()
    rows = range_filter(library, ranges) if ranges else library
    items = materialise(combine_blocks(rows, blocks, "item"))
    if reducer is not None:
        items = materialise(reducer.fit(items).transform(items))
    subset = materialise(select_subset(items, method, metric, id_col, **params).withColumnRenamed("id", id_col))
    report = validate_subset(items, subset, properties, metric, threshold, id_col)
    written = write_subset(items.select(library.columns), subset, out, id_col, fmt, compression, run)
    metrics = write_metrics(report.coverage, os.path.join(out, "metrics", f"run={run}"))
    return Run(items, subset, report, written, metrics)
