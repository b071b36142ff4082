"""Farthest-first (MaxMin) diversity picking."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from coverset.functions.metrics import SizedSets, as_items, metric_named
from coverset.operators.assignment import seeded_order
from coverset.operators.cells import row_bytes
from coverset.operators.nearest import best_in_block
from coverset.session import BROADCAST_BYTES, checkpoint_dir, discard_path, materialise

# Rows of a pool and their bytes at most; rows that a round brings up to date at least; rows and picks compared at a time.
POOL_ROWS, POOL_BYTES = 8192, 32 << 20
ZONE_ROWS = 32_768
STEP = 1024
# Distances are told apart by so many leading bits of their numbers: 1,024 bins for each power of two.
BIN_SHIFT = 42
RESULT = "id long, pick_order long, pick_dist double"


def _bins(dist: np.ndarray) -> np.ndarray:
    return (np.maximum(dist, 0.0) + 0.0).view(np.int64) >> BIN_SHIFT


def _column(m, block) -> Callable[[np.ndarray, int], np.ndarray]:
    """Distances of some rows of ``block`` to one of its rows, without rounding slack."""
    if m.name == "tanimoto" and SizedSets.fits(block):
        width = (int(block.values.max(initial=0)) // 64 + 1) * 64
        marks = np.zeros((len(block), width), np.uint8)
        marks[block.rows(), block.values] = 1
        words = np.packbits(marks, axis=1).view(np.uint64)

        def sets(rows: np.ndarray, at: int) -> np.ndarray:
            shared = np.bitwise_count(words[rows] & words[at]).sum(1, dtype=np.int64)
            union = block.sizes[rows] + block.sizes[at] - shared
            return 1.0 - np.divide(shared, union, out=np.zeros(len(rows)), where=union > 0)

        return sets

    def plain(rows: np.ndarray, at: int) -> np.ndarray:
        some, one = m.take(block, rows), m.take(block, np.array([at]))
        return m.matrix(some, one)[:, 0] if m.name == "tanimoto" else m.exact(some, one, np.arange(len(rows)), np.zeros(len(rows), np.int64))

    return plain


def _greedy(m, pool: pa.Table, picked: int, k: int, outside: tuple[float, int] | None) -> list[tuple[int, float, int]]:
    """Picks ``(position, distance, id)`` that are certain given the rows outside the pool."""
    ids, far = pool["id"].to_numpy(), pool["dist"].to_numpy().copy()
    column = _column(m, m.load(pool["item"]))
    # Rows that have fallen below the best one outside are not picked this time.
    floor = outside[0] if outside is not None else -np.inf
    rows = np.arange(pool.num_rows)
    chosen = []
    while picked + len(chosen) < k and len(rows):
        top = far.max()
        at = np.flatnonzero(far == top)
        at = at[ids[rows[at]].argmin()]
        if top == -np.inf:
            break
        if outside is not None and chosen and (-top, ids[rows[at]]) > (-outside[0], outside[1]):
            break
        chosen.append((int(rows[at]), float(top), int(ids[rows[at]])))
        far = np.minimum(far, column(rows, rows[at]))
        far[at] = -np.inf
        open_rows = far >= floor if outside is not None else far > -np.inf
        if open_rows.sum() < 0.75 * len(rows):
            rows, far = rows[open_rows], far[open_rows]
    return chosen


def _lowered(rows: DataFrame, metric: str, picks: pa.Table, first: int, seen: list[int]) -> DataFrame:
    """``(id, item, dist, bin)`` of ``(id, item, dist, gen)`` without the given ``picks``, whose orders begin at ``first``.

    ``dist`` is lowered where a pick is nearer that the row's generation has not ``seen``.
    """
    m = metric_named(metric)
    shared = rows.sparkSession.sparkContext.broadcast(picks)
    schema = StructType([*rows.select("id", "item", "dist").schema.fields, StructField("bin", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = shared.value, {}

        def search(skip: int) -> tuple:
            if skip not in held:
                chosen, ids = m.load(table["item"].slice(skip)), table["id"].to_numpy()[skip:]
                parts = [m.take(chosen, np.arange(at, min(at + STEP, len(ids)))) for at in range(0, len(ids), STEP)]
                fits = m.name == "tanimoto" and all(map(SizedSets.fits, parts))
                held[skip] = ids, SizedSets(parts, ids) if fits else parts
            return held[skip]

        for batch in batches:
            skips = np.maximum(np.asarray(seen)[batch.column("gen").to_numpy()] - first, 0)
            for skip in np.unique(skips).tolist():
                ids, near = search(skip)
                some = batch.filter(pa.array(skips == skip))
                some = some.filter(pa.array(~np.isin(some.column("id").to_numpy(), ids)))
                for lo in range(0, some.num_rows, STEP):
                    part = some.slice(lo, STEP)
                    block, far = m.load(part.column("item")), part.column("dist").to_numpy()
                    if isinstance(near, SizedSets):
                        far = np.minimum(far, near.nearest(block, far)[0])
                    else:
                        for picked in near:
                            far = np.minimum(far, best_in_block(m, block, picked, np.zeros(len(picked), np.int64))[0])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("item"), pa.array(far), pa.array(_bins(far))], names=["id", "item", "dist", "bin"]
                    )

    return rows.select("id", "item", "dist", "gen").mapInArrow(run, schema)


@dataclass
class Generation:
    """Rows written together: the picks they have met, the bin from which on they were written again, and their number by bin."""

    seen: int
    limit: int
    counts: dict[int, int]


class Distances:
    """Every row's distance to its nearest pick, brought up to date only where it may be the greatest.

    Distances only shrink, so a stored one is an upper bound. The rows with the
    greatest stored ones are compared with the picks that they have not met and
    written again, as a new generation; the others wait, many of them for ever.
    Bins of distances, counted for each generation, say how far down to go.
    """

    def __init__(self, items: DataFrame, metric: str, picks: Picks):
        self.metric, self.spark, self.picks = metric, items.sparkSession, picks
        self.root = os.path.join(checkpoint_dir(self.spark), f"coverset-distances-{uuid.uuid4().hex}")
        self.generations: list[Generation] = []
        start = items.select("id", "item", F.lit(float("inf")).alias("dist"), F.lit(0).alias("gen"))
        self.schema = StructType([*start.drop("gen").schema.fields, StructField("bin", LongType()), start.schema["gen"]])
        self.rewritten = [self._write(start, 0, 1, [0])]

    def _write(self, rows: DataFrame, first: int, until: int, seen: list[int]) -> int:
        path = f"{self.root}/gen={len(self.generations)}"
        lowered = _lowered(rows, self.metric, self.picks.between(first, until), first, seen)
        # In order, so that a search for the greatest passes over the rest of a file.
        lowered.sortWithinPartitions(F.col("bin").desc()).write.parquet(path)
        counts = {r["bin"]: r["n"] for r in self.spark.read.schema(lowered.schema).parquet(path).groupBy("bin").agg(F.count("*").alias("n")).collect()}
        self.generations.append(Generation(until, 1 << 62, counts))
        return sum(counts.values())

    def rows(self, low: int, among: list[int] | None = None) -> DataFrame:
        """The valid rows from bin ``low`` on."""
        live = [g for g in (range(len(self.generations)) if among is None else among) if self.generations[g].counts]
        if not live:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).option("basePath", self.root).parquet(*[f"{self.root}/gen={g}" for g in live])
        limits = F.lit([g.limit for g in self.generations])
        return found.filter((F.col("bin") >= low) & (F.col("bin") < F.get(limits, F.col("gen"))))

    def edge(self, wanted: int) -> int | None:
        """The bin from which on there are so many valid rows; ``None`` if there are not."""
        counts: dict[int, int] = {}
        for g in self.generations:
            for b, n in g.counts.items():
                counts[b] = counts.get(b, 0) + n
        for b in sorted(counts, reverse=True):
            wanted -= counts[b]
            if wanted <= 0:
                return b
        return None

    def _renew(self, low: int) -> int:
        """Compare all rows from bin ``low`` on with the picks they have not met, some picks at a time."""
        wrote = 0
        while True:
            stale = [k for k, g in enumerate(self.generations) if g.seen < self.picks.n and any(b >= low for b in g.counts)]
            if not stale:
                return wrote
            first = min(self.generations[k].seen for k in stale)
            until = min(self.picks.n, first + self.picks.held)
            stale = [k for k in stale if self.generations[k].seen < until]
            wrote += self._write(self.rows(low, stale), first, until, [g.seen for g in self.generations])
            for k in stale:
                g = self.generations[k]
                g.limit, g.counts = min(g.limit, low), {b: n for b, n in g.counts.items() if b < low}
                if not g.counts:
                    discard_path(self.spark, f"{self.root}/gen={k}")

    def top(self, rows: int, least: int) -> pa.Table:
        """The ``rows`` farthest rows, all of them up to date; ``least`` rows at a time are brought so."""
        wrote, wanted = 0, max(least, rows)
        while True:
            low = self.edge(wanted)
            wrote += self._renew(-1 if low is None else low)
            found = self.edge(rows)
            if low is None or found is not None and found >= low:
                break
            wanted *= 2
        self.rewritten.append(wrote)
        best = self.rows(-1 if found is None else found).orderBy(F.col("dist").desc(), "id").limit(rows).select("id", "item", "dist")
        return best.toArrow().sort_by([("dist", "descending"), ("id", "ascending")])

    def drop(self) -> None:
        discard_path(self.spark, self.root)


class Picks:
    """The picks, as a table of the shared folder."""

    def __init__(self, items: DataFrame):
        self.spark, self.n = items.sparkSession, 0
        self.path = os.path.join(checkpoint_dir(self.spark), f"coverset-picks-{uuid.uuid4().hex}")
        self.schema = StructType([*self.spark.createDataFrame([], RESULT).schema.fields, items.schema["item"]])
        self.bytes = max(items.agg(F.avg(row_bytes(items))).first()[0] or 1.0, 1.0)
        # Picks that are sent to all tasks at a time.
        self.held = max(STEP, int(BROADCAST_BYTES / self.bytes))

    def keep(self, ids: list[int], dists: list[float | None], items: pa.ChunkedArray) -> None:
        order = range(self.n, self.n + len(ids))
        made = pa.table({"id": pa.array(ids, pa.int64()), "pick_order": pa.array(order, pa.int64()), "pick_dist": pa.array(dists, pa.float64()), "item": items})
        self.spark.createDataFrame(made, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        self.n += len(ids)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def between(self, first: int, until: int) -> pa.Table:
        some = self.table().filter((F.col("pick_order") >= first) & (F.col("pick_order") < until))
        return some.select("pick_order", "id", "item").toArrow().sort_by("pick_order").combine_chunks()


def maxmin(
    df: DataFrame,
    k: int,
    metric: str = "tanimoto",
    start: str | int = "first",
    seed: int = 42,
    id_col: str = "id",
    item_col: str = "item",
    pool_rows: int = POOL_ROWS,
    zone_rows: int = ZONE_ROWS,
    report: list[int] | None = None,
) -> DataFrame:
    """``(id, pick_order, pick_dist)``: ``k`` rows, each farthest from all picked before it.

    ``start`` is ``"first"`` (lowest id), ``"random"`` (by ``seed``) or an id.
    Ties go to the lowest id; ``k >= n`` picks every row.

    A stored table holds an upper bound of every row's distance to its nearest
    pick (``Distances``). Every round brings at least ``zone_rows`` of the
    greatest up to date and takes the ``pool_rows`` farthest rows. Distances to
    picks only shrink, so the next pick is certain while the best pool row still
    beats the farthest row outside the pool: one round yields many exact picks.
    A pool of wide rows is cut to ``POOL_BYTES``. ``report`` receives the rows
    that were written first and in each round.
    """
    m = metric_named(metric)
    spark = df.sparkSession
    items = materialise(as_items(df, id_col, item_col, metric))
    if start == "first":
        first = items.orderBy("id").limit(1)
    elif start == "random":
        first = items.orderBy(*seeded_order("id", seed)).limit(1)
    elif isinstance(start, int):
        first = items.filter(F.col("id") == start).limit(1)
    else:
        raise ValueError(f"unknown start {start!r}")
    if k <= 0:
        return spark.createDataFrame([], RESULT)
    picks = first.toArrow()
    if picks.num_rows == 0:
        if isinstance(start, int) and not items.isEmpty():
            raise ValueError(f"start row {start} not found")
        return spark.createDataFrame([], RESULT)
    kept = Picks(items)
    kept.keep(picks["id"].to_pylist(), [None], picks["item"])
    pool_rows = min(pool_rows, max(int(POOL_BYTES / kept.bytes), 1))
    state = Distances(items, metric, kept)
    while kept.n < k:
        top, outside = state.top(pool_rows + 1, zone_rows), None
        if top.num_rows > pool_rows:
            outside = (top["dist"][pool_rows].as_py(), top["id"][pool_rows].as_py())
            top = top.slice(0, pool_rows)
        chosen = _greedy(m, top.combine_chunks(), kept.n, k, outside)
        if not chosen:
            break
        kept.keep([row_id for _, _, row_id in chosen], [dist for _, dist, _ in chosen], top["item"].take(pa.array([at for at, _, _ in chosen])))
    state.drop()
    if report is not None:
        report.extend(state.rewritten)
    return kept.table().select("id", "pick_order", "pick_dist")
