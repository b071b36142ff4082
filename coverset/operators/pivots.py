"""Recursive pivot cells: every cell is split around sample rows of its own until it has at most a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from coverset.operators.cells import MAX_BLOCK, blocked
from coverset.session import BROADCAST_BYTES, discard, lookup_join, materialise

# Children of a cell, and levels: cell c has the children c * FAN + 1 to c * FAN + FAN, all in a long.
FAN = 256
MAX_LEVELS = 7
# Rows whose distances to a cell's pivots are held at a time, and rows that a search sends down together: each may go to FAN children.
TILE, STEP = 4096, 512
# A search of more leaves, or of more than a quarter of the rows, is left to blocks; found on a sample of rows.
MAX_VISITS, LEAST_GAIN, SAMPLE = 64, 4, 256

Choice = Callable[[np.ndarray, np.ndarray, float, dict], tuple[np.ndarray, np.ndarray, dict]]


@dataclass
class Level:
    """Pivots ``(cell, child, item, radius)`` of one level; ``held`` if few enough bytes to send to every task."""

    frame: DataFrame
    held: pa.Table | None


def _walk(m, table: pa.Table, level: dict, choose: Choice, extra: list[str]) -> pa.Table:
    """Replace ``cell`` by the chosen children; rows in cells without children stay."""
    cell = table["cell"].to_numpy()
    order = np.argsort(cell, kind="stable")
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1, [len(cell)]]) if len(cell) else np.zeros(1, np.int64)
    rows, cells, values = [], [], {name: [] for name in extra}
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        here = level.get(int(cell[order[lo]]))
        if here is None:
            rows.append(order[lo:hi])
            cells.append(cell[order[lo:hi]])
            for name in extra:
                values[name].append(table[name].to_numpy()[order[lo:hi]])
            continue
        children, centres, radii = here
        for at in range(lo, hi, TILE):
            mine = order[at : min(at + TILE, hi)]
            part = table.take(pa.array(mine))
            block = m.bound_space(m.load(part["item"]))
            far = m.bound(block, centres)
            slack = 4.0 * m.slack(block, centres) + 1e-9
            given = {c: part[c].to_numpy() for c in part.column_names if c not in ("item", "cell") and pa.types.is_primitive(part[c].type)}
            i, j, made = choose(far, radii, slack, given)
            rows.append(mine[i])
            cells.append(children[j])
            for name in extra:
                values[name].append(made[name])
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    out = table.take(pa.array(row)).set_column(table.column_names.index("cell"), "cell", pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64)))
    for name in extra:
        made = pa.array(np.concatenate(values[name]) if values[name] else np.zeros(0))
        out = out.set_column(out.column_names.index(name), name, made)
    return out


def _index(m, table: pa.Table) -> dict:
    """Pivots of each cell of one level, ready to be compared."""
    cell = table["cell"].to_numpy()
    order = np.lexsort((table["child"].to_numpy(), cell))
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1, [len(cell)]])
    made = {}
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        part = table.take(pa.array(order[lo:hi]))
        made[int(part["cell"][0].as_py())] = (part["child"].to_numpy(), m.bound_space(m.load(part["item"])), part["radius"].to_numpy())
    return made


class PivotTree:
    """Cells of a table in a metric space, for joins that are not quadratic.

    A row's *home* is the leaf reached by the nearest pivot of every level. A
    row within ``reach`` of another can find it in a cell only if that cell's
    pivot is at most ``2 reach`` farther than the nearest one of its level
    (hyperplane bound), and at most the cell's radius plus ``reach`` away (ball
    bound). Both hold on every level, so a search descends only into the
    children that pass. Pivots steer the layout alone; any choice gives the
    same result. Levels with few pivots are descended in the task, larger ones
    by joining the rows with their cell's pivots.
    """

    def __init__(self, metric, levels: list[Level]):
        self.metric, self.levels = metric, levels

    def route(self, df: DataFrame, choose: Choice, extra: list[str] = (), levels: list[Level] | None = None) -> DataFrame:
        """Send the rows of ``df``, which carry ``cell``, down the given levels."""
        extra = list(extra)
        waiting: list[pa.Table] = []
        schema = df.schema

        def small(df: DataFrame, tables: list[pa.Table]) -> DataFrame:
            shared = df.sparkSession.sparkContext.broadcast(tables)
            names = schema.names
            arrow = to_arrow_schema(schema)
            m = self.metric

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                indexes = [_index(m, t) for t in shared.value]

                def down(table: pa.Table, depth: int) -> Iterator[pa.Table]:
                    # A few rows at a time on every level, as each may go down to many cells.
                    for at in range(0, table.num_rows, STEP):
                        moved = _walk(m, table.slice(at, STEP), indexes[depth], choose, extra)
                        yield from down(moved, depth + 1) if depth + 1 < len(indexes) else [moved]

                for batch in batches:
                    for table in down(pa.Table.from_batches([batch]), 0):
                        yield from table.select(names).cast(arrow).to_batches(max_chunksize=8192)

            return df.mapInArrow(run, schema)

        for level in self.levels if levels is None else levels:
            if level.held is not None:
                waiting.append(level.held)
                continue
            if waiting:
                df, waiting = small(df, waiting), []
            df = self._joined(df, level, choose, extra)
        return small(df, waiting) if waiting else df

    def _joined(self, df: DataFrame, level: Level, choose: Choice, extra: list[str]) -> DataFrame:
        """One level whose pivots are too many for a task: rows meet the pivots of their cell."""
        names = df.schema.names
        opened = level.frame.groupBy("cell").agg(F.count("*").alias("_open"))
        flagged = lookup_join(df, opened, "cell", "id", bytes_per_row=16, how="left")
        m = self.metric

        def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
            return _walk(m, x.select(names), _index(m, y.select(["cell", "child", "item", "radius"])), choose, extra).select(names)

        # A cell's pivots fit one block, so every row sees all of them.
        moved = blocked(
            flagged.filter("_open IS NOT NULL").select(names), level.frame.withColumn("id", F.col("child")), kernel, df.schema, False, MAX_BLOCK
        )
        return flagged.filter("_open IS NULL").select(names).unionByName(moved)

    def home(self, df: DataFrame, nearest_of: int | None = None) -> DataFrame:
        """``df`` with its leaf as ``cell``.

        With ``nearest_of`` = k it also has ``limit``, an upper bound of the
        distance to the k-th nearest row of the tree's own table (infinite where
        no level has k pivots): pivots are rows of that table.
        """
        rows = df.withColumn("cell", F.lit(0).cast("long"))
        if nearest_of is None:
            return self.route(rows, _nearest)
        k = nearest_of

        def choose(far, radii, slack, given):
            rows = np.arange(len(far))
            limit = given["limit"]
            if far.shape[1] >= k:
                limit = np.minimum(limit, np.partition(far, k - 1, axis=1)[:, k - 1] + slack)
            return rows, far.argmin(1), {"limit": limit}

        return self.route(rows.withColumn("limit", F.lit(float("inf"))), choose, ["limit"])

    def visit(self, df: DataFrame, reach: float | None = None) -> DataFrame:
        """``df`` once for each leaf that may hold a row within ``reach``, or within the row's own ``limit``."""

        def choose(far, radii, slack, given):
            limit = np.full((len(far), 1), reach) if reach is not None else given["limit"][:, None]
            near = (far - far.min(1, keepdims=True) <= 2.0 * limit + slack) & (far <= radii[None, :] + limit + slack)
            i, j = np.nonzero(near)
            return i, j, {}

        return self.route(df.withColumn("cell", F.lit(0).cast("long")), choose)


def prunes(tree: PivotTree, rows: DataFrame, n: int, block: int, reach: float | None = None) -> bool:
    """Whether ``rows`` visit few of the leaves over ``n`` rows, by a sample: else cutting all into blocks copies and compares less."""
    asked = rows.count()
    some = materialise(rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(asked // SAMPLE, 1))) == 0).limit(SAMPLE))
    visits = tree.visit(some, reach).count() / max(some.count(), 1)
    discard(some)
    return visits <= MAX_VISITS and visits * block * LEAST_GAIN <= n


def _nearest(far, radii, slack, given):
    return np.arange(len(far)), far.argmin(1), {}


def grow(items: DataFrame, metric, block: int = MAX_BLOCK, held_bytes: int = BROADCAST_BYTES) -> PivotTree | None:
    """The tree over durable ``items`` ``(id, item)``; ``None`` if they fill fewer than two blocks.

    Level by level, each cell of more than ``block`` rows takes sample rows of
    its own as pivots, at most ``FAN`` and one for each block, and its rows go
    to their nearest one. Only rows of open cells are written again. A cell that
    does not shrink (equal items) stays as it is. The levels together hold about
    one pivot a block; their bytes are measured before a level is sent to all tasks.
    """
    n = items.count()
    if n < 2 * block:
        return None
    rows = items.select("id", "item").withColumn("cell", F.lit(0).cast("long"))
    sizes = items.sparkSession.createDataFrame([(0, n)], "cell long, n long")
    levels: list[Level] = []
    first = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
    for depth in range(MAX_LEVELS):
        # Spark cuts every cell to FAN rows before the shuffle.
        ranked = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= FAN)
        picked = lookup_join(ranked, sizes, "cell", "id", bytes_per_row=16).filter(F.col("k") <= F.ceil(F.col("n") / block))
        picked = materialise(picked.select("cell", (F.col("cell") * FAN + F.col("k")).alias("child"), "item", F.lit(0.0).alias("radius")))
        seen = picked.agg(F.sum(F.size("item") * 8 + 48)).first()[0] or 0
        bare = Level(picked, picked.toArrow() if seen <= held_bytes else None)
        tree = PivotTree(metric, levels)

        def choose(far, radii, slack, given):
            cell = far.argmin(1)
            return np.arange(len(far)), cell, {"far": far[np.arange(len(far)), cell]}

        routed = tree.route(rows.withColumn("far", F.lit(0.0)), choose, ["far"], [bare])
        routed = materialise(routed)
        stats = materialise(routed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")))
        known = picked.drop("radius").join(stats.select(F.col("cell").alias("child"), "radius"), "child")  # empty cells go
        known = materialise(known.select("cell", "child", "item", "radius"))
        levels.append(Level(known, known.toArrow() if seen <= held_bytes else None))
        discard(picked)
        parents = sizes.select(F.col("cell").alias("up"), F.col("n").alias("of"))
        sizes = stats.filter(F.col("n") > block).withColumn("up", F.expr(f"(cell - 1) div {FAN}")).join(parents, "up")
        sizes = materialise(sizes.filter(F.col("n") < F.col("of")).select("cell", "n"))
        if depth:
            discard(rows)
        if sizes.isEmpty():
            break
        rows = materialise(lookup_join(routed.drop("far"), sizes.select("cell"), "cell", "id", bytes_per_row=16).select("id", "item", "cell"))
        discard(routed)
    return PivotTree(metric, levels)


class TreeCells:
    """Cell layout of a threshold join: the left side at home, the right side in every leaf within reach."""

    single, bounded = False, False

    def __init__(self, tree: PivotTree, reach: float):
        self.tree, self.reach = tree, reach

    def left(self, df: DataFrame) -> DataFrame:
        return self.tree.home(df)

    def right(self, df: DataFrame) -> DataFrame:
        return self.tree.visit(df, self.reach)

    def halves(self, df: DataFrame) -> None:
        """Rows are copied into other cells than their home: both orders are needed."""

    @staticmethod
    def owned(cell: int, a, b) -> np.ndarray | None:
        return None
