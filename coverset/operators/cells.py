"""Bounded block pairs: the shared shape of every distance join.

Rows are first put into *cells* so that only rows of a common cell can be
partners, then every cell is cut into blocks of limited size and each pair of
blocks is one small group. A hot cell therefore becomes many equal tasks
instead of one large one, and kernels reduce their block pair before anything
is shuffled on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from coverset.functions.metrics import BitSets, Tanimoto, align_sets, metric_named, pack_sets, unpack_sets
from coverset.session import lookup_join, materialise

MIN_BLOCK, MAX_BLOCK = 256, 2048
# Bytes of a block that a task holds while it reads the opposite one, bytes of a row beside its item, and partitions of a block join at most.
TILE_BYTES, ROW_BYTES, MAX_PARTS = 48 << 20, 64, 4000
# Partitions for each core at most where there are many cells.
CELL_PARTS = 32
# Copies of a row, one for each rare bit, that are made for small blocks too.
FEW_COPIES = 8
# Kernel results that are kept before they are combined.
COMBINE_ROWS = 500_000
MAX_UNIVERSE = 65_536
# Room for any 31-bit position in the lower part of a cell's number; the size band is above.
PREFIX_SHIFT = 32

Kernel = Callable[[pa.Table, pa.Table], pa.Table]
Combine = Callable[[pa.Table], pa.Table]


def struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def _share(block_rows: int | None, cores: int, once: bool = False) -> float:
    """Blocks of a cell that keep all cores busy; twice as many if a block size was asked for, or if there are no mirror images."""
    return math.sqrt(2.0 * cores) * (1.0 if block_rows is None and not once else 2.0)


def tile_rows(n: int, block_rows: int | None, cores: int, row_bytes: float = ROW_BYTES, once: bool = False) -> int:
    """Rows of a block in a cell of ``n`` rows."""
    return max(block_rows or MIN_BLOCK, min(int(TILE_BYTES / row_bytes), math.ceil(n / _share(block_rows, cores, once))))


def _item_type(df: DataFrame) -> str:
    return dict(df.dtypes).get("item", "")


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row as a task holds it; sets are packed."""
    kind, size = _item_type(df), F.greatest(F.size("item"), F.lit(0)) if "item" in df.columns else F.lit(0)
    if kind == "array<int>":
        return F.least(size * 4, F.greatest(F.coalesce(F.array_max("item"), F.lit(0)), F.lit(0)) / 8 + 1) + ROW_BYTES
    return (size * 8 if kind.startswith("array") else F.lit(0)) + ROW_BYTES


def packed(df: DataFrame) -> DataFrame:
    """``df`` with its sets as bytes; other items stay as they are."""
    if _item_type(df) != "array<int>":
        return df
    at = df.columns.index("item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, "item", pack_sets(batch.column(at)))

    return df.mapInArrow(run, StructType([StructField(f.name, BinaryType() if f.name == "item" else f.dataType) for f in df.schema]))


def _aligned(table: pa.Table) -> pa.Table:
    """Packed sets as bitmaps of one length and in order of their size, so that the kernel's tiles hold sets of like size; other items as they are."""
    at = table.schema.get_field_index("item")
    if at < 0 or not pa.types.is_binary(table.schema.field(at).type):
        return table
    made = align_sets(table.column(at))
    if made is None:
        return table
    order = np.argsort(Tanimoto().load(made).sizes, kind="stable")
    return table.set_column(at, "item", made).take(pa.array(order))


def opened(table: pa.Table) -> pa.Table:
    """``table`` with its packed sets as the metric loads them."""
    at = table.schema.get_field_index("item")
    if at < 0 or not pa.types.is_binary(table.schema.field(at).type):
        return table
    return table.set_column(at, "item", unpack_sets(table.column(at)))


def blocked(
    left: DataFrame,
    right: DataFrame,
    kernel: Kernel,
    schema: str | StructType,
    bounded_cells: bool = True,
    block_rows: int | None = None,
    one_cell: bool = False,
    once: bool = False,
    combine: Combine | None = None,
) -> DataFrame:
    """Run ``kernel`` on every pair of blocks of equal ``cell``.

    Both sides carry ``cell`` and ``id``. ``bounded_cells`` states that the
    number of cells is limited by construction, so their sizes may be broadcast.
    ``one_cell`` says that all rows share a cell: two counts replace the sizes.
    ``once`` (both sides one table with the same cells) leaves out the mirror
    image of every block pair.

    A row is copied once for each opposite block, so blocks are as large as the
    cores' share and a task's memory (``TILE_BYTES``) allow, at least
    ``block_rows``; sets travel as bitmaps where these are shorter. A task holds the left block, reads the right one in pieces and
    hands the kernel at most ``MAX_BLOCK`` rows of either. ``combine`` shortens what
    the kernel returned for several pieces.
    """
    spark = left.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, 1)
    spread = F.ceil(F.greatest("n_left", "n_right") / F.lit(_share(block_rows, cores, once)))
    most = F.floor(F.lit(TILE_BYTES) / F.greatest("w_left", "w_right"))
    rows = F.greatest(F.lit(block_rows or MIN_BLOCK), F.least(most, spread))
    sizes = None if one_cell else (
        left.groupBy("cell").agg(F.count("*").alias("n_left"), F.avg(row_bytes(left)).alias("w_left"))
        .join(right.groupBy("cell").agg(F.count("*").alias("n_right"), F.avg(row_bytes(right)).alias("w_right")), "cell")
        .select(
            "cell",
            F.ceil(F.col("n_left") / rows).cast("int").alias("left_blocks"),
            F.ceil(F.col("n_right") / rows).cast("int").alias("right_blocks"),
        )
    )

    blocks, groups, most_parts = {}, 0, MAX_PARTS
    if sizes is not None:
        sizes = materialise(sizes)  # read to be measured and joined twice
        groups, most_parts = sizes.agg(F.sum(F.col("left_blocks").cast("long") * F.col("right_blocks"))).first()[0] or 0, CELL_PARTS * cores
    if one_cell:
        (n_left, w_left), (n_right, w_right) = (d.agg(F.count("*"), F.avg(row_bytes(d))).first() for d in (left, right))
        fixed = tile_rows(max(n_left, n_right), block_rows, cores, max(w_left or ROW_BYTES, w_right or ROW_BYTES), once)
        blocks = {"left_blocks": math.ceil(n_left / fixed), "right_blocks": math.ceil(n_right / fixed)}
        groups = blocks["left_blocks"] * blocks["right_blocks"]

    def spread_over(side: DataFrame, mine: str, theirs: str, own: str, other: str) -> DataFrame:
        side = packed(side)
        if one_cell:
            placed = side.withColumns({name: F.lit(max(n, 1)) for name, n in blocks.items()})
        elif bounded_cells:
            placed = side.join(F.broadcast(sizes), "cell")
        else:
            placed = lookup_join(side, sizes, "cell", "id", bytes_per_row=32)
        # Fresh column identities: both sides may stem from one table.
        placed = placed.select(*[F.col(c).alias(c) for c in placed.columns])
        placed = placed.withColumn(own, F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"))
        first, last = F.lit(0), F.col(theirs) - 1
        if once:
            first, last = (F.col(own), last) if own == "left_block" else (first, F.col(own))
        return placed.withColumn(other, F.explode(F.sequence(first, last))).drop("left_blocks", "right_blocks")

    keys = ["cell", "left_block", "right_block"]
    a = spread_over(left, "left_blocks", "right_blocks", "left_block", "right_block").withColumn("_side", F.lit(0))
    b = spread_over(right, "right_blocks", "left_blocks", "right_block", "left_block").withColumn("_side", F.lit(1))
    out = struct(schema) if isinstance(schema, str) else schema
    # By number, as few bytes may be much work; several partitions a group, or two groups would often share one.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * cores, min(3 * groups, most_parts))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.select(*keys, "_side", *[c for c in both.columns if c not in (*keys, "_side")])
    both = both.repartition(parts, *keys).sortWithinPartitions(*keys, "_side")
    return both.mapInArrow(_block_pairs(kernel, to_arrow_schema(out), combine), out)


def _block_pairs(kernel: Kernel, schema: pa.Schema, combine: Combine | None):
    """The kernel over each run of one cell and block pair; the left rows of a run come first."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        for batch in batches:
            named = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            change = np.zeros(max(batch.num_rows - 1, 0), bool)
            for values in named:
                change |= values[1:] != values[:-1]
            bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi > lo:
                    yield tuple(int(v[lo]) for v in named), pa.Table.from_batches([batch.slice(lo, hi - lo)])

    def cut(parts: list[pa.Table]) -> list[pa.Table]:
        whole = pa.concat_tables(parts).combine_chunks()
        # A kernel that hands items on needs them as lists.
        whole = whole if "item" in schema.names else _aligned(whole)
        return [whole.slice(lo, MAX_BLOCK).combine_chunks() for lo in range(0, whole.num_rows, MAX_BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, theirs, made = None, [], [], []

        def out(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            for table in tables:
                yield from table.cast(schema).to_batches(max_chunksize=65_536)

        def shorter() -> None:
            made[:] = [combine(pa.concat_tables(made))]

        def compare() -> Iterator[pa.RecordBatch]:
            right, theirs[:] = cut(theirs), []
            for y in map(opened, right):
                for x in mine:
                    found = kernel(opened(x), y).cast(schema)
                    if combine is None:
                        yield from out([found])
                    else:
                        made.append(found)
                        if len(made) > 1 and sum(t.num_rows for t in made) > max(COMBINE_ROWS, 4 * made[0].num_rows):
                            shorter()

        def close() -> Iterator[pa.RecordBatch]:
            if theirs and mine:
                yield from compare()
            if made:
                shorter()
                yield from out(made)
                made.clear()

        for key, part in pieces(batches):
            if now is None or now[:3] != key[:3]:
                yield from close()
                mine, theirs = [], []
            if key[3]:
                if now is not None and now[:3] == key[:3] and not now[3]:
                    mine = cut(mine)
                if now is not None and now[:3] == key[:3] and mine:
                    theirs.append(part)
                    if sum(t.num_rows for t in theirs) >= MAX_BLOCK:
                        yield from compare()
            else:
                mine.append(part)
            now = key
        yield from close()

    return run


def summed(keys: list[str], values: list[str]) -> Combine:
    """Kernel results with equal ``keys`` as one row of sums."""

    def run(made: pa.Table) -> pa.Table:
        done = made.group_by(keys, use_threads=False).aggregate([(v, "sum") for v in values])
        return pa.table({c: done[c if c in keys else f"{c}_sum"] for c in made.column_names}).cast(made.schema)

    return run


class OneCell:
    """Every row may pair with every row: only the block cut applies."""

    single, bounded = True, True

    def left(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cell", F.lit(0).cast("long"))

    right = left

    def halves(self, df: DataFrame):
        """``(left, right, cross)`` joins that see each unordered pair once: within cells, and (``cross``) between cells."""
        return [(self.left(df), self.right(df), False)]

    def owned(self, cell: int, a, b) -> np.ndarray | None:
        return None


class BitCells:
    """Cells of on-bit sets by size band and, for crowded bands, by rare bit.

    Sets with similarity ``t`` or more have sizes within a factor ``t``, and
    share a bit among the ``n - ceil(t n) + 1`` rarest bits of each. Bits are
    renumbered from rare to common; a band is split by those bits when that
    copies rows less often than cutting the band into blocks would, or few times.
    """

    single, bounded = False, True

    def __init__(self, cutoff: float, ranks: list[int] | None, split: list[int], existing: list[int]):
        self.similar = 1.0 - cutoff
        self.ranks = ranks
        self.split = split
        self.existing = existing

    @staticmethod
    def band(size: Column, similar: float) -> Column:
        width = max(-math.log(similar) * (1.0 + 1e-9), 1e-3)
        return F.floor(F.log(size.cast("double")) / F.lit(width)).cast("int")

    def _ranked(self, df: DataFrame) -> DataFrame:
        df = df.filter(F.size("item") > 0)
        if self.ranks is None:
            return df.withColumn("item", F.array_sort("item"))
        order = F.lit(self.ranks)
        return df.withColumn(
            "item", F.array_sort(F.transform("item", lambda bit: F.get(order, bit))).cast("array<int>")
        )

    def _cells(self, band: Column) -> Column:
        size = F.size("item")
        prefix = F.slice("item", 1, size - F.ceil(size * self.similar - 1e-9).cast("int") + 1)
        base = F.shiftleft(band.cast("long"), PREFIX_SHIFT)
        whole = F.array(base)
        if not self.split:
            return whole
        by_bit = F.transform(prefix, lambda rank: base + rank.cast("long") + 1)
        return F.when(band.isin(self.split), by_bit).otherwise(whole)

    def left(self, df: DataFrame) -> DataFrame:
        df = self._ranked(df).withColumn("_band", self.band(F.size("item"), self.similar))
        return df.withColumn("cell", F.explode(self._cells(F.col("_band")))).drop("_band")

    def right(self, df: DataFrame) -> DataFrame:
        own = self.band(F.size("item"), self.similar)
        return self._in_bands(df, F.array(own - 1, own, own + 1))

    def halves(self, df: DataFrame):
        """Rows meet those of their own band, and those of the next one."""
        own = self.band(F.size("item"), self.similar)
        return [(self.left(df), self.left(df), False), (self.left(df), self._in_bands(df, F.array(own - 1)), True)]

    def _in_bands(self, df: DataFrame, bands: Column) -> DataFrame:
        df = self._ranked(df).withColumn("_band", F.explode(bands))
        df = df.filter(F.col("_band").isin(self.existing))
        return df.withColumn("cell", F.explode(self._cells(F.col("_band")))).drop("_band")

    def owned(self, cell: int, a, b) -> np.ndarray | None:
        """True where this cell's bit is the first rare bit both rows share."""
        rank = (cell & ((1 << PREFIX_SHIFT) - 1)) - 1
        if rank <= 0:
            return None

        def rarer(block):
            length = block.sizes - np.ceil(block.sizes * self.similar - 1e-9).astype(np.int64) + 1
            rows = block.rows()
            place = np.arange(len(block.values)) - np.repeat(block.offsets[:-1], block.sizes)
            keep = (place < length[rows]) & (block.values < rank)
            sizes = np.bincount(rows[keep], minlength=len(block))
            return BitSets(np.concatenate([[0], np.cumsum(sizes)]), block.values[keep])

        return Tanimoto().shared(rarer(a), rarer(b)) == 0


def cells_for(items: DataFrame, metric: str, cutoff: float, block_rows: int | None = None):
    """Cell layout for pairs of ``items`` within ``cutoff``."""
    m = metric_named(metric)
    block = block_rows or MAX_BLOCK
    cores = max(items.sparkSession.sparkContext.defaultParallelism, 1)
    if m.name == "tanimoto":
        if not 0.0 < cutoff < 1.0:
            if cutoff <= 0.0:
                cutoff = 1e-9
            else:
                return OneCell()
        sized = items.filter(F.size("item") > 0).select(
            BitCells.band(F.size("item"), 1.0 - cutoff).alias("band"), F.size("item").alias("n"), "item"
        )
        bands = {
            r["band"]: r
            for r in sized.groupBy("band").agg(
                F.count("*").alias("rows"), F.avg("n").alias("n"), F.max(F.array_max("item")).alias("top"), F.avg(row_bytes(sized)).alias("bytes")
            ).collect()
        }
        split = []
        for k in bands:
            partners = sum(bands[o]["rows"] for o in (k - 1, k, k + 1) if o in bands)
            # One copy for each rare bit, or for each block that the band is cut into; a few copies save comparisons anyway.
            copies = cutoff * bands[k]["n"] + 1
            if partners / (block if copies <= FEW_COPIES else tile_rows(partners, block_rows, cores, bands[k]["bytes"])) > copies:
                split.append(k)
        top = max((r["top"] for r in bands.values()), default=0)
        ranks = None
        if split and top < MAX_UNIVERSE:
            counts = dict(
                (r["bit"], r["rows"])
                for r in items.select(F.explode("item").alias("bit")).groupBy("bit").agg(F.count("*").alias("rows")).collect()
            )
            order = sorted(range(top + 1), key=lambda bit: (counts.get(bit, 0), bit))
            ranks = [0] * (top + 1)
            for place, bit in enumerate(order):
                ranks[bit] = place
        return BitCells(cutoff, ranks, sorted(split), sorted(bands))
    if not math.isfinite(m.bound_cutoff(cutoff)):
        return OneCell()
    # Cells of the tree join in this module, so it is only known here.
    from coverset.operators.pivots import TreeCells, grow, prunes

    tree, reach = grow(items, m, block), m.bound_cutoff(cutoff)
    return TreeCells(tree, reach) if tree and prunes(tree, items, items.count(), block, reach) else OneCell()
