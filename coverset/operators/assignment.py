"""Cluster assignments: sizes, numbering, and list and label forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverset.operators.quantiles import SMALL_ROWS, ranked_values
from coverset.session import lookup_join, materialise

_LOW = (1 << 33) - 1


def target_size(n: int, ratio: float = 1.0, fixed: int | None = None, clamp: bool = True) -> int:
    """Rows to pick: ``fixed``, else ``ratio`` percent of ``n``, clamped to ``[2, n - 1]``.

    ``clamp=False`` gives the plain truncated share.
    """
    if fixed is not None:
        return fixed
    k = int(n * ratio / 100)
    return max(2, min(k, n - 1)) if clamp else k


def dense_index(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order by a distributed sort.

    Each sorted partition numbers its own rows; only the partition sizes, one
    number per task, pass through the driver.
    """
    placed = materialise(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33).cast("int")
    sizes = placed.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()
    starts, total = {}, 0
    for task_id, n in sorted((r["task"], r["n"]) for r in sizes):
        starts[task_id], total = total, total + n
    table = [starts.get(k, 0) for k in range(max(starts, default=0) + 1)]
    first = F.get(F.lit(table), task).cast("long")
    return placed.withColumn(name, first + F.col("_at").bitwiseAND(F.lit(_LOW))).drop("_at")


def seeded_order(id_col: str, seed: int | str) -> list[Column]:
    """A reproducible random order of ids: MD5 of ``seed:id``, then the id."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.col(id_col)]


def sample_rows(df: DataFrame, n: int = 5000, seed: int = 42, id_col: str = "id", small_rows: int = SMALL_ROWS) -> DataFrame:
    """At most ``n`` rows without replacement, the same ones for the same seed.

    The n-th place in the seeded order is found by counting, and the rows before
    it are a filter: no task gathers the sample. Only rows that share that very
    place (the same first 52 bits of the hash) are ordered among themselves.
    """
    total = df.count()
    if n >= total or n <= 0:
        return df.limit(max(n, 0)) if n <= 0 else df
    order = seeded_order(id_col, seed)
    place = F.coalesce(F.conv(F.substring(order[0], 1, 13), 16, 10).cast("double"), F.lit(-1.0))
    edge = ranked_values(df.select(place.alias("place")), "place", [n - 1], total, small_rows)[0]
    before = df.filter(place < edge)
    return before.unionByName(df.filter(place == edge).orderBy(*order).limit(n - before.count()))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows."""
    return df.limit(n)


def to_labels(df: DataFrame, picks: DataFrame, id_col: str = "id", order_col: str = "pick_order") -> DataFrame:
    """``(id, label)``: the pick order of selected rows, -1 for all others."""
    ranked = picks.select(F.col(id_col).cast("long").alias("id"), F.col(order_col).cast("long").alias("label"))
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    return ids.join(ranked, "id", "left").select("id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


LIST_ROWS = 100_000


def to_lists(assignment: DataFrame, list_rows: int = LIST_ROWS, include_noise: bool = False) -> DataFrame:
    """``(cluster_id, part, members)``: member ids, the centre first.

    A list holds at most ``list_rows`` ids; a larger cluster goes on in further
    parts, so no task has to hold an unbounded list.
    """
    rows = assignment if include_noise else assignment.filter("cluster_id >= 0")
    center = F.col("is_center") if "is_center" in assignment.columns else F.lit(False)
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("n"))
    big = sizes.filter(F.col("n") > list_rows).select("cluster_id", F.ceil(F.col("n") / (list_rows // 2)).alias("parts"))
    placed = lookup_join(rows, big, "cluster_id", "id", bytes_per_row=32, how="left").select(
        "cluster_id",
        F.when(center | F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"),
        F.struct((~center).alias("later"), F.col("id")).alias("member"),
    )
    return placed.groupBy("cluster_id", "part").agg(
        F.transform(F.array_sort(F.collect_list("member")), lambda m: m["id"]).alias("members")
    )


def to_members(assignment: DataFrame, include_noise: bool = False) -> DataFrame:
    """``(cluster_id, rest, id)``: the long form of the lists for clusters of any size; centres have ``rest`` false.

    Ordered by these columns it is the list with its centre first, and no task
    holds a cluster.
    """
    rows = assignment if include_noise else assignment.filter("cluster_id >= 0")
    center = F.col("is_center") if "is_center" in assignment.columns else F.lit(False)
    return rows.select("cluster_id", (~center).alias("rest"), "id")


def from_lists(lists: DataFrame) -> DataFrame:
    """``(id, cluster_id)`` from ``to_lists`` output."""
    return lists.select(F.explode("members").alias("id"), "cluster_id")
