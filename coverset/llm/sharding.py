"""Reproducible shuffle into shards: a Feistel permutation of global row numbers. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverset.llm.common import unused
from coverset.session import materialise

# Round keys, multipliers and modulus of the round function (fixed values; squares stay exact in a double).
KEYS = (1013904, 22695477, 1664525, 13477581)
MULTIPLIERS = (48271, 69621)
PRIME = 67108859


def sides(n: int) -> tuple[int, int]:
    """Two factors whose product is at least ``n`` and exceeds it by less than the first."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mix(x: Column, key: int) -> Column:
    """Round function: two affine steps, each squared, modulo a prime. ``x`` stands in it once."""
    for m in MULTIPLIERS:
        x = (F.pow(((x % PRIME) * m + key) % PRIME, F.lit(2)).cast("long") + key) % PRIME
    return x


def _div(x: Column, m: int) -> Column:
    """Whole division, as an integer operation."""
    return F.call_function("div", x, F.lit(m).cast("long"))


def _rounds(df: DataFrame, name: str, a: int, b: int, seed: int, back: bool) -> DataFrame:
    """Four rounds on (x div b, x mod b), a column each: either half in turn is shifted by a function of the other."""
    left, right = unused("_left", df.columns), unused("_right", df.columns)
    df = df.withColumns({left: _div(F.col(name), b), right: F.col(name) % b})
    steps = list(enumerate(KEYS))
    for k, key in reversed(steps) if back else steps:
        own, other, m = (left, right, a) if k % 2 == 0 else (right, left, b)
        move = _mix(F.col(other) + seed, key) % m
        df = df.withColumn(own, (F.col(own) + (F.lit(m) - move if back else move)) % m)
    return df.withColumn(name, F.col(left) * b + F.col(right)).drop(left, right)


def permuted(df: DataFrame, source: str, n: int, name: str, seed: int = 0, back: bool = False) -> DataFrame:
    """``df`` with ``name``: the place of row number ``source`` among ``n``; ``back`` undoes it.

    The rounds permute a domain of ``a * b >= n`` numbers. A number that lands
    outside ``n`` walks on along its cycle until it is inside, which is again a
    permutation of the ``n``. Fewer than ``sqrt(n) + 1`` numbers are outside, so
    nearly every row is done after one pass; the few others are passed again.
    """
    df = df.withColumn(name, F.col(source).cast("long"))
    if n <= 1:
        return df
    a, b = sides(n)
    made = _rounds(df, name, a, b, seed, back)
    if a * b == n:
        return made
    made = materialise(made)
    inside, outside = made.filter(F.col(name) < n), made.filter(F.col(name) >= n)
    while not outside.isEmpty():
        moved = materialise(_rounds(outside, name, a, b, seed, back))
        inside, outside = inside.unionByName(moved.filter(F.col(name) < n)), moved.filter(F.col(name) >= n)
    return inside


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``row_no``, gapless from 0 in the given order, without passing a single task.

    Rows are range-partitioned and sorted; a row's number is its place in its
    partition plus the rows of the partitions before it (one small row each).
    The sorted rows are written first, so that numbers outlive a lost executor.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(2**33 - 1))))
    sizes = placed.groupBy("_part").count()
    before = F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    # As many rows as partitions, whatever the table's size.
    return placed.join(F.broadcast(starts), "_part").withColumn("row_no", F.col("_at") + F.col("_start")).drop("_at", "_part", "_start")


def assign(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, row_no, place, law, shard, slot, grown_shard)`` for every row.

    Law ``rows``: shard and slot are remainder and quotient of the permuted row
    number, so shard sizes differ by one row at most and both follow from the
    row number alone (and back, with ``permuted(..., back=True)``). Rows are
    numbered by id, then size, checksum; rows equal in all three are
    interchangeable. Null ids come first; a null text has no bytes. Shards may
    exceed the rows: the last ones are then empty. Other columns are not read.
    """
    body = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit(b""))).alias("text_crc32"),
    )
    rows = numbered(materialise(rows), "doc_id", "size", "text_crc32")
    n = rows.count()
    placed = permuted(rows, "row_no", n, "place", seed)
    return placed.select(
        "doc_id", "size", "text_crc32", "row_no", "place", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), _div(F.col("place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
