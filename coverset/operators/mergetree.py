"""The merge tree of density clustering as tables: built by halving ranks, summed by contraction, searched by doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverset.operators.assignment import dense_index
from coverset.operators.components import SMALL_EDGES, component_roots
from coverset.session import discard, lookup_join, materialise

# Splits whose ranks share a range of this size are put together in one task.
RANGE = 1 << 16
# Level of a zero distance, so that 1 / level stays finite.
TINY = 1e-12


def rate(level: Column) -> Column:
    return 1.0 / F.greatest(level, F.lit(TINY))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join components along the edges of one range in rank order; an edge is the parent of what it joins."""
    rows = pa.Table.from_batches(list(batches))
    if rows.num_rows == 0:
        return
    columns = {c: rows[c].to_numpy() for c in ("rank", "u", "v", "u_top", "v_top")}
    order = np.argsort(columns["rank"])
    ends, at = np.unique(np.concatenate([columns["u"], columns["v"]]), return_inverse=True)
    left, right = at[: len(order)], at[len(order) :]
    root, top = list(range(len(ends))), [0] * len(ends)
    for place, node in zip(left.tolist() + right.tolist(), columns["u_top"].tolist() + columns["v_top"].tolist()):
        top[place] = node

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    child, parent = [], []
    for k in order.tolist():
        x, y, rank = find(int(left[k])), find(int(right[k])), int(columns["rank"][k])
        child += [top[x], top[y]]
        parent += [rank, rank]
        root[y] = x
        top[x] = rank
    yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(parent, pa.int64())], names=["node", "parent"])


def merge_tree(splits: DataFrame, n: int, size: int = RANGE, small_edges: int = SMALL_EDGES) -> DataFrame:
    """``(node, parent)`` of the tree that joins components along ``splits`` ``(rank, u, v)``, ranks 0 to ``n - 1``.

    ``u`` and ``v`` count the leaves from 0. Node ``rank`` is a split, node
    ``-1 - leaf`` a leaf. The ranks are halved until a range has at most
    ``size``: the edges of the lower half join components, which are single
    vertices for the upper half, each standing for its last edge; both halves
    go on at once, so the rounds grow with the logarithm of the splits, however
    deep the tree is. Edges move between tables only.
    """
    edges = materialise(
        splits.select("rank", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), (-1 - F.col("u")).cast("long").alias("u_top"), (-1 - F.col("v")).cast("long").alias("v_top"))
    )
    bits = max(0, (max(n, 1) - 1).bit_length() - (size.bit_length() - 1))
    for bit in reversed(range(size.bit_length() - 1, size.bit_length() - 1 + bits)):
        upper = F.shiftright(F.col("rank"), bit) % 2 == 1
        low, high = edges.filter(~upper), edges.filter(upper)
        # Fresh names, so that the vertices of the two halves differ.
        kept = low.withColumns({e: F.col(e) * 2 for e in ("u", "v")})
        if not low.isEmpty() and not high.isEmpty():
            roots = materialise(component_roots(materialise(low.select(F.col("u").alias("a"), F.col("v").alias("b"))), small_edges))
            last = lookup_join(low.select(F.col("u").alias("label"), "rank"), roots, "label", "rank", 32).groupBy("root").agg(F.max("rank").alias("last"))
            joined = materialise(lookup_join(roots, last, "root", "label", 32))
            for e in ("u", "v"):
                ends = joined.select(F.col("label").alias(e), F.col("root").alias("to"), "last")
                high = lookup_join(high, ends, e, "rank", 48, "left")
                high = high.withColumn(f"{e}_top", F.coalesce("last", f"{e}_top")).withColumn(e, F.coalesce("to", e)).drop("to", "last")
        names = ["rank", "u", "v", "u_top", "v_top"]
        fresh = materialise(kept.select(names).unionByName(high.withColumns({e: F.col(e) * 2 + 1 for e in ("u", "v")}).select(names)))
        discard(edges)
        edges = fresh
    # A range is one task's rows: its size is bounded by the range itself.
    ranges = edges.withColumn("range", (F.col("rank") / size).cast("int"))
    made = ranges.groupBy("range").applyInArrow(_merge_group, "node long, parent long")
    return materialise(made)


def _merge_group(rows: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_merge(iter(rows.to_batches()))))


def contract(nodes: DataFrame, offset: str, floor: str | None = None) -> DataFrame:
    """``(node, value)``: for leaves their ``offset``, else ``max(floor, sum of the children's values + offset)``.

    Without ``floor`` these are subtree sums. Tree contraction: a node whose
    children all have values takes its own; one with a single open child is a
    function ``max(a, x + b)`` of that child, and functions along a chain are
    composed two by two, so a deep tree takes as few rounds as a flat one.
    """
    low = F.col(floor).cast("double") if floor else F.lit(float("-inf"))
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open"))
    leafless = nodes.select("node", "parent", low.alias("a"), F.col(offset).cast("double").alias("b")).join(kids, "node", "left")
    leaf = F.col("open").isNull()
    state = materialise(
        leafless.select(
            "node", "parent", "a", "b", F.coalesce("open", F.lit(0)).alias("open"), F.lit(None).cast("long").alias("next"),
            F.when(leaf, F.col("b")).alias("value"), leaf.alias("fresh"),
        )
    )
    while not state.filter("value IS NULL").isEmpty():
        given = state.filter("fresh AND parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("value").alias("more"), F.count("*").alias("done"))
        only = state.filter("value IS NULL AND parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("only"))
        one = state.join(given, "node", "left").join(only, "node", "left")
        waits = F.col("value").isNull() & F.col("next").isNull()
        one = one.withColumn("b", F.when(waits, F.col("b") + F.coalesce("more", F.lit(0.0))).otherwise(F.col("b")))
        one = one.withColumn("open", F.when(waits, F.col("open") - F.coalesce("done", F.lit(0))).otherwise(F.col("open")))
        done = waits & (F.col("open") == 0)
        one = one.withColumn("now", F.when(done, F.greatest("a", "b")))
        one = one.withColumn("next", F.when(waits & (F.col("open") == 1), F.col("only")).otherwise(F.col("next")))
        one = materialise(one.select("node", "parent", "a", "b", "open", "next", F.coalesce("value", "now").alias("value"), F.col("now").isNotNull().alias("fresh")))
        ahead = one.select(F.col("node").alias("next"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("next").alias("next2"), F.col("value").alias("value2"))
        two = one.join(ahead, "next", "left")
        open_ = F.col("value").isNull() & F.col("next").isNotNull()
        ends = open_ & F.col("value2").isNotNull()
        chain = open_ & F.col("value2").isNull() & F.col("next2").isNotNull()
        two = two.select(
            "node", "parent",
            F.when(chain, F.greatest(F.col("a"), F.col("a2") + F.col("b"))).otherwise(F.col("a")).alias("a"),
            F.when(chain, F.col("b") + F.col("b2")).otherwise(F.col("b")).alias("b"), "open",
            F.when(chain, F.col("next2")).otherwise(F.col("next")).alias("next"),
            F.when(ends, F.greatest(F.col("a"), F.col("value2") + F.col("b"))).otherwise(F.col("value")).alias("value"),
            (F.col("fresh") | ends).alias("fresh"),
        )
        fresh = materialise(two)
        discard(state)
        discard(one)
        state = fresh
    return state.select("node", "value")


def highest(nodes: DataFrame) -> DataFrame:
    """``(node, chosen)``: the highest node with ``keep`` among a node and its ancestors, null if none; by doubling."""
    state = materialise(nodes.select("node", F.col("parent").alias("up"), F.when(F.col("keep"), F.col("node")).alias("chosen")))
    while not state.filter("up IS NOT NULL").isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("chosen").alias("chosen2"))
        moved = lookup_join(state, above, "up", "node", 32, "left")
        fresh = materialise(moved.select("node", F.col("up2").alias("up"), F.coalesce("chosen2", "chosen").alias("chosen")))
        discard(state)
        state = fresh
    return state.select("node", "chosen")


def climb(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` ``(id, node, level)`` with ``node`` moved to the highest ancestor whose ``key`` is below ``level``.

    Only rows whose node's parent is below their level move; they go up by
    powers of two, the longest first.
    """
    up = nodes.filter("parent IS NOT NULL").select("node", "parent").join(
        nodes.select(F.col("node").alias("parent"), F.col("key").alias("above")), "parent"
    ).select("node", F.col("parent").alias("up"), "above")
    up = materialise(up)
    first = materialise(lookup_join(rows, up, "node", "id", 64, "left").withColumn("moves", F.coalesce(F.col("above") < F.col("level"), F.lit(False))).drop("up", "above"))
    still, moving = first.filter("NOT moves").drop("moves"), first.filter("moves").drop("moves")
    if moving.isEmpty():
        return still
    jumps = [up]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        jumps.append(materialise(last.select("node", F.col("up").alias("mid")).join(last.select(F.col("node").alias("mid"), "up", "above"), "mid").select("node", "up", "above")))
    for table in reversed(jumps[:-1]):
        moved = lookup_join(moving, table, "node", "id", 64, "left")
        goes = F.coalesce(F.col("above") < F.col("level"), F.lit(False))
        moving = materialise(moved.select("id", F.when(goes, F.col("up")).otherwise(F.col("node")).alias("node"), "level"))
    return still.unionByName(moving)


def clusters_by_tables(
    segments: DataFrame, levels: DataFrame, splits: DataFrame, size: int = RANGE, small_edges: int = SMALL_EDGES
) -> DataFrame:
    """``(id, cluster_id)`` by excess of mass, with the merge tree as a table.

    ``segments`` ``(id, comp)``, ``levels`` ``(id, level)`` and ``splits``
    ``(w, a, b, comp_a, comp_b)`` are durable. Neither the tree nor its sums
    come to the driver or are sent to every task.
    """
    leaves = materialise(dense_index(splits.select(F.col("comp_a").alias("comp")).unionByName(splits.select(F.col("comp_b").alias("comp"))).distinct(), [F.col("comp")], "leaf"))
    ranked = materialise(dense_index(splits.select("w", "a", "b", "comp_a", "comp_b"), [F.col("w"), F.col("a"), F.col("b")], "rank"))
    n = ranked.count()
    named = ranked
    for end, column in (("a", "u"), ("b", "v")):
        ends = leaves.select(F.col("comp").alias(f"comp_{end}"), F.col("leaf").alias(column))
        named = lookup_join(named, ends, f"comp_{end}", "rank", 32)
    tree = merge_tree(named.select("rank", "u", "v"), n, size, small_edges)
    born = ranked.select(F.col("rank").alias("node"), F.struct("w", "a", "b").alias("key"))
    nodes = tree.unionByName(tree.sparkSession.createDataFrame([(n - 1, None)], tree.schema)).join(born, "node", "left")
    nodes = materialise(nodes.select("node", "parent", "key"))
    rows = lookup_join(segments.join(levels, "id"), leaves, "comp", "id", 32).select("id", (-1 - F.col("leaf")).cast("long").alias("node"), "level")
    placed = materialise(climb(rows, nodes))
    mass = placed.groupBy("node").agg(F.count("*").alias("n"), F.sum(rate(F.col("level.w"))).alias("mass"), F.min("id").alias("low"))
    deaths = nodes.select(F.col("node").alias("parent"), F.col("key.w").alias("death"))
    sized = materialise(nodes.join(mass, "node", "left").join(deaths, "parent", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "mass")}))
    total = contract(sized, "n").withColumnRenamed("value", "size")
    known = sized.join(total, "node")
    # Mass of rows that leave a node directly, of those its children hand on at its birth, less all at its death.
    own = F.col("mass") + F.when(F.col("key").isNotNull(), (F.col("size") - F.col("n")) * rate(F.col("key.w"))).otherwise(0.0)
    known = known.withColumn("own", F.when(F.col("parent").isNotNull(), own - F.col("size") * rate(F.col("death"))).otherwise(F.lit(float("-inf"))))
    leaf = F.col("key").isNull()
    known = materialise(known.select("node", "parent", "low", "own", leaf.alias("leaf"), F.when(leaf, F.col("own")).otherwise(F.lit(0.0)).alias("start")))
    value = contract(known, "start", "own")
    below = known.select("node", "parent").join(value, "node").filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("value").alias("below"))
    keep = F.col("parent").isNotNull() & (F.col("leaf") | (F.col("below") <= F.col("own")))
    chosen = highest(known.join(below, "node", "left").withColumn("keep", keep))
    lowest = known.select("node", "low").join(chosen, "node").filter("chosen IS NOT NULL AND low IS NOT NULL").groupBy("chosen").agg(F.min("low").alias("low"))
    numbers = dense_index(lowest, [F.col("low")], "cluster_id").select("chosen", F.col("cluster_id").cast("long").alias("cluster_id"))
    labels = materialise(chosen.join(numbers, "chosen", "left").select("node", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id")))
    return lookup_join(placed.select("id", "node"), labels, "node", "id", 16).select("id", "cluster_id")
