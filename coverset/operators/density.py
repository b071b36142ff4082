"""Density clustering with noise (hierarchical, excess of mass)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from coverset.functions.metrics import as_items, metric_named
from coverset.operators.cells import MAX_BLOCK, OneCell, blocked
from coverset.operators.components import SMALL_EDGES, component_roots, connected_components
from coverset.operators.knn import k_nearest
from coverset.operators.mergetree import TINY, clusters_by_tables, rate as rate_of
from coverset.operators.pivots import PivotTree, grow, prunes
from coverset.session import lookup_join, materialise

EDGE = "struct<w: double, a: bigint, b: bigint>"

# Neighbours listed per row beyond those the core distance needs.
EXTRA_NEIGHBOURS = 8
# Rows that bound the least edge of a component without a known one.
BEACONS = 1024
# Up to so many components (counted) a search returns an edge for each pair of them, else one for each.
FEW_COMPONENTS = 1000
# Rows of a leaf of the searched tree, and rows below which all are compared.
LEAF_ROWS, SEARCH_ROWS = 512, 50_000
# Up to so many splits (counted) are put in order by one local pass; more stay a table.
SMALL_SPLITS = 100_000


def _outgoing(every: bool):
    """Least mutual-reachability edge of each left component, or (``every``) to each other one, no heavier than its ``limit``."""

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        m = metric_named("euclidean")
        # Rows of a component side by side, so that a whole pair of components has one least value.
        x, y = (t.take(pa.array(np.argsort(t["comp"].to_numpy(), kind="stable"))) for t in (x, y))
        a, b = m.load(x["item"]), m.load(y["item"])
        mine, theirs = x["comp"].to_numpy(), y["comp"].to_numpy()
        floor = np.maximum(x["core"].to_numpy()[:, None], y["core"].to_numpy()[None, :])
        slack = 2.0 * m.slack(a, b)
        reach = np.maximum(m.matrix(a, b), floor)
        reach[(mine[:, None] == theirs[None, :]) | (reach > x["limit"].to_numpy()[:, None] + slack)] = np.inf
        first = [np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) for c in (mine, theirs)]
        size = [np.diff(np.append(f, len(c))) for f, c in zip(first, (mine, theirs))]
        low = np.minimum.reduceat(reach, first[0], axis=0)
        low = np.minimum.reduceat(low, first[1], axis=1) if every else low.min(axis=1, keepdims=True)
        low = np.repeat(np.repeat(low, size[1], axis=1) if every else low, size[0], axis=0)
        i, j = np.nonzero((reach <= low + slack) & np.isfinite(reach))
        w = np.maximum(m.exact(a, b, i, j), floor[i, j])
        one, two = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        found = pa.table({"comp": mine[i], "other": theirs[j], "w": w, "a": np.minimum(one, two), "b": np.maximum(one, two)})
        return _least_edges(every)(found.filter(pa.array(w <= x["limit"].to_numpy()[i])))

    return kernel


def _least_edges(every: bool):
    """The least edge of each component, or of each pair, among those that several blocks found."""

    def run(made: pa.Table) -> pa.Table:
        comp, other, w, a, b = (made[c].to_numpy() for c in ("comp", "other", "w", "a", "b"))
        order = np.lexsort((b, a, w, other, comp) if every else (other, b, a, w, comp))
        new = np.ones(len(order), bool)
        new[1:] = comp[order][1:] != comp[order][:-1]
        if every:
            new[1:] |= other[order][1:] != other[order][:-1]
        return made.take(pa.array(order[new]))

    return run


def _merged(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """Least position connected with each of ``n`` positions."""
    parent = np.arange(n)
    while True:
        before = parent.copy()
        low = np.minimum(parent[one], parent[two])
        np.minimum.at(parent, parent[one], low)
        np.minimum.at(parent, parent[two], low)
        while not np.array_equal(parent[parent], parent):
            parent = parent[parent]
        if np.array_equal(before, parent):
            return parent


def _settle(comps: pa.Table, edges: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Join components by their least known edge while no unknown edge can be as light: root positions, edge positions."""
    names, floor = comps["comp"].to_numpy(), comps["floor"].to_numpy().copy()
    w = edges["w"].to_numpy()
    order = np.lexsort((edges["b"].to_numpy(), edges["a"].to_numpy(), w))
    w = w[order]
    one, two = (np.searchsorted(names, edges[c].to_numpy()[order]) for c in ("comp", "other"))
    label, taken, live = np.arange(len(names)), [], np.arange(len(order))
    while True:
        live = live[label[one[live]] != label[two[live]]]
        best = np.full(len(names), len(order))
        np.minimum.at(best, label[one[live]], live)
        np.minimum.at(best, label[two[live]], live)
        known = np.flatnonzero(best < len(order))
        sure = np.unique(best[known[w[best[known]] < floor[known]]])
        if not len(sure):
            return label, taken
        taken.append(order[sure])
        label = _merged(label[one[sure]], label[two[sure]], len(names))[label]
        np.minimum.at(floor, label, floor.copy())


def _contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The least edge of each pair of components that are left after ``comp`` became ``root``."""
    for end in ("comp", "other"):
        named = roots.select(F.col("comp").alias(end), F.col("root").alias("_root"))
        edges = lookup_join(edges, named, end, "a", bytes_per_row=32).withColumn(end, F.col("_root")).drop("_root")
    least = edges.filter("comp <> other").groupBy("comp", "other").agg(F.min(F.struct("w", "a", "b")).alias("edge"))
    return materialise(least.select("comp", "other", "edge.w", "edge.a", "edge.b"))


def _regrouped(comps: DataFrame, roots: DataFrame) -> DataFrame:
    return materialise(comps.join(roots, "comp").groupBy(F.col("root").alias("comp")).agg(F.min("floor").alias("floor"), F.sum("n").alias("n")))


def _all_roots(comps: DataFrame, chosen: DataFrame, small_edges: int) -> DataFrame:
    """``(comp, root)`` of every component after the ``chosen`` edges ``(comp, other)`` joined them."""
    merged = component_roots(chosen.select(F.col("comp").alias("a"), F.col("other").alias("b")), small_edges)
    joined = comps.select("comp").join(merged.withColumnRenamed("label", "comp"), "comp", "left")
    return materialise(joined.select("comp", F.coalesce("root", "comp").alias("root")))


def _beacon_bounds(rows: DataFrame, known: DataFrame, largest: int) -> DataFrame:
    """``(comp, limit)`` of components without a known edge: their least edge to some rows of other components."""
    some = [rows.orderBy(F.xxhash64("id"), "id").limit(BEACONS), rows.filter(F.col("comp") == largest).orderBy(F.xxhash64("id"), "id").limit(BEACONS // 8)]
    beacons = some[0].unionByName(some[1]).select("comp", "core", "item").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(beacons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held = metric_named("euclidean"), shared.value
        b, comp, core = m.load(held["item"]), held["comp"].to_numpy(), held["core"].to_numpy()
        for batch in batches:
            for lo in range(0, batch.num_rows, MAX_BLOCK):
                part = batch.slice(lo, MAX_BLOCK)
                a, mine = m.load(part.column("item")), part.column("comp").to_numpy()
                reach = np.maximum(np.maximum(m.matrix(a, b), core[None, :]), part.column("core").to_numpy()[:, None])
                reach[mine[:, None] == comp[None, :]] = np.inf
                # The distance is found by products: a little more is a bound for sure.
                yield pa.RecordBatch.from_arrays([part.column("comp"), pa.array(reach.min(axis=1) + 2.0 * m.slack(a, b))], names=["comp", "limit"])

    asking = rows.filter(F.col("comp") != largest).join(known.select("comp"), "comp", "left_anti")
    return asking.select("comp", "core", "item").mapInArrow(run, "comp long, limit double").groupBy("comp").agg(F.min("limit").alias("limit"))


def _next_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least number above each limit."""
    for batch in batches:
        above = np.nextafter(batch.column("limit").to_numpy(), np.inf)
        yield pa.RecordBatch.from_arrays([batch.column("comp"), pa.array(above)], names=["comp", "reached"])


def _searched(rows: DataFrame, tree: PivotTree | None, limits: DataFrame, largest: int, every: bool, block_rows: int | None) -> DataFrame:
    """Edges no heavier than ``limit`` that leave the components of ``limits``: the least of each, or to ``every`` other one."""
    asking = lookup_join(rows, limits, "comp", "id", bytes_per_row=32)
    asking = asking.filter((F.col("comp") != largest) & (F.greatest("listed", "core") <= F.col("limit")))
    kernel, schema = _outgoing(every), "comp long, other long, w double, a long, b long"
    plain = rows.select("cell", "id", "comp", "core", "item")
    asking = asking.select("id", "comp", "core", "item", "limit")
    if tree is not None:
        asking = materialise(asking)
        if prunes(tree, asking, rows.count(), block_rows or LEAF_ROWS):
            # A leaf of one component has no edge that leaves it, one of sparse rows no light one.
            leaves = plain.groupBy("cell").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.min("core").alias("_core"))
            visits = lookup_join(tree.visit(asking), materialise(leaves), "cell", "id", bytes_per_row=40)
            visits = visits.filter(((F.col("_low") != F.col("comp")) | (F.col("_high") != F.col("comp"))) & (F.col("_core") <= F.col("limit")))
            visits = materialise(visits.drop("_low", "_high", "_core"))
            return blocked(visits, plain, kernel, schema, False, block_rows, combine=_least_edges(every))
    cell = OneCell()
    return blocked(cell.left(asking), cell.right(plain.drop("cell")), kernel, schema, True, block_rows, True, combine=_least_edges(every))


def spanning_tree(
    points: DataFrame, near: DataFrame, block_rows: int | None = None, small_edges: int = SMALL_EDGES, few_comps: int = FEW_COMPONENTS
) -> DataFrame:
    """Minimum spanning tree ``(w, a, b)`` of mutual reachability, in Boruvka rounds.

    ``points`` is ``(id, core, item)``, ``near`` the listed neighbours with
    ``w``. A component knows the least edge to some others, and a ``floor``:
    no edge it does not know is lighter. While a known edge is below the floor
    components join by these edges alone, up to ``small_edges`` in one local pass.
    When none is, all components but the largest search for what is no
    heavier than the best edge they know, or than their edge to some sample
    rows; rows go down a pivot tree to the leaves within that limit.
    """
    # A row that lists fewer than others has no others.
    most = near.groupBy("id").agg(F.max("dist").alias("listed"), F.count("*").alias("_n"))
    most = materialise(most)
    k = most.agg(F.max("_n")).first()[0]
    listed = F.when(F.col("_n") == k, F.col("listed")).otherwise(F.lit(float("inf")))
    points = materialise(points.join(most, "id", "left").withColumn("listed", F.coalesce(listed, F.lit(float("inf")))).drop("_n"))
    total = points.count()
    tree = grow(points, metric_named("euclidean"), block_rows or LEAF_ROWS) if block_rows or total > SEARCH_ROWS else None
    placed = materialise(tree.home(points) if tree is not None else points.withColumn("cell", F.lit(0).cast("long")))
    comps = materialise(points.select(F.col("id").alias("comp"), F.greatest("listed", "core").alias("floor"), F.lit(1).cast("long").alias("n")))
    labels = points.select("id", F.col("id").alias("comp"))
    both = near.select(F.col("id").alias("comp"), "other", "w").unionByName(near.select(F.col("other").alias("comp"), F.col("id").alias("other"), "w"))
    ends = both.select("comp", "other", "w", F.least("comp", "other").alias("a"), F.greatest("comp", "other").alias("b"))
    edges, fresh = materialise(ends.distinct()), []
    spark = points.sparkSession
    while True:
        # Known edges first.
        while True:
            if edges.limit(2 * small_edges + 1).count() <= 2 * small_edges and comps.limit(small_edges + 1).count() <= small_edges:
                held, known = comps.orderBy("comp").toArrow(), edges.toArrow()
                root, taken = _settle(held, known)
                if taken:
                    fresh.append(spark.createDataFrame(known.select(["w", "a", "b"]).take(pa.array(np.concatenate(taken)))))
                    names = held["comp"].to_numpy()
                    roots = spark.createDataFrame(pa.table({"comp": names, "root": names[root]}))
                last = True
            else:
                best = edges.groupBy("comp").agg(F.min(F.struct(F.struct("w", "a", "b").alias("edge"), "other")).alias("best"))
                sure = materialise(best.join(comps, "comp").filter(F.col("best.edge.w") < F.col("floor")).select("comp", "best.other", "best.edge"))
                taken, last = not sure.isEmpty(), False
                if taken:
                    fresh.append(sure.select("edge.w", "edge.a", "edge.b").distinct())
                    roots = _all_roots(comps, sure, small_edges)
            if taken:
                labels = materialise(lookup_join(labels, roots, "comp", "id", bytes_per_row=32).select("id", F.col("root").alias("comp")))
                edges, comps = _contracted(edges, roots), _regrouped(comps, roots)
            if last or not taken:
                break
        size = comps.agg(F.count("*"), F.max_by("comp", F.struct("n", "comp"))).first()
        if size[0] < 2:
            return materialise(reduce(DataFrame.unionByName, fresh))
        every = size[0] <= few_comps
        rows = materialise(placed.join(labels, "id"))
        best = materialise(edges.groupBy("comp").agg(F.min("w").alias("limit")))
        limits = materialise(best.unionByName(_beacon_bounds(rows, best, size[1])).filter(F.col("comp") != size[1]))
        if every:
            # One limit for the nearer half, so that what is found joins more than pairs.
            usual = limits.agg(F.median("limit")).first()[0]
            limits = limits.withColumn("limit", F.greatest("limit", F.lit(usual)))
        found = materialise(
            _searched(rows, tree, limits, size[1], every, block_rows).groupBy("comp", "other").agg(F.min(F.struct("w", "a", "b")).alias("edge"))
            .select("comp", "other", "edge.w", "edge.a", "edge.b")
        )
        mirror = found.select(F.col("other").alias("comp"), F.col("comp").alias("other"), "w", "a", "b")
        edges = materialise(edges.unionByName(found).unionByName(mirror))
        # Every component that searched has its least edge now.
        best = edges.groupBy("comp").agg(F.min(F.struct(F.struct("w", "a", "b").alias("edge"), "other")).alias("best"))
        best = materialise(best.filter(F.col("comp") != size[1]).select("comp", "best.other", "best.edge"))
        fresh.append(best.select("edge.w", "edge.a", "edge.b").distinct())
        # An unknown edge is above the limit, or no lighter than the least one.
        reached = limits.mapInArrow(_next_up, "comp long, reached double") if every else best.select("comp", F.col("edge.w").alias("reached"))
        comps = materialise(comps.join(reached, "comp", "left").select("comp", F.greatest("floor", "reached").alias("floor"), "n"))
        roots = _all_roots(comps, best, small_edges)
        labels = materialise(lookup_join(labels, roots, "comp", "id", bytes_per_row=32).select("id", F.col("root").alias("comp")))
        edges, comps = _contracted(edges, roots), _regrouped(comps, roots)


def growth_levels(nodes: DataFrame, tree: DataFrame, size: int, heavy: DataFrame) -> DataFrame:
    """``(id, level)``: the edge at which a row's component first has ``size`` rows.

    Each row grows along its least outgoing tree edges; only the ``size``
    lightest edges of any row can take part, so hubs stay short. A row of
    ``heavy`` stands for ``size`` rows or more: who reaches it is done.
    """
    ends = tree.select(F.col("a").alias("id"), F.struct("w", "a", "b", F.col("b").alias("to")).alias("edge")).unionByName(
        tree.select(F.col("b").alias("id"), F.struct("w", "a", "b", F.col("a").alias("to")).alias("edge"))
    )
    ranked = ends.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("edge")))
    links = ranked.filter(F.col("rank") <= size).groupBy("id").agg(F.array_sort(F.collect_list("edge")).alias("links"))
    links = materialise(links.join(heavy.select("id", F.lit(True).alias("full")), "id", "left"))
    grown = nodes.select("id").join(heavy, "id", "left_anti").join(links, "id", "left").select(
        "id", F.array("id").alias("members"), F.col("links").alias("border"), F.lit(None).cast(EDGE).alias("level")
    )
    for number in range(1, size):
        step = grown.withColumn("next", F.array_min("border"))
        joined = lookup_join(
            step.withColumn("to", F.col("next.to")),
            links.select(F.col("id").alias("to"), F.col("links").alias("more"), "full"),
            "to", "id", bytes_per_row=48 * size, how="left",
        )
        taken = F.struct("next.w", "next.a", "next.b")
        members = F.concat("members", F.array("to"))
        open_links = F.filter(
            F.concat("border", F.coalesce("more", F.array().cast("array<struct<w: double, a: bigint, b: bigint, to: bigint>>"))),
            lambda e: ~F.array_contains(F.col("members"), e["to"]),
        )
        grown = joined.withColumn("members", members).select(
            "id", "members", F.when(F.col("full").isNull(), F.slice(F.array_sort(open_links), 1, size)).otherwise(F.expr("slice(border, 1, 0)")).alias("border"),
            F.greatest(F.coalesce("level", taken), taken).alias("level"),
        )
        if number % 4 == 0:
            grown = materialise(grown)
    return grown.select("id", "level")


def collapsed(items: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows, with the first of each group of ``least`` or more equal ones for all, and the other ones of those groups.

    ``(id, item, weight)`` and ``(id, first, rank)``; ranks go by id up to ``least``, then stay null.
    """
    groups = items.groupBy("item").agg(F.min("id").alias("first"), F.count("*").alias("weight")).filter(F.col("weight") >= least)
    groups = materialise(groups)
    if groups.isEmpty():
        return items.withColumn("weight", F.lit(1).cast("long")), items.select("id", F.col("id").alias("first"), F.lit(1).alias("rank")).limit(0)
    width = groups.agg(F.max(F.size("item"))).first()[0] * 8 + 48
    marked = materialise(lookup_join(items, groups, "item", "id", bytes_per_row=width, how="left"))
    rows = marked.filter("first IS NULL OR first = id").select("id", "item", F.coalesce("weight", F.lit(1).cast("long")).alias("weight"))
    others = marked.filter("first <> id").select("id", "first")
    # Spark cuts every group before the shuffle.
    ranks = others.withColumn("rank", F.row_number().over(Window.partitionBy("first").orderBy("id"))).filter(F.col("rank") < least)
    return materialise(rows), materialise(others.join(ranks.select("id", "rank"), "id", "left"))


class SplitTree:
    """The merges of large components: one leaf per segment, one node per split."""

    def __init__(self, splits: pa.Table):
        order = np.lexsort((splits["b"].to_numpy(), splits["a"].to_numpy(), splits["w"].to_numpy()))
        self.w = splits["w"].to_numpy()[order]
        self.keys = np.array(
            list(zip(self.w, splits["a"].to_numpy()[order], splits["b"].to_numpy()[order])),
            dtype=[("w", "f8"), ("a", "i8"), ("b", "i8")],
        )
        one, two = splits["comp_a"].to_numpy()[order], splits["comp_b"].to_numpy()[order]
        self.leaves = np.unique(np.concatenate([one, two]))
        n = len(self.leaves)
        total = n + len(order)
        self.parent = np.full(total, -1)
        self.death = np.full(total, len(order))
        self.children = {}
        top, root = list(range(n)), {}

        def find(k):
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        for step, (x, y) in enumerate(zip(np.searchsorted(self.leaves, one), np.searchsorted(self.leaves, two))):
            x, y = find(int(x)), find(int(y))
            p, q = root.get(x, x), root.get(y, y)
            node = n + step
            self.parent[[p, q]] = node
            self.death[[p, q]] = step
            self.children[node] = (p, q)
            top[y] = x
            root[x] = node

    def home(self, leaf: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The node a row leaves directly: the first one still alive at its level."""
        node = leaf.copy()
        while True:
            moving = self.death[node] < rank
            if not moving.any():
                return node
            node[moving] = self.parent[node[moving]]

    def choose(self, count: dict[int, int], mass: dict[int, float]) -> np.ndarray:
        """Selected node above (or at) every node by excess of mass, -1 for none."""
        total, n = len(self.parent), len(self.leaves)
        rate = 1.0 / np.maximum(self.w, TINY)
        size, stability = np.zeros(total), np.zeros(total)
        keep = np.zeros(total, dtype=bool)
        for node in range(total):
            size[node] = count.get(node, 0)
            own = mass.get(node, 0.0)
            below = 0.0
            if node >= n:
                p, q = self.children[node]
                size[node] += size[p] + size[q]
                own += (size[p] + size[q]) * rate[node - n]
                below = stability[p] + stability[q]
            if node == total - 1:
                break
            own -= size[node] * rate[self.death[node]]
            keep[node] = node < n or below <= own
            stability[node] = own if keep[node] else below
        chosen = np.full(total, -1)
        for node in range(total - 2, -1, -1):
            above = chosen[self.parent[node]]
            chosen[node] = above if above >= 0 else (node if keep[node] else -1)
        return chosen


def density_cluster(
    df: DataFrame,
    min_cluster_size: int = 5,
    min_samples: int = 5,
    id_col: str = "id",
    item_col: str = "item",
    block_rows: int | None = None,
    small_edges: int = SMALL_EDGES,
    small_splits: int = SMALL_SPLITS,
) -> DataFrame:
    """``(id, cluster_id)`` by hierarchical density clustering; -1 is noise.

    Exact for the order of edges by ``(weight, ids)``: mutual-reachability
    spanning tree, then every row's level of joining a component of
    ``min_cluster_size`` rows, then the tree edges that join two such
    components. Those splits are at most one per ``min_cluster_size`` rows. Up
    to ``small_splits`` of them are put in order by one local pass; beyond, the
    merge tree is built, summed and searched as a table (``mergetree``).
    The core distance is the distance to the ``min_samples``-th other row. So
    many equal rows that these are a component at distance 0 take part as their
    first one, which all others join by an edge of weight 0. The whole table is never one cluster. Clusters are numbered by lowest row id.
    """
    items = materialise(as_items(df, id_col, item_col, "euclidean"))
    noise = items.select("id", F.lit(-1).cast("long").alias("cluster_id"))
    n = items.limit(max(min_cluster_size, min_samples + 1)).count()
    if n < max(min_cluster_size, min_samples + 1, 2):
        return noise
    least = max(min_samples + 1, min_cluster_size)
    items, copies = collapsed(items, least)
    heavy = materialise(items.filter(F.col("weight") >= least).select("id", "weight"))
    near = materialise(k_nearest(items, min_samples + EXTRA_NEIGHBOURS, "euclidean", block_rows=block_rows))
    if near.isEmpty():
        return noise  # all rows are equal
    # The listed neighbours up to the min_samples-th row; a row for many ends the count.
    counted = lookup_join(near.select("id", "other", "dist", "rank"), heavy.withColumnRenamed("id", "other"), "other", "id", bytes_per_row=16, how="left")
    ends = F.when(F.col("weight").isNotNull() | (F.col("rank") == min_samples), F.col("dist"))
    core = counted.groupBy("id").agg(F.min(ends).alias("core"))
    core = core.join(heavy.select("id", "weight"), "id", "left").select("id", F.when(F.col("weight").isNull(), F.col("core")).otherwise(F.lit(0.0)).alias("core"))
    points = materialise(items.select("id", "item").join(core, "id"))
    cores = materialise(points.select("id", "core"))
    other_cores = cores.select(F.col("id").alias("other"), F.col("core").alias("other_core"))
    reach = materialise(
        lookup_join(near.join(cores, "id"), other_cores, "other", "id", bytes_per_row=32)
        .select("id", "other", "dist", F.greatest("dist", "core", "other_core").alias("w"))
    )
    tree = spanning_tree(points, reach, block_rows, small_edges)
    levels = materialise(growth_levels(cores, tree, min_cluster_size, heavy))
    if not heavy.isEmpty():
        # A group grows along its edges of weight 0, least ids first, and is never split there.
        full = copies.filter(F.col("rank") == min_cluster_size - 1).select("first", F.col("id").alias("filled"))
        zero = lambda end: F.struct(F.lit(0.0).alias("w"), F.col("first").alias("a"), end.alias("b"))
        if min_cluster_size > 1:
            levels = levels.unionByName(full.select(F.col("first").alias("id"), zero(F.col("filled")).alias("level")))
            own = lookup_join(copies.select("id", "first"), full, "first", "id", bytes_per_row=32)
            copy_levels = own.select("id", zero(F.greatest("id", "filled")).alias("level"))
    marked = tree
    for end, far_end in (("a", "b"), ("b", "a")):
        ends = levels.select(F.col("id").alias(end), F.col("level").alias(f"level_{end}"))
        marked = lookup_join(marked, ends, end, far_end, bytes_per_row=64)
    key = F.struct("w", "a", "b")
    is_split = (key > F.col("level_a")) & (key > F.col("level_b"))
    marked = materialise(marked.select("w", "a", "b", is_split.alias("is_split")))
    splits = marked.filter("is_split")
    if splits.isEmpty():
        return noise
    segments = materialise(connected_components(cores, marked.filter("NOT is_split").select("a", "b"), small_edges))
    for end in ("a", "b"):
        splits = splits.join(segments.select(F.col("id").alias(end), F.col("comp").alias(f"comp_{end}")), end)
    splits = materialise(splits)
    if not heavy.isEmpty():
        of_first = segments.select(F.col("id").alias("first"), "comp")
        segments = materialise(segments.unionByName(lookup_join(copies.select("id", "first"), of_first, "first", "id", bytes_per_row=32).select("id", "comp")))
        levels = materialise(levels.unionByName(copy_levels))
    if splits.limit(small_splits + 1).count() > small_splits:
        return clusters_by_tables(segments, levels, splits, small_edges=small_edges)
    split_tree = SplitTree(splits.select("w", "a", "b", "comp_a", "comp_b").toArrow())
    shared = df.sparkSession.sparkContext.broadcast(split_tree)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            wanted = np.empty(batch.num_rows, dtype=found.keys.dtype)
            for name in ("w", "a", "b"):
                wanted[name] = batch.column(name).to_numpy()
            rank = np.searchsorted(found.keys, wanted)
            leaf = np.searchsorted(found.leaves, batch.column("comp").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found.home(leaf, rank).astype(np.int32)), batch.column("w")], names=["id", "node", "w"]
            )

    placed_schema = StructType(
        [StructField("id", LongType()), StructField("node", IntegerType()), StructField("w", DoubleType())]
    )
    located = materialise(
        segments.join(levels, "id").select("id", "comp", "level.w", "level.a", "level.b").mapInArrow(locate, placed_schema)
    )
    # At most two nodes a split, whose number was checked.
    sums = located.groupBy("node").agg(F.count("*").alias("n"), F.sum(rate_of(F.col("w"))).alias("mass"), F.min("id").alias("low")).collect()
    chosen = split_tree.choose({r["node"]: r["n"] for r in sums}, {r["node"]: r["mass"] for r in sums})
    lowest: dict[int, int] = {}
    for r in sums:
        top = int(chosen[r["node"]])
        if top >= 0:
            lowest[top] = min(lowest.get(top, r["low"]), r["low"])
    number = {top: k for k, top in enumerate(sorted(lowest, key=lowest.get))}
    labels = df.sparkSession.createDataFrame(
        [(r["node"], number.get(int(chosen[r["node"]]), -1)) for r in sums], "node int, cluster_id long"
    )
    return lookup_join(located, labels, "node", "id", bytes_per_row=16).select("id", "cluster_id")
