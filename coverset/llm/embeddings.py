"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from coverset.llm.common import slices, spread
from coverset.llm.components import components
from coverset.session import lookup_join, materialise

# Rows compared with rows at a time: a block of similarities is at most this many squared.
TILE = 1_024
# Members of one bucket kept together; a larger bucket is cut into blocks, which meet pair by pair.
BLOCK_ROWS = 4_096


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, tables * bits))


def _signs(tables: int, bits: int, seed: int):
    """Unit-free codes: one integer for each table, from the signs of ``bits`` projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        power = 1 << np.arange(bits, dtype=np.int64)
        for part in slices(batches, 2048):
            lengths = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
            codes = np.zeros((len(lengths), tables), np.int32)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                x = flat[(starts[rows][:, None] + np.arange(dim)).reshape(-1)].reshape(len(rows), dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                if dim not in normals:
                    normals[dim] = planes(dim, tables, bits, seed)
                codes[rows] = ((x @ normals[dim]) >= 0).reshape(len(rows), tables, bits) @ power
            flat_codes, ends = codes.reshape(-1), np.arange(0, codes.size + 1, tables, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat_codes))],
                names=["node", "vector", "copies", "codes"],
            )

    return run


def _meet(threshold: float):
    """Links inside each bucket block: counts of partners for each row, and edges that span the components."""

    def unit(vectors: pa.Array, count: int) -> np.ndarray:
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(count, -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def solve(key: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        n = whole.num_rows
        if n < 2:
            return None
        node, side = (whole.column(i).to_numpy(zero_copy_only=False) for i in (3, 2))
        copies = whole.column(5).to_numpy(zero_copy_only=False)
        codes = whole.column(6).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        x = unit(whole.column(4), n)
        at = int(key[0])
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        crossing = len(two) > 0
        if not crossing:
            two = one
        degree, root = np.zeros(n, np.int64), np.arange(n)
        left, right = [], []
        for i in range(0, len(one), TILE):
            a = one[i : i + TILE]
            for j in range(0 if crossing else i, len(two), TILE):
                b = two[j : j + TILE]
                p, q = np.nonzero(x[a] @ x[b].T >= threshold)
                p, q = a[p], b[q]
                if not crossing and i == j:
                    p, q = p[p < q], q[p < q]
                # A pair that meets in several tables counts in the first.
                for s in range(0, len(p), 100_000):
                    u, w = p[s : s + 100_000], q[s : s + 100_000]
                    first = ~(codes[u, :at] == codes[w, :at]).any(axis=1) if at else np.ones(len(u), bool)
                    u, w = u[first], w[first]
                    degree += np.bincount(u, weights=copies[w], minlength=n).astype(np.int64)
                    degree += np.bincount(w, weights=copies[u], minlength=n).astype(np.int64)
                    apart = root[u] != root[w]
                    if apart.any():
                        left.append(u[apart])
                        right.append(w[apart])
                        low = np.minimum(root[u[apart]], root[w[apart]])
                        np.minimum.at(root, u[apart], low)
                        np.minimum.at(root, w[apart], low)
        if not left:
            return None
        u, w = np.concatenate(left), np.concatenate(right)
        root = np.arange(n)
        while True:
            low, before = np.minimum(root[u], root[w]), root.copy()
            np.minimum.at(root, u, low)
            np.minimum.at(root, w, low)
            root = root[root]
            if np.array_equal(root, before):
                break
        rows = np.flatnonzero((degree > 0) | (root != np.arange(n)))
        return pa.RecordBatch.from_arrays(
            [pa.array(node[rows]), pa.array(degree[rows]), pa.array(node[root[rows]])], names=["node", "links", "root"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            # table, group, side, node, vector, copies, codes
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if now != tuple(keys[:, lo]):
                    if parts and (made := solve(now, parts)) is not None:
                        yield made
                    now, parts = tuple(keys[:, lo]), []
                parts.append(batch.slice(lo, hi - lo))
        if parts and (made := solve(now, parts)) is not None:
            yield made

    return run


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    tables: int = 24,
    bits: int = 12,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Vectors meet in a table when the signs of ``bits`` random projections agree;
    a pair that meets is linked if its cosine, in double precision, is at least
    ``threshold``. A pair at cosine c meets somewhere with probability
    ``1 - (1 - (1 - acos(c)/pi) ** bits) ** tables``: 0.983 at 0.9, 0.9996 at 0.95
    with the defaults.

    Equal vectors are one node with a count of copies and are linked exactly. A
    null, empty or zero vector, or one with a null, NaN or infinite component,
    links with nothing: no links, itself as component, kept. Vectors of different
    length never link. A repeated id is one row each time; its rows take the
    component of the smallest. Other columns are not read.
    """
    kind = "float" if "float" in vectors.schema[vector_col].dataType.simpleString() else "double"
    rows = spread(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector")))
    size = F.lit(float("inf")).cast(DoubleType())
    fit = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < size)) & F.exists("vector", lambda v: v != 0)
    rows = materialise(rows.select("vec_id", F.when(fit, F.transform("vector", lambda v: F.when(v == 0, F.lit(0).cast(kind)).otherwise(v))).alias("vector")))
    groups = rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialise(groups.select(F.xxhash64("vector", F.lit(seed)).alias("node"), "vector", "copies", "least"))
    hashed = nodes.select("node", "vector", "copies").mapInArrow(_signs(tables, bits, seed), f"node long, vector array<{kind}>, copies long, codes array<int>")
    each = hashed.select(F.posexplode("codes").alias("tab", "code"), "node", "vector", "copies", "codes")
    # Vectors of different length never meet.
    bucket = F.xxhash64("tab", "code", F.size("vector"))
    crowded = materialise(
        hashed.select(F.posexplode("codes").alias("tab", "code"), "vector").groupBy(bucket.alias("bucket")).count().filter(F.col("count") > block_rows)
        .select("bucket", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    )
    each = each.withColumn("bucket", bucket)
    if crowded.isEmpty():
        placed = each.select("tab", F.xxhash64("bucket").alias("grp"), F.lit(0).alias("side"), "node", "vector", "copies", "codes")
    else:
        both = lookup_join(each, crowded, "bucket", "node", 64, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        both = both.withColumn("own", F.pmod("node", "blocks").cast("int"))
        both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        placed = both.select(
            "tab", F.xxhash64("bucket", low, high).alias("grp"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "vector", "copies", "codes"
        )
    placed = placed.repartition("tab", "grp").sortWithinPartitions("tab", "grp")
    met = materialise(placed.mapInArrow(_meet(threshold), "node long, links long, root long"))
    counted = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = nodes.join(counted, "node", "left").join(roots, "node", "left")
    whole = whole.select("vector", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    named = whole.groupBy("root").agg(F.min("least").alias("comp"))
    whole = whole.join(named, "root").select("vector", (F.col("links") + F.col("copies") - 1).alias("links"), "comp")
    out = rows.join(whole, "vector", "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"))
