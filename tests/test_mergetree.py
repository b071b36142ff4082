"""The merge tree as tables, against the plain definition and the local pass."""

import random

import numpy as np
import pytest
from coverset.operators.density import density_cluster
from coverset.operators.mergetree import contract, highest, merge_tree
from tests import brute


def plain_tree(edges):
    """Parent of every node, by joining the edges in order of rank."""
    root, top, parent = {}, {}, {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for rank, u, v in edges:
        x, y = find(u), find(v)
        parent[top.get(x, -1 - u)], parent[top.get(y, -1 - v)] = rank, rank
        root[y], top[x] = x, rank
    return parent


def random_edges(n, shape, seed):
    rng = random.Random(seed)
    joins = [(k, k - 1 if shape == "path" else 0 if shape == "star" else rng.randrange(k)) for k in range(1, n + 1)]
    order = list(range(n)) if shape == "path" else rng.sample(range(n), n)
    return [(rank, *joins[k]) for rank, k in enumerate(order)]


@pytest.mark.parametrize("shape", ["path", "tree"])
def test_tree_by_halves(spark, shape):
    edges = random_edges(22, shape, 3)
    table = spark.createDataFrame(edges, "rank long, u long, v long")
    expected = plain_tree(edges)
    for size in (4, 64):
        assert {r.node: r.parent for r in merge_tree(table, 22, size).collect()} == expected
    # Sums, choices and ancestors on the same tree; a path is as deep as it is long.
    rng = random.Random(1)
    parent = {**expected, 21: None}
    rows = [(k, p, rng.randrange(9), float(rng.randrange(-9, 30)), rng.random() < 0.3) for k, p in parent.items()]
    nodes = spark.createDataFrame(rows, "node long, parent long, n long, own double, keep boolean")
    kids = {}
    for k, p in parent.items():
        kids.setdefault(p, []).append(k)

    def total(k):
        return own[k][0] + sum(total(c) for c in kids.get(k, []))

    def best(k):
        below = sum(best(c) for c in kids.get(k, []))
        return max(own[k][1], below + own[k][0]) if k in kids else own[k][0]

    def chosen(k):
        above = chosen(parent[k]) if parent[k] is not None else None
        return above if above is not None else (k if own[k][2] else None)

    own = {k: (n, x, keep) for k, _, n, x, keep in rows}
    assert {r.node: r.value for r in contract(nodes, "n").collect()} == {k: total(k) for k in parent}
    assert {r.node: r.value for r in contract(nodes, "n", "own").collect()} == {k: best(k) for k in parent}
    assert {r.node: r.chosen for r in highest(nodes).collect()} == {k: chosen(k) for k in parent}


def test_density_by_tables(spark):
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.normal(c, s, (22, 2)) for c, s in ((0, 0.4), (5, 0.3), (5.9, 0.2), (12, 1.5))]).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "id long, item array<double>")
    expected = brute.density(brute.euclid(rows), 4, 3)
    local = {r.id: r.cluster_id for r in density_cluster(df, 4, 3).collect()}
    tables = {r.id: r.cluster_id for r in density_cluster(df, 4, 3, small_splits=0).collect()}
    assert tables == local and len(set(local.values())) > 2
    assert brute.same_partition([local[k] for k in range(len(rows))], expected.tolist())
