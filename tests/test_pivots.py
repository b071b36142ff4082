"""The pivot tree: every level descended in the task and by joins, against brute force."""

import numpy as np
import pytest

from coverset.functions.metrics import metric_named
from coverset.operators import cells, knn, nearest as nr, pivots
from coverset.operators.cells import OneCell
from coverset.operators.knn import k_nearest
from coverset.operators.neighbours import neighbours
from coverset.operators.pivots import grow
from coverset.session import materialise
from tests import brute

N = 140


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 3)) * 4
    x = centres[rng.integers(0, 5, N)] + rng.normal(size=(N, 3))
    x[3:60:7] = x[3]  # equal rows cannot be split
    return x.tolist()


@pytest.fixture(scope="module")
def table(spark, rows):
    return materialise(spark.createDataFrame(list(enumerate(rows)), "id long, item array<double>"))


@pytest.fixture(params=["held", "joined"])
def small_fan(request, monkeypatch):
    """Four children a cell, so that there are several levels; their pivots sent to the tasks or joined."""
    held = 1 << 26 if request.param == "held" else 0
    monkeypatch.setattr(pivots, "FAN", 4)
    small = lambda items, metric, block, **_: grow(items, metric, block, held)
    for module in (pivots, knn, nr):
        monkeypatch.setattr(module, "grow", small)
    return small


def test_tree_splits_to_blocks(table, small_fan):
    tree = small_fan(table, metric_named("euclidean"), 12)
    assert len(tree.levels) > 2
    sizes = tree.home(table).groupBy("cell").count().collect()
    assert sum(r["count"] for r in sizes) == N and sorted(r["count"] for r in sizes)[-2] <= 12  # the equal rows stay together
    assert grow(table.limit(20), metric_named("euclidean"), 12) is None


def test_joins_are_exact(table, rows, small_fan):
    far = brute.euclid(rows)
    first = {}
    for k, r in enumerate(rows):
        first.setdefault(tuple(r), k)
    ids = sorted(first.values())
    found = neighbours(table, "euclidean", 0.9, block_rows=12).collect()
    assert sorted((r.id_a, r.id_b) for r in found) == [(a, b) for a in ids for b in ids if a < b and far[a, b] <= 0.9]
    found = {}
    for r in k_nearest(table, 4, block_rows=12).collect():
        found.setdefault(r.id, []).append((round(r.dist, 9), r.other))
    for a in range(N):
        assert sorted(found[a]) == sorted((round(far[a, b], 9), b) for b in range(N) if b != a)[:4]
    got = nr.nearest(table, table.filter("id % 2 = 0"), "euclidean", broadcast_limit=0, block_rows=12).collect()
    assert len(got) == N
    for r in got:
        assert (round(r.dist, 9), r.ref_id) == min((round(far[r.id, b], 9), b) for b in range(0, N, 2))


def test_tanimoto_references_by_tree(spark, small_fan):
    rng = np.random.default_rng(1)
    sets = [sorted(rng.choice(40, rng.integers(0, 9), replace=False).tolist()) for _ in range(90)]
    table = materialise(spark.createDataFrame(list(enumerate(sets)), "id long, item array<int>"))
    far = brute.tanimoto(sets)
    for r in nr.nearest(table, table.filter("id >= 20"), "tanimoto", broadcast_limit=0, block_rows=12).collect():
        assert (round(r.dist, 9), r.ref_id) == min((round(far[r.id, b], 9), b) for b in range(20, 90))


def test_one_order_of_block_pairs(table, rows):
    """Without cells each unordered block pair is compared once, and no pair is lost."""
    from coverset.operators.neighbours import close_pairs, copy_groups

    groups = materialise(copy_groups(table, "euclidean"))
    found = close_pairs(groups, OneCell(), "euclidean", 2.0, 20).collect()
    far, ids = brute.euclid(rows), sorted(r.id for r in groups.collect())
    assert sorted((r.id_a, r.id_b) for r in found) == [(a, b) for a in ids for b in ids if a < b and far[a, b] <= 2.0]
    copies = {r.id: r.copies for r in groups.collect()}
    assert all((r.copies_a, r.copies_b) == (copies[r.id_a], copies[r.id_b]) for r in found)


def test_vectors_that_no_pivot_tells_apart_are_left_to_blocks(spark, table):
    """Nearly equal distances: a search would copy every row to all leaves."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    loose = materialise(spark.createDataFrame(list(enumerate(x.tolist())), "id long, item array<double>"))
    assert isinstance(cells.cells_for(loose, "euclidean", 1.15, 10), OneCell)  # cells of the tree before
    assert isinstance(cells.cells_for(table, "euclidean", 0.05, 4), pivots.TreeCells)
    found = k_nearest(loose, 3, block_rows=10).collect()
    far = brute.euclid(x.tolist())
    for a in range(0, 300, 17):
        assert [r.other for r in sorted((r for r in found if r.id == a), key=lambda r: r.rank)] == [b for _, b in sorted((far[a, b], b) for b in range(300) if b != a)[:3]]


def test_a_search_goes_down_a_few_rows_at_a_time(table, small_fan, monkeypatch):
    monkeypatch.setattr(pivots, "STEP", 3)
    tree = small_fan(table, metric_named("euclidean"), 12)
    monkeypatch.setattr(pivots, "STEP", 512)
    whole = small_fan(table, metric_named("euclidean"), 12)
    assert tree.visit(table, 0.9).count() == whole.visit(table, 0.9).count()
