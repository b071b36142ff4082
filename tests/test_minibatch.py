"""Mini-batch k-means and its parallel start."""

import numpy as np
import pytest

from coverset.operators.kmeans import kmeans
from coverset.operators.minibatch import minibatch_centers, minibatch_kmeans, seed_centers
from coverset.session import materialise

CENTRES = [(0.0, 0.0), (30.0, 0.0), (0.0, 30.0), (30.0, 30.0)]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (np.array(CENTRES[k % 4]) + rng.normal(size=2)).tolist()) for k in range(160)]
    rows += [(1000 + k, [60.0, 60.0]) for k in range(40)]  # one value many times
    return materialise(spark.createDataFrame(rows, "id long, item array<double>"))


@pytest.mark.parametrize("local", [0, 1000])
def test_start_is_spread_and_repeatable(blobs, local):
    made = seed_centers(blobs, 5, local=local, oversample=4.0)
    rows = sorted((r.cluster_id, tuple(r.center)) for r in made.collect())
    assert [c for c, _ in rows] == list(range(5)) and len({v for _, v in rows}) == 5
    again = seed_centers(blobs.repartition(3), 5, local=local, oversample=4.0)
    assert sorted((r.cluster_id, tuple(r.center)) for r in again.collect()) == rows
    if local:
        assert len({(round(x / 30), round(y / 30)) for _, (x, y) in rows}) == 5


def test_fewer_distinct_rows_than_centres(spark):
    rows = materialise(spark.createDataFrame([(k, [float(k % 3)]) for k in range(12)], "id long, item array<double>"))
    assert sorted(r.center[0] for r in seed_centers(rows, 7).collect()) == [0.0, 1.0, 2.0]


def test_updates_are_running_means(spark):
    """One batch a step: after each, a centre is the mean of all rows it has had."""
    rows = materialise(spark.createDataFrame([(k, [x]) for k, x in enumerate([0.0, 1.0, 2.0, 10.0, 12.0])], "id long, item array<double>"))
    start = spark.createDataFrame([(0, [1.5]), (1, [9.0]), (2, [500.0])], "cluster_id long, center array<double>")
    got = {r.cluster_id: r.center[0] for r in minibatch_centers(rows, start, batch_rows=100, max_batches=2).collect()}
    assert got == pytest.approx({0: 1.0, 1: 11.0, 2: 500.0})


def test_blobs_are_found(blobs):
    labels, centers, cost = minibatch_kmeans(blobs, 5, batch_rows=50, max_batches=8)
    of = {r.id: r.cluster_id for r in labels.collect()}
    assert len(of) == 200 and len(set(of.values())) == 5
    assert all(len({of[k] for k in range(b, 160, 4)}) == 1 for b in range(4)) and cost < 2.5 * 160
    big = kmeans(blobs, 5, mini_rows=100, max_iter=4)  # the switch by size
    assert big.model is None and big.assignment.count() == 200
    with pytest.raises(ValueError):
        minibatch_kmeans(blobs.limit(0), 3)
