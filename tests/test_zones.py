"""MaxMin over zones, and on-bit sets of very large positions."""

import numpy as np
import pytest

from coverset.operators.maxmin import maxmin
from coverset.operators.neighbours import neighbours
from tests import brute


@pytest.mark.parametrize("metric", ["euclidean", "tanimoto", "cosine"])
def test_zones_pick_the_same_and_rewrite_less(spark, metric):
    rng = np.random.default_rng(8)
    if metric == "tanimoto":
        rows = [sorted({int(b) for b in rng.normal(40 * rng.integers(0, 4), 5, 8).astype(int) + 20}) for _ in range(120)]
    else:
        centres = rng.normal(size=(6, 3)) * 20
        rows = (centres[rng.integers(0, 6, 120)] + rng.normal(size=(120, 3))).tolist()
    rows[7] = rows[3]
    df = spark.createDataFrame(list(enumerate(rows)), f"id long, item array<{'int' if metric == 'tanimoto' else 'double'}>")
    one, many = [], []
    plain = maxmin(df, 60, metric, pool_rows=6, report=one).orderBy("pick_order").collect()
    zoned = maxmin(df, 60, metric, pool_rows=6, zone_rows=10, report=many).orderBy("pick_order").collect()
    assert zoned == plain and len(plain) == 60
    # Distances of sets that share nothing are all 1, and no bound can tell them apart.
    assert len(one) == len(many) and sum(many) <= sum(one) and (metric != "euclidean" or sum(many) < sum(one) and many[-1] < one[-1])


def test_pairs_of_sets_in_a_very_large_universe(spark):
    rng = np.random.default_rng(3)
    base = [rng.choice(2**31 - 1, 12, replace=False) for _ in range(5)]
    rows = [sorted({int(b) for b in base[k % 5]} ^ {int(b) for b in rng.choice(base[k % 5], k % 3)}) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, item array<int>")
    first = {}
    for k, r in enumerate(rows):
        first.setdefault(tuple(r), k)
    far, ids = brute.tanimoto(rows), sorted(first.values())
    found = neighbours(df, "tanimoto", 0.4, block_rows=4).collect()
    assert sorted((r.id_a, r.id_b) for r in found) == [(a, b) for a in ids for b in ids if a < b and far[a, b] <= 0.4]


@pytest.mark.parametrize("metric", ["tanimoto", "euclidean"])
def test_rows_near_a_pick_wait(spark, metric):
    """Rows far below the farthest ones are not compared with the later picks, and meet them in parts when their turn comes."""
    rng = np.random.default_rng(9)
    if metric == "tanimoto":
        rows = [sorted({10 * int(c) + int(b) for b in rng.choice(10, 8, replace=False)}) for c in rng.integers(0, 25, 300)]
    else:
        rows = (rng.normal(size=(25, 4))[rng.integers(0, 25, 300)] * 50 + rng.normal(size=(300, 4))).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), f"id long, item array<{'int' if metric == 'tanimoto' else 'double'}>")
    wrote = []
    found = maxmin(df, 40, metric, pool_rows=8, zone_rows=16, report=wrote).orderBy("pick_order").collect()
    far = np.array(brute.tanimoto(rows)) if metric == "tanimoto" else np.sqrt(((np.array(rows)[:, None] - np.array(rows)[None]) ** 2).sum(2))
    near, picks = far[0].copy(), [0]
    while len(picks) < 40:
        near[picks] = -1.0
        picks.append(int(near.argmax()))
        near = np.minimum(near, far[picks[-1]])
    assert [r.id for r in found] == picks
    # Rounds that wrote every row would have written all but the picks each time.
    assert sum(wrote[1:]) < 0.7 * 260 * (len(wrote) - 1)
