"""Nearest sets by bitmaps in order of size."""

import numpy as np
import pyarrow as pa
import pytest

from coverset.functions.metrics import SizedSets, metric_named
from coverset.operators import nearest as near


def _sets(rng, n, width, most):
    rows = [np.sort(rng.choice(width, rng.integers(0, most), replace=False)).astype(np.int32) for _ in range(n)]
    return pa.array(rows, pa.list_(pa.int32()))


# Many ties and empty sets; rows wider than the references; sets too large for single precision.
@pytest.mark.parametrize("width, wider, most, n", [(12, 0, 6, 1500), (60, 9, 40, 1500), (4000, 0, 2500, 60)])
def test_sized_sets_find_the_nearest_and_the_lowest_id(width, wider, most, n):
    rng, m = np.random.default_rng(4), metric_named("tanimoto")
    a, b, ids = m.load(_sets(rng, n, width + wider, most)), m.load(_sets(rng, n + 1100, width, most)), rng.permutation(n + 1100)
    far = m.matrix(a, b)
    dist, who = SizedSets([b], ids).nearest(a)
    assert (dist == far.min(1)).all()
    assert (who == np.where(far == far.min(1)[:, None], ids, 1 << 60).min(1)).all()


def test_references_are_measured_as_bitmaps(spark):
    """40 sets of 300 bits: 2,424 bytes each as numbers, some 190 as bitmaps."""
    rng = np.random.default_rng(5)
    rows = [(k, sorted(int(b) for b in rng.choice(1000, 300, replace=False))) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, item array<int>")
    assert near.small_refs(df, 20_000) is None
    held = near.small_sets(df, 20_000)
    assert held is not None and held.bits.nbytes <= 40 * 128 and near.small_sets(df, 0) is None
    found = near.nearest(df, df, "tanimoto", broadcast_limit=20_000)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.ref_id, r.dist) for r in found.collect()) == [(k, k, 0.0) for k in range(40)]
