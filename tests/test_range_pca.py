"""The range finder against plain numpy, and the map-side reference space."""

import numpy as np
import pytest

from coverset.operators.nearest import reference_space
from coverset.operators.range_pca import range_pca
from coverset.operators.reduction import Reducer


def plain(x, k):
    centred = x - x.mean(0)
    values = np.linalg.svd(centred, compute_uv=False) ** 2
    return (values / values.sum())[:k]


def test_sparse_rows_as_numpy(spark):
    rng = np.random.default_rng(3)
    chance = np.linspace(0.9, 0.02, 300) ** 2
    groups = rng.integers(0, 4, 160)
    sets = [np.flatnonzero(rng.random(300) < np.roll(chance, 75 * g)).tolist() for g in groups]
    sets[5] = []
    dense = np.zeros((160, 300))
    for k, s in enumerate(sets):
        dense[k, s] = 1.0
    df = spark.createDataFrame([*enumerate(sets), (999, None)], "id long, item array<int>").repartition(3)
    fitted = range_pca(df, 3, 300, sparse=True, rounds=12)
    assert fitted.ratios == pytest.approx(plain(dense, 3).tolist(), abs=1e-6)
    got = {r.id: r.features for r in fitted.transform(df).collect()}
    assert got[999] is None
    centred = dense - dense.mean(0)
    assert np.allclose(np.array([got[k] for k in range(160)]), centred @ fitted.components)
    assert np.allclose(fitted.components.T @ fitted.components, np.eye(3))
    with pytest.raises(ValueError):
        range_pca(df.limit(0), 3, 300, sparse=True)


def test_ratios_are_those_of_the_reducer(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 12)) * np.linspace(3, 0.5, 12)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, item array<double>")
    ratios = Reducer("item", 6, 1.0, None).fit(df).ratios
    assert range_pca(df, 6, 12).ratios == pytest.approx(ratios, abs=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "tanimoto"])
def test_reference_space_without_a_shuffle(spark, metric):
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 30, 6).tolist() for _ in range(20)] if metric == "tanimoto" else rng.normal(size=(20, 4)).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), f"id long, item array<{'int' if metric == 'tanimoto' else 'double'}>")
    refs = df.filter("id IN (11, 3, 7)")
    made = reference_space(df, refs, metric, rescale=False)
    wide = {r.id: r.features for r in reference_space(df, refs, metric, broadcast_limit=0).collect()}
    got = {r.id: r.features for r in made.collect()}
    assert set(got) == set(wide) and all(got[k] == pytest.approx(wide[k], abs=1e-12) for k in wide)
    if metric != "euclidean":
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
