import numpy as np
import pytest
from pyspark.sql import functions as F

from coverset.functions.metrics import METRICS, metric_named, register_sql_metrics
from coverset.operators import cells
from coverset.operators.coverage import coverage, nearest_summary
from coverset.operators.knn import k_nearest
from coverset.operators.nearest import nearest, reference_space
from coverset.operators.neighbours import copy_groups, neighbour_counts, neighbours
from tests import brute


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, d)) * 4
    return (centers[rng.integers(0, 6, n)] + rng.normal(size=(n, d))).tolist()


def bit_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    base = [set(rng.choice(80, 14, replace=False).tolist()) for _ in range(8)]
    rows = []
    for _ in range(n):
        s = set(base[rng.integers(0, 8)])
        for b in rng.choice(80, rng.integers(0, 5), replace=False).tolist():
            s ^= {b}
        rows.append(sorted(s))
    # A third of all rows are copies of one set; some are empty.
    for k in range(0, n, 3):
        rows[k] = rows[0]
    rows[1], rows[2] = [], []
    return rows


@pytest.fixture(scope="module")
def points(spark):
    rows = vectors(150, 3)
    rows[10] = rows[11]
    return rows, spark.createDataFrame(list(enumerate(rows)), "id long, item array<double>").persist()


@pytest.fixture(scope="module")
def sets(spark):
    rows = bit_rows(120)
    return rows, spark.createDataFrame(list(enumerate(rows)), "id long, item array<int>").persist()


def distinct_edges(rows, dist, cutoff, alone=lambda r: False):
    first, copies = {}, {}
    for i, r in enumerate(rows):
        key = (tuple(r), i if alone(r) else None)
        first.setdefault(key, i)
        copies[first[key]] = copies.get(first[key], 0) + 1
    ids = sorted(copies)
    return {(a, b): (round(dist[a, b], 9), copies[a], copies[b]) for a in ids for b in ids if a < b and dist[a, b] <= cutoff}


def collected(found):
    rows = found.collect()
    out = {(r.id_a, r.id_b): (round(r.dist, 9), r.copies_a, r.copies_b) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("block", [None, 16])
def test_euclid_neighbours(points, block):
    rows, df = points
    assert collected(neighbours(df, "euclidean", 1.2, block_rows=block)) == distinct_edges(rows, brute.euclid(rows), 1.2)


@pytest.mark.parametrize("block,cutoff", [(None, 0.4), (4, 0.4), (4, 0.15)])
def test_tanimoto_neighbours(sets, block, cutoff):
    rows, df = sets
    expected = distinct_edges(rows, brute.tanimoto(rows), cutoff, lambda r: not r)
    assert collected(neighbours(df, "tanimoto", cutoff, block_rows=block)) == expected


def test_small_blocks_split_bands_by_bit(sets):
    _, df = sets
    groups = copy_groups(df, "tanimoto")
    assert cells.cells_for(groups, "tanimoto", 0.4, 4).split


def test_neighbour_counts_include_copies(sets):
    rows, df = sets
    dist = brute.tanimoto(rows)
    expected = {i: int((dist[i] <= 0.4).sum() - (dist[i, i] <= 0.4)) for i in range(len(rows))}
    assert {r.id: r.n_neighbours for r in neighbour_counts(df, "tanimoto", 0.4, block_rows=8).collect()} == expected


@pytest.mark.parametrize("limit,block", [(1 << 20, None), (0, 8), (0, None)])
def test_nearest(points, sets, limit, block):
    for (rows, df), metric, dist in ((points, "euclidean", brute.euclid), (sets, "tanimoto", brute.tanimoto)):
        d = dist(rows)
        refs = list(range(0, len(rows), 4))
        found = nearest(df, df.filter(F.col("id").isin(refs)), metric, broadcast_limit=limit, block_rows=block).collect()
        assert len(found) == len(rows)
        for r in found:
            best = min((d[r.id, j], j) for j in refs)
            assert r.dist == pytest.approx(best[0], abs=1e-12) and r.ref_id == best[1]


@pytest.mark.parametrize("block", [None, 16])
def test_k_nearest(points, block):
    rows, df = points
    d = brute.euclid(rows)
    found = {(r.id, r["rank"]): (r.other, r.dist) for r in k_nearest(df, 4, block_rows=block).collect()}
    for i in range(len(rows)):
        order = sorted((d[i, j], j) for j in range(len(rows)) if j != i)[:4]
        for rank, (dist, j) in enumerate(order, 1):
            other, got = found[i, rank]
            assert got == pytest.approx(dist, abs=1e-12) and other == j


def test_hand_coverage(vec_tiny):
    subset = vec_tiny.filter("id IN (0, 3)")
    for small in (0, 1000):
        row = coverage(vec_tiny, subset, 2.0, "euclidean", small_rows=small).first()
        assert row.coverage_ratio == pytest.approx(5 / 6)
        assert (row.mean_distance, row.max_distance, row.median_distance) == (4.0, 20.0, 1.0)
        assert (row.radius_90, row.radius_95) == (20.0, 20.0)
        assert row.hybrid_score == pytest.approx(2 / 3)
    everything = coverage(vec_tiny, vec_tiny, 0.4, "euclidean").first()
    assert everything.coverage_ratio == everything.hybrid_score == 1.0
    assert nearest_summary(vec_tiny, subset, "euclidean").first().median_distance == 1.0


def test_reference_space_keeps_reference_order(fp_tiny):
    refs = fp_tiny.filter("id IN (4, 2)")
    got = {r.id: [round(x, 6) for x in r.features] for r in reference_space(fp_tiny, refs).collect()}
    assert got[0] == [0.6, 0.0] and got[4] == [0.0, 1.0] and got[5] == [0.0, 0.0]


def test_metric_registry_and_sql(spark):
    with pytest.raises(ValueError):
        metric_named("combo")
    register_sql_metrics(spark)
    row = spark.sql(
        "SELECT tanimoto(array(1, 2), array(2, 3)) t, tanimoto(array(), array()) e, "
        "euclid(array(0D, 3D), array(4D, 0D)) d, cosine_distance(array(1D, 0D), array(0D, 2D)) c, "
        "cosine_distance(array(0D), array(1D)) z"
    ).first()
    assert row.t == pytest.approx(2 / 3) and row.e == 1.0 and row.d == 5.0 and row.c == 1.0 and row.z == 1.0


def test_column_and_block_forms_agree(points, sets):
    for (rows, df), names in ((points, ("euclidean", "cosine")), (sets, ("tanimoto",))):
        for name in names:
            m = METRICS[name]
            arrow = df.orderBy("id").toArrow()
            block = m.load(arrow["item"])
            expected = m.matrix(block, block)[0]
            first = df.filter("id = 0").select(F.col("item").alias("first"))
            got = df.withColumn("k", F.lit(1)).join(first.withColumn("k", F.lit(1)), "k").select("id", m.column(F.col("item"), F.col("first")).alias("d"))
            for r in got.collect():
                assert r.d == pytest.approx(expected[r.id], abs=1e-9)


def test_empty_and_bad_rows(spark):
    empty = spark.createDataFrame([], "id long, item array<double>")
    assert neighbours(empty, "euclidean", 1.0).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [1.0, float("nan")]), (3, [1.0, 2.0])], "id long, item array<double>")
    assert [r.id for r in nearest(bad, bad, "euclidean").collect()] == [3]
    assert nearest(bad, empty, "euclidean").count() == 0
