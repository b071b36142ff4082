import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverset.operators.assignment import dense_index, from_lists, sample_rows, target_size, to_labels, to_lists
from coverset.operators.butina import butina
from coverset.operators.components import connected_components
from coverset.operators.density import density_cluster
from coverset.operators.kmeans import kmeans, kmeans_from
from coverset.operators.maxmin import maxmin
from coverset.operators.representatives import medoids, nearest_to_means, representatives
from coverset.plans.clustering import cluster
from coverset.plans.selection import run_summary, select_subset
from tests import brute
from tests.test_pairs import bit_rows, vectors


def table(spark, rows, kind="double"):
    return spark.createDataFrame(list(enumerate(rows)), f"id long, item array<{kind}>")


def check_butina(found, dist, cutoff):
    label, centers = brute.butina(dist, cutoff)
    rows = found.collect()
    assert {r.id: r.cluster_id for r in rows} == label
    assert len(rows) == len(dist)
    assert sorted(r.id for r in rows if r.is_center) == sorted(centers)


@pytest.mark.parametrize("finish", [0, 1000])
def test_butina_equals_sequential_rule(spark, finish):
    rows = vectors(80, 2, 3)
    check_butina(butina(table(spark, rows), "euclidean", 0.7, finish_edges=finish), brute.euclid(rows), 0.7)
    sets = bit_rows(60, 5)
    check_butina(butina(table(spark, sets, "int"), "tanimoto", 0.3, finish_edges=finish), brute.tanimoto(sets), 0.3)


def test_butina_by_hand(vec_tiny):
    got = {r.id: (r.cluster_id, r.is_center) for r in butina(vec_tiny, "euclidean", 1.0).collect()}
    assert got == {0: (0, False), 1: (0, True), 2: (0, False), 3: (1, False), 4: (1, True), 5: (2, True)}


def test_maxmin(spark, vec_tiny):
    assert [r.id for r in maxmin(vec_tiny, 3, "euclidean").orderBy("pick_order").collect()] == [0, 5, 4]
    assert maxmin(vec_tiny, 99, "euclidean").count() == 6
    rows = vectors(90, 3, 8)
    df = table(spark, rows)
    expected = brute.maxmin(brute.euclid(rows), 25)
    for pool in (4, 1000):
        found = maxmin(df, 25, "euclidean", pool_rows=pool).orderBy("pick_order").collect()
        assert [r.id for r in found] == expected
        gaps = [r.pick_dist for r in found[1:]]
        assert gaps == sorted(gaps, reverse=True)
    sets = bit_rows(50, 2)
    found = maxmin(table(spark, sets, "int"), 12, "tanimoto", pool_rows=5).orderBy("pick_order").collect()
    assert [r.id for r in found] == brute.maxmin(brute.tanimoto(sets), 12)
    assert maxmin(df, 5, "euclidean", "random", seed=3).collect() == maxmin(df, 5, "euclidean", "random", seed=3).collect()
    with pytest.raises(ValueError):
        maxmin(df, 5, "combo")


@pytest.mark.parametrize("small", [0, 100_000])
def test_density_equals_plain_definition(spark, small):
    rng = np.random.default_rng(4)
    blobs = [rng.normal(c, s, size=(n, 2)) for c, s, n in (((0, 0), 0.4, 22), ((5, 5), 0.5, 18), ((5, -4), 0.3, 14))]
    rows = np.vstack(blobs + [rng.uniform(-9, 9, size=(12, 2))]).tolist()
    expected = brute.density(brute.euclid(rows), 5, 4)
    assert len(set(expected)) > 2
    found = density_cluster(table(spark, rows), 5, 4, block_rows=None if small else 16, small_edges=small)
    got = {r.id: r.cluster_id for r in found.collect()}
    assert brute.same_partition([got[i] for i in range(len(rows))], expected.tolist())


def test_density_edge_cases(spark, vec_tiny):
    assert {r.cluster_id for r in density_cluster(vec_tiny, 5, 5).collect()} == {-1}
    same = table(spark, [[1.0, 1.0]] * 12)
    assert {r.cluster_id for r in density_cluster(same, 3, 2).collect()} == {-1}


@pytest.mark.parametrize("small", [0, 1000])
def test_connected_components(spark, small):
    edges = [(i, i + 1) for i in range(0, 20)] + [(30, 40), (40, 35), (50, 51)]
    nodes = spark.createDataFrame([(i,) for i in list(range(21)) + [30, 35, 40, 50, 51, 60]], "id long")
    got = {r.id: r.comp for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long"), small).collect()}
    assert all(got[i] == 0 for i in range(21))
    assert got[35] == got[40] == got[30] == 30 and got[51] == 50 and got[60] == 60


def test_kmeans_and_selection(spark, vec_tiny):
    fitted = kmeans(vec_tiny, 3, restarts=3)
    labels = {r.id: r.cluster_id for r in fitted.assignment.collect()}
    assert labels[0] == labels[1] == labels[2] and labels[3] == labels[4] and len(set(labels.values())) == 3
    assert fitted.cost == pytest.approx(2.5)
    picked = {r.id for r in select_subset(vec_tiny, "kmeans", "euclidean", fixed=3, restarts=3).collect()}
    assert picked == {1, 3, 5}
    assert {r.id for r in select_subset(vec_tiny, "butina", "euclidean", cutoff=1.0).collect()} == {1, 3, 5}
    assert {r.id for r in select_subset(vec_tiny, "maxmin", "euclidean", fixed=2).collect()} == {0, 5}
    summary = run_summary(vec_tiny.withColumn("is_valid", F.col("id") > 0), vec_tiny.filter("id = 3").select("id")).first()
    assert (summary.records, summary.valid, summary.representatives, summary.subset_percent) == (6, 5, 1, 20.0)


def test_kmeans_from_given_centres(spark, vec_tiny):
    start = vec_tiny.filter("id IN (0, 3, 5)").select(F.col("id").alias("cluster_id"), F.col("item").alias("center"))
    found = kmeans_from(vec_tiny, start)
    assert {r.id: r.cluster_id for r in found.assignment.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert found.cost == pytest.approx(2.5)
    far = start.unionByName(spark.createDataFrame([(9, [1e6] * len(vec_tiny.first().item))], start.schema))
    kept = {r.cluster_id: r.center for r in kmeans_from(vec_tiny, far).centers.collect()}
    assert len(kept) == 4 and kept[9][0] == 1e6


def test_sample_by_counting(spark):
    df = spark.range(500).unionByName(spark.range(3).selectExpr("7L AS id"))
    order = sorted((r.id for r in df.collect()), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    for n in (0, 1, 60, 499, 503, 900):
        for small in (0, 1_000_000):
            assert sorted(r.id for r in sample_rows(df, n, small_rows=small).collect()) == sorted(order[:n])


def test_cluster_reports_failures(spark, vec_tiny):
    assert cluster(vec_tiny, "nothing").status == "error"
    assert cluster(vec_tiny, "maxmin", "combo").status == "error"
    assert cluster(spark.createDataFrame([], "id long, item array<double>"), "kmeans").status == "error"
    done = cluster(vec_tiny, "maxmin", "euclidean", fixed=2)
    assert done.status == "success"
    assert {r.id: r.cluster_id for r in done.assignment.collect()} == {0: 0, 1: -1, 2: -1, 3: -1, 4: -1, 5: 1}


def test_representatives(spark):
    rows = [(0, [0.0], 0), (1, [1.0], 0), (2, [2.0], 0), (3, [9.0], 1), (4, [7.0], -1)]
    df = spark.createDataFrame(rows, "id long, item array<double>, cluster_id long")
    assert {(r.cluster_id, r.id) for r in medoids(df, "euclidean").collect()} == {(0, 1), (1, 3)}
    assert {(r.cluster_id, r.id) for r in representatives(df, "first").collect()} == {(0, 0), (1, 3)}
    assert {(r.cluster_id, r.id) for r in nearest_to_means(df).collect()} == {(0, 1), (1, 3)}
    assert representatives(df, "random").collect() == representatives(df, "random").collect()
    with pytest.raises(ValueError):
        representatives(df, "best")


def test_medoid_of_a_hot_cluster_in_blocks(spark):
    sets = bit_rows(60, 9)
    df = table(spark, sets, "int").withColumn("cluster_id", F.when(F.col("id") < 45, 0).otherwise(F.col("id") % 3))
    d = brute.tanimoto(sets)
    labels = [0 if i < 45 else i % 3 for i in range(60)]
    best = {}
    for c in set(labels):
        members = [i for i in range(60) if labels[i] == c]
        score = {i: round(np.mean([1 - d[i, j] for j in members if j != i]), 9) for i in members}
        best[c] = max(members, key=lambda i: (score[i], -i))
    assert {r.cluster_id: r.id for r in medoids(df, "tanimoto", block_rows=8).collect()} == best


def test_assignment_helpers(spark, vec_tiny):
    assert target_size(1000) == 10 and target_size(50) == 2 and target_size(2, 90) == 2 and target_size(1000, clamp=False) == 10
    assert target_size(10, fixed=7) == 7
    numbered = dense_index(vec_tiny, [F.col("id").desc()]).collect()
    assert {r.id: r["index"] for r in numbered} == {i: 5 - i for i in range(6)}
    picks = maxmin(vec_tiny, 2, "euclidean")
    assert {r.id: r.label for r in to_labels(vec_tiny, picks).collect()} == {0: 0, 1: -1, 2: -1, 3: -1, 4: -1, 5: 1}
    found = butina(vec_tiny, "euclidean", 1.0)
    lists = {r.cluster_id: r.members for r in to_lists(found).collect()}
    assert lists == {0: [1, 0, 2], 1: [4, 3], 2: [5]}
    assert from_lists(to_lists(found, list_rows=2)).count() == 6
    assert sample_rows(vec_tiny, 3).count() == 3
    assert sorted(r.id for r in sample_rows(vec_tiny, 3).collect()) == sorted(r.id for r in sample_rows(vec_tiny, 3).collect())


def test_density_of_copies_and_by_a_searched_tree(spark, monkeypatch):
    """Groups of copies enter as one row; the search goes down the tree; both give the plain result."""
    from coverset.operators import density

    rng = np.random.default_rng(8)
    blobs = [rng.normal(c, s, size=(n, 2)) for c, s, n in (((0, 0), 0.4, 14), ((5, 5), 0.5, 12), ((5, -4), 0.3, 10))]
    points = np.vstack(blobs + [np.array([[9.0, 9.0], [9.3, 9.0], [-7.0, 2.0]]), rng.uniform(-9, 9, size=(8, 2))])
    rows = np.repeat(points, rng.choice([1, 1, 2, 7, 9], len(points)), axis=0)
    rows = rows[rng.permutation(len(rows))].tolist()
    expected = brute.density(brute.euclid(rows), 5, 4)
    assert len(set(expected.tolist())) > 3
    searched, merged, compared = [], density.spanning_tree, []
    monkeypatch.setattr(density, "prunes", lambda *a, **k: searched.append(1) or True)
    monkeypatch.setattr(density, "spanning_tree", lambda points, near, block, edges: compared.append(points.count()) or merged(points, near, block, edges))
    found = density.density_cluster(table(spark, rows), 5, 4, block_rows=24)
    got = {r.id: r.cluster_id for r in found.collect()}
    assert brute.same_partition([got[i] for i in range(len(rows))], expected.tolist())
    assert searched and compared[0] < len(rows)
