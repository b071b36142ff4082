import numpy as np
import pytest
from pyspark.sql import functions as F

from coverset.operators import distributions as dist
from coverset.operators import quality
from coverset.operators.coverage import selection_spread
from coverset.operators.quantiles import quantiles, ranked_values
from coverset.operators.reduction import Reducer, pca_reduce, projection_table
from coverset.operators.scaling import scale
from coverset.plans.validation import validate_subset
from tests import brute
from tests.test_pairs import bit_rows, vectors


@pytest.fixture(scope="module")
def labelled(spark):
    rows = vectors(60, 3, 11)
    labels = [i % 4 for i in range(60)]
    for i in (5, 17):
        labels[i] = -1
    labels[59] = 9
    df = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(zip(rows, labels))], "id long, item array<double>, cluster_id long")
    return np.array(rows), np.array(labels), df.persist()


def plain_silhouette(x, y):
    d = brute.euclid(x)
    out = []
    for i in range(len(x)):
        own = (y == y[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i][y == y[i]].sum() / (own - 1)
        b = min(d[i][y == c].mean() for c in set(y) if c != y[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


def plain_db(x, y):
    cs = sorted(set(y))
    m = np.array([x[y == c].mean(0) for c in cs])
    s = np.array([np.linalg.norm(x[y == c] - m[k], axis=1).mean() for k, c in enumerate(cs)])
    return np.mean([max((s[i] + s[j]) / np.linalg.norm(m[i] - m[j]) for j in range(len(cs)) if j != i) for i in range(len(cs))])


def plain_ch(x, y):
    cs = sorted(set(y))
    b = sum((y == c).sum() * np.sum((x[y == c].mean(0) - x.mean(0)) ** 2) for c in cs)
    w = sum(np.sum((x[y == c] - x[y == c].mean(0)) ** 2) for c in cs)
    return b / w * (len(x) - len(cs)) / (len(cs) - 1)


@pytest.mark.parametrize("noise", ["drop", "as_cluster"])
def test_indices(labelled, noise):
    x, y, df = labelled
    keep = y >= 0 if noise == "drop" else np.ones(len(y), dtype=bool)
    assert quality.silhouette(df, noise=noise, block_rows=13).first()[0] == pytest.approx(plain_silhouette(x[keep], y[keep]))
    assert quality.davies_bouldin(df, noise=noise).first()[0] == pytest.approx(plain_db(x[keep], y[keep]))
    assert quality.calinski_harabasz(df, noise=noise).first()[0] == pytest.approx(plain_ch(x[keep], y[keep]))


def test_sizes_inertia_similarity(labelled):
    x, y, df = labelled
    sizes = quality.cluster_sizes(df).first()
    counts = np.array([(y == c).sum() for c in sorted(set(y)) if c >= 0])
    assert (sizes.n_clusters, sizes.min_cluster_size, sizes.max_cluster_size) == (len(counts), counts.min(), counts.max())
    assert sizes.std_cluster_size == pytest.approx(counts.std())
    expected = sum(np.sum((x[y == c] - x[y == c].mean(0)) ** 2) for c in set(y) if c >= 0)
    assert quality.inertia(df).first()[0] == pytest.approx(expected)
    d = brute.euclid(x)
    pairs = [1 - d[i, j] for i in range(60) for j in range(i + 1, 60) if y[i] == y[j] >= 0]
    assert quality.intra_similarity(df, block_rows=7).first()[0] == pytest.approx(np.mean(pairs))
    single = df.filter("id = 1")
    assert quality.intra_similarity(single).first()[0] is None and quality.silhouette(single).first()[0] is None
    assert quality.davies_bouldin(single).first()[0] is None and quality.calinski_harabasz(single).first()[0] is None


def test_evaluate_lists_metrics(labelled):
    _, y, df = labelled
    names = {r.metric for r in quality.evaluate(df, "kmeans").collect()}
    assert {"silhouette_score", "davies_bouldin_score", "calinski_harabasz_score", "n_clusters", "inertia"} <= names
    picks = df.withColumn("cluster_id", F.when(F.col("id") < 3, F.col("id")).otherwise(-1))
    values = {r.metric: r.value for r in quality.evaluate(picks, "maxmin").collect()}
    assert values["selected_ratio"] == pytest.approx(3 / 60) and "max_min_distance" in values
    assert selection_spread(df, df).first().max_min_distance == 0.0


@pytest.mark.parametrize("small", [0, 10_000])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 4, 400), np.full(250, 3.25), [-1e9, 1e9]])
    df = spark.createDataFrame([(0, float(v)) for v in values] + [(1, 5.0)], "grp long, x double")
    got = quantiles(df, [0.0, 0.25, 0.5, 0.9, 1.0], small)
    assert got[0] == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]).tolist())
    assert got[1] == [5.0] * 5
    one = df.filter("grp = 0")
    ranks = [0, 200, 500, len(values) - 1]
    assert ranked_values(one, "x", ranks, len(values), small) == np.sort(values)[ranks].tolist()


@pytest.mark.parametrize("small", [0, 10_000])
def test_scalers(spark, small):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0])], "id long, item array<double>")
    x = np.array([1.0, 2.0, 4.0])
    expected = {
        "standard": (x - x.mean()) / x.std(), "minmax": (x - 1) / 3, "robust": (x - 2) / 1.5, "none of these": x,
    }
    for name, want in expected.items():
        got = [r.item for r in scale(df, name, small_rows=small).orderBy("id").collect()]
        assert [g[0] for g in got] == pytest.approx(want.tolist())
        assert [g[1] for g in got] == ([5.0] * 3 if name == "none of these" else [0.0] * 3)


def test_pca_matches_eigenvalues(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, item array<double>")
    reducer = Reducer("item", 4, 0.95, None).fit(df)
    share = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    share = share / share.sum()
    assert reducer.ratios == pytest.approx(share[:4].tolist())
    assert reducer.kept == int(np.argmax(np.cumsum(share) >= 0.95)) + 1
    got = np.array([r.item for r in reducer.transform(df).orderBy("id").collect()])
    _, vectors_ = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ vectors_[:, ::-1][:, : reducer.kept]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    reducer.save(spark, str(tmp_path / "r"))
    again = Reducer.load(spark, str(tmp_path / "r")).transform(df).orderBy("id").collect()
    assert np.allclose(got, np.array([r.item for r in again]))
    table = reducer.variance_table(spark).orderBy("component").collect()
    assert table[-1].cumulative == pytest.approx(sum(share[:4]))
    assert Reducer("item", method="umap", scaler=None).fit(df).transform(df).first().item == df.first().item
    assert Reducer("item", enabled=False).fit(df).transform(df).first().item == df.first().item
    # A ratio that is never reached keeps the capped count.
    assert Reducer("item", 2, 0.9999, None).fit(df).kept == 2
    assert len(pca_reduce(df, 3, 1.0).first().item) == 3
    split = projection_table(df, df.filter("id < 5"), 2)
    assert split.filter("source = 'subset'").count() == 5 and split.filter("source = 'library' AND selected").count() == 5


def test_distributions(spark):
    rows = [(i, float(v), s) for i, (v, s) in enumerate([(1, 2.0), (2, 4.0), (3, float("nan")), (4, float("inf"))])] + [(9, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, mw double, logp double")
    got = {(r.property, r.source): (r.n, r["mean"], r["std"]) for r in dist.property_compare(df, df.filter("id < 1"), ["mw", "logp"]).collect()}
    assert got["mw", "library"][0] == 4 and got["logp", "library"][0] == 3 and got["mw", "subset"] == (1, 1.0, 0.0)
    hist = dist.histogram_table(df, "mw", 3).orderBy("bin").collect()
    assert [r.n for r in hist] == [1, 1, 2] and sum(r.density * (r.upper - r.lower) for r in hist) == pytest.approx(1.0)
    assert dist.histogram_table(df.filter("id = 9"), "mw").count() == 0
    for points in (24, 200):
        curve = dist.kde_table(df, "mw", points, cut=5.0).orderBy("point").collect()
        assert len(curve) == points
        assert sum(r.density for r in curve) * (curve[1].x - curve[0].x) == pytest.approx(1.0, abs=1e-3)


def test_similarity_tables(spark):
    sets = bit_rows(40, 7)
    df = spark.createDataFrame(list(enumerate(sets)), "id long, item array<int>")
    d = brute.tanimoto(sets)
    values = np.array([1 - d[i, j] for i in range(40) for j in range(i + 1, 40)])
    row = dist.similarity_stats(df, block_rows=6).first()
    assert row.pairs == len(values)
    assert (row["mean"], row.median, row["std"]) == pytest.approx((values.mean(), np.median(values), values.std()))
    long = dist.similarity_long(df.filter("id < 6")).collect()
    assert len(long) == 36 and all(r.similarity == pytest.approx(1 - d[r.id_a, r.id_b]) for r in long)


def test_validation_report(vec_tiny):
    report = validate_subset(vec_tiny, vec_tiny.filter("id IN (0, 3)").select("id"), ["id"], "euclidean", 2.0, bins=4)
    assert report.coverage.first().max_distance == 20.0
    assert report.properties.count() == 2 and report.nearest.count() == 6
    assert sum(r.n for r in report.histogram.collect()) == 6
