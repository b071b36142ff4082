"""Sets as bitmaps of one length, counted two at a time, against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coverset.functions.metrics import Bitmaps, align_sets, metric_named, pack_sets
from coverset.operators import distributions as dist, neighbours as nb, quality, representatives as reps


def _sets(rng, n, top=300):
    made = [sorted(rng.choice(top, rng.integers(0, top), replace=False).tolist()) for _ in range(n)]
    return made + [[], [top - 1], list(range(top)), []]


def _plain(a, b):
    s = np.array([[len(set(x) & set(y)) for y in b] for x in a], float)
    u = np.array([[len(set(x) | set(y)) for y in b] for x in a], float)
    return s, np.divide(s, u, out=np.zeros_like(s), where=u > 0)


@pytest.mark.parametrize("tile, field", [(512, 1 << 12), (16, 1 << 12), (16, 1 << 6)])
def test_bitmaps_count_as_sets_do(monkeypatch, tile, field):
    monkeypatch.setattr(Bitmaps, "TILE", tile)
    monkeypatch.setattr(Bitmaps, "FIELD", field)  # counts beyond it are not paired
    rng, m = np.random.default_rng(3), metric_named("tanimoto")
    one, two = _sets(rng, 60), _sets(rng, 41, 250)
    a, b = (m.load(align_sets(pack_sets(pa.array(x, pa.list_(pa.int32()))))) for x in (one, two))
    assert isinstance(a, Bitmaps) and [a.values[lo:hi].tolist() for lo, hi in zip(a.offsets[:-1], a.offsets[1:])] == one
    shared, similar = _plain(one, two)
    assert (m.shared(a, b) == shared).all() and (m.similarity(a, b) == similar).all()
    mine, theirs = m.similarity_sums(a, b)
    assert np.allclose(mine, similar.sum(1), atol=1e-12) and np.allclose(theirs, similar.sum(0), atol=1e-12)
    for cutoff in (0.0, 0.2, 0.4, 0.75, 1.0, 1.5):
        i, j, d = m.close(a, b, cutoff)
        assert (np.stack([i, j]) == np.stack(np.nonzero(1.0 - similar <= cutoff))).all() and (d == 1.0 - similar[i, j]).all()


def test_sets_that_are_no_bitmaps_stay_as_they_are():
    for odd in ([[5, 5, 2]], [[-3, 4]], [[2**31 - 1]], [[0], [8000], [1]] * 2000):
        assert align_sets(pack_sets(pa.array(odd, pa.list_(pa.int32())))) is None


def test_sums_within_small_and_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(reps, "SMALL", 5)
    monkeypatch.setattr(reps, "SMALL_ROWS", 16)
    rng = np.random.default_rng(4)
    sets = _sets(rng, 116, 40)
    labels = [0] * 60 + [k for k in range(1, 21) for _ in range(3)]
    ids = list(range(len(sets)))
    ids[5], ids[70], ids[117] = 4, 69, 116  # rows of one id, in one cluster, are not each other's neighbours
    rows = spark.createDataFrame(list(zip(ids, sets, labels)), "id long, item array<int>, cluster_id long")
    _, similar = _plain(sets, sets)
    other = (np.array(labels)[:, None] == np.array(labels)) & (np.array(ids)[:, None] != np.array(ids))
    for block in (None, 7):
        sums = reps.similarity_sums(reps.labelled_items(rows, "cluster_id", "id", "item", "tanimoto"), "tanimoto", block).collect()
        assert len(sums) == len({*zip(ids, labels)})
        for r in sums:
            mine = [k for k in range(len(sets)) if ids[k] == r.id and labels[k] == r.label]
            assert r.n_others == other[mine].sum() and abs(r.total - np.where(other, similar, 0.0)[mine].sum()) < 1e-9
    found = quality.intra_similarity(rows, "tanimoto").first()[0]
    assert abs(found - similar[other].mean()) < 1e-9


def test_a_cluster_is_compared_in_one_order(spark):
    """Block pairs and their mirror images: both were compared before."""
    rows = spark.range(3000).select("id", F.array((F.col("id") % 97).cast("int")).alias("item"), F.lit(0).cast("long").alias("label"))
    plan = reps.similarity_sums(rows, "tanimoto", 300)
    text = plan._jdf.queryExecution().analyzed().toString()
    assert "sequence(cast(left_block" in text.replace(" ", "") or "sequence(left_block" in text.replace(" ", "")


def test_pairs_are_counted_by_sizes(monkeypatch):
    """Tiles of bitmaps against single pairs, with copies and with a block against itself."""
    monkeypatch.setattr(Bitmaps, "TILE", 16)
    rng, m = np.random.default_rng(5), metric_named("tanimoto")
    one, two = _sets(rng, 50), _sets(rng, 37, 250)
    a, b = (m.load(align_sets(pack_sets(pa.array(x, pa.list_(pa.int32()))))) for x in (one, two))
    left, right = rng.integers(1, 4, len(one)), np.ones(len(two), np.int64)
    shared, _ = _plain(one, two)
    for copies, once in ((left, None), (np.ones(len(one), np.int64), None), (left, rng.random(shared.shape) < 0.5), (np.ones(len(one), np.int64), rng.random(shared.shape) < 0.5)):
        want = {}
        for i, j in zip(*np.nonzero(np.ones(shared.shape) if once is None else once)):
            key = int(shared[i, j]), int(a.sizes[i] + b.sizes[j] - shared[i, j])
            want[key] = want.get(key, 0) + int(copies[i])
        made = dist._recounted(pa.concat_tables([dist._counted(a, b, copies, right, once)] * 2)).to_pylist()
        assert {(r["shared"], r["whole"]): r["n"] for r in made} == {k: 2 * n for k, n in want.items()}


@pytest.mark.parametrize("mirrored", [False, True])
def test_neighbours_are_counted_by_tiles(monkeypatch, mirrored):
    """The same counts as pair by pair, also where sizes alone settle a tile."""
    monkeypatch.setattr(Bitmaps, "TILE", 8)
    rng, m = np.random.default_rng(6), metric_named("tanimoto")
    sets = [sorted(rng.choice(64, n, replace=False).tolist()) for n in sorted(rng.integers(1, 65, 90).tolist())]
    made = align_sets(pack_sets(pa.array(sets, pa.list_(pa.int32()))))
    x = pa.table({"id": np.arange(90), "item": made, "copies": rng.integers(1, 4, 90), "cross": np.full(90, mirrored), "left_block": np.zeros(90, int), "right_block": np.zeros(90, int)})
    y = x.set_column(0, "id", pa.array(np.arange(40, 130)))
    a, b = m.load(x["item"]), m.load(y["item"])
    for cutoff in (0.1, 0.4, 1.0):
        i, j, d = m.close(a, b, cutoff)
        keep = x["id"].to_numpy()[i] != y["id"].to_numpy()[j]
        pairs = nb._sum_copies(x, y, i[keep], j[keep], d[keep])
        tiles = nb._tile_copies(m, a, b, x, y, cutoff)
        assert all((pairs[c] == tiles[c]).all() for c in ("id", "n"))
    assert any(shared is None for _, _, _, shared in m.near(a, b, 0.4))  # settled by sizes
