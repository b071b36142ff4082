"""Sets as bytes, run hashes of a whole batch, and links without a pair table, against plain versions."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from coverset.functions.fingerprints import hashed_fingerprint, md5_heads, to_dense, to_packed
from coverset.functions.metrics import metric_named, pack_sets, unpack_sets
from coverset.operators import neighbours as nb


def test_sets_come_back_from_bytes():
    rng = np.random.default_rng(0)
    sets = [sorted(rng.choice(rng.choice([20, 1000, 10**6]), rng.integers(0, 18), replace=False).tolist()) for _ in range(300)]
    sets += [[5, 5, 2], [-3, 4], [2**31 - 1], []]
    column = pa.array(sets, pa.list_(pa.int32()))
    assert unpack_sets(pack_sets(column)).to_pylist() == sets
    assert unpack_sets(pack_sets(column.slice(3, 50)).slice(2)).to_pylist() == sets[5:53]
    assert len(pack_sets(pa.array([list(range(0, 1024, 3))], pa.list_(pa.int32())))[0].as_py()) == 129  # 1368 bytes as ints


def test_close_pairs_are_those_of_the_matrix():
    rng = np.random.default_rng(1)
    m = metric_named("tanimoto")
    block = m.load(pa.array([sorted(rng.choice(40, rng.integers(0, 18), replace=False).tolist()) for _ in range(200)], pa.list_(pa.int32())))
    far = m.matrix(block, block)
    for cutoff in (0.0, 0.3, 0.4, 0.75, 1.0, 1.5):
        i, j, d = m.close(block, block, cutoff)
        assert (np.stack([i, j]) == np.stack(np.nonzero(far <= cutoff))).all() and (d == far[i, j]).all()


def test_heads_of_hashes():
    parts = [b"", b"a", b"x" * 55, b"y" * 56, b"z" * 200, "Grüße 12".encode()]
    ends = np.cumsum([len(p) for p in parts])
    text = np.frombuffer(b"".join(parts), np.uint8)
    found = md5_heads(text, ends - [len(p) for p in parts], np.array([len(p) for p in parts]))
    assert found.tolist() == [int(hashlib.md5(p).hexdigest()[:8], 16) for p in parts]


def test_fingerprints_of_odd_rows(spark):
    rows = [(0, ["a", None, "b", "c"]), (1, None), (2, []), (3, ["ä" * 40, "b", "ä" * 40])]
    found = {r.id: r.fp for r in hashed_fingerprint(spark.createDataFrame(rows, "id long, t array<string>"), "t").collect()}
    bit = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % 1024
    assert found[0] == sorted({bit(s) for s in ("a", "b", "c", "b c")}) and found[1] is None and found[2] == []
    long = "ä" * 40
    assert found[3] == sorted({bit(s) for s in (long, "b", f"{long} b", f"b {long}", f"{long} b {long}")})


def test_dense_and_packed_forms_of_odd_rows(spark):
    bits = spark.createDataFrame([(0, [1, 5, 70]), (1, None), (2, []), (3, [1023, 2000, -4, None])], "id long, b array<int>")
    found = {r.id: r for r in bits.select("id", to_packed(F.col("b"), 128).alias("p"), to_dense(F.col("b"), 6).alias("d")).collect()}
    assert [found[k].p for k in range(4)] == [[34, 64], None, [0, 0], [0, 0]]
    assert found[0].d == [0.0, 1.0, 0.0, 0.0, 0.0, 1.0] and found[1].d == [] and sum(found[3].d) == 0.0


def test_links_and_components_without_pairs(spark):
    rng = np.random.default_rng(2)
    points = np.round(rng.random((300, 2)), 2)
    points[50:60] = points[0]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, item array<double>")
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)) <= 0.05
    np.fill_diagonal(near, False)
    least = np.arange(300)
    for _ in range(300):
        least = np.minimum(least, np.where(near, least[None, :], 300).min(1))
    for rows in (None, 20):
        found = {r.id: r for r in nb.linked(df, "euclidean", 0.05, block_rows=rows).collect()}
        assert [found[i].n_links for i in range(300)] == near.sum(1).tolist()
        assert [found[i].component_id for i in range(300)] == least.tolist()


def test_pairs_of_a_block_are_thinned_to_spanning_links():
    ids = pa.table({"id": np.arange(50), "copies": np.ones(50, np.int64)})
    i, j = np.nonzero(~np.eye(50, dtype=bool))
    made = nb._rooted(ids, ids, i, j, None)
    assert len(made["id"]) <= 100 and made["n"].sum() == 50 * 49  # 2450 pairs
