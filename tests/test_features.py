import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverset.functions import arrays, filters, fingerprints, text
from coverset.functions.featurize import count_valid, featurize
from coverset.functions.shape import point_shape


def test_fingerprint_is_the_hash_of_all_runs(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, "a"), (4, "x X1 x X2")], "id long, text string")

    def bits(tokens, radius=2, n=1024):
        runs = {" ".join(tokens[i:i + k]) for k in range(1, radius + 2) for i in range(len(tokens) - k + 1)}
        return sorted({int(hashlib.md5(r.encode()).hexdigest()[:8], 16) % n for r in runs})

    got = {r.id: r.fp for r in fingerprints.hashed_fingerprint(df, "text").collect()}
    assert got == {1: bits("a b c".split()), 2: [], 3: bits(["a"]), 4: bits("x X1 x X2".split())}
    coarse = {r.id: r.fp for r in fingerprints.hashed_fingerprint(df, "text", use_features=True).collect()}
    assert coarse[4] == bits("x x# x x#".split())
    tokens = spark.createDataFrame([(1, ["a", "b"])], "id long, t array<string>")
    assert fingerprints.hashed_fingerprint(tokens, "t", radius=0).first().fp == bits(["a", "b"], 0)


def test_fingerprint_forms(spark):
    df = spark.createDataFrame([(1, [0, 63, 64, 100]), (2, []), (3, None)], "id long, bits array<int>")
    rows = df.select(
        "id",
        fingerprints.to_packed(F.col("bits"), 128).alias("packed"),
        fingerprints.to_dense(F.col("bits"), 128).alias("dense"),
        fingerprints.packed_shared_bits(fingerprints.to_packed(F.col("bits"), 128), fingerprints.to_packed(F.array(F.lit(63), F.lit(100), F.lit(5)), 128)).alias("shared"),
    ).orderBy("id").collect()
    assert rows[0].packed == [1 - 2**63, 1 + 2**36] and rows[0].shared == 2
    assert [i for i, x in enumerate(rows[0].dense) if x] == [0, 63, 64, 100] and len(rows[0].dense) == 128
    assert rows[1].packed == [0, 0] and rows[2].packed is None and rows[2].dense == []
    vector = df.filter("id = 1").select(fingerprints.to_vector(F.col("bits"), 128).alias("v")).first().v
    assert vector.size == 128 and vector.numNonzeros() == 4


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, 100.0, 5), (2, 1000.0, 100), (3, 99.9, 5), (4, 500.0, 101), (5, float("nan"), 5), (6, None, 5)], "id long, weight double, atoms int"
    )
    assert [r.id for r in filters.range_filter(df, filters.DEFAULT_BOUNDS).orderBy("id").collect()] == [1, 2]
    flagged = filters.flag_valid(df, ["weight"], {"atoms": (None, 100)})
    assert [r.is_valid for r in flagged.orderBy("id").collect()] == [True, True, True, False, False, False]
    assert filters.valid_rows(flagged).count() == 3 and "is_valid" not in filters.valid_rows(flagged).columns
    assert count_valid(flagged).first().asDict() == {"total": 6, "valid": 3}
    assert df.select(filters.zero_if_missing(F.col("weight")).alias("w")).filter("w = 0").count() == 2
    plan = filters.range_filter(df, {"atoms": (1, 2)})._jdf.queryExecution().optimizedPlan().toString()
    assert "atoms" in plan


def test_array_stats_and_blocks(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], 2.0, [1.0, 3.0]), (2, None, 2.0, [2.0]), (3, [1.0, 1.0], None, []), (4, [0.0, 1.0], 5.0, None)],
        "id long, fp array<double>, mw double, charges array<double>",
    )
    stats = {r.id: (r.charges_mean, r.charges_std, r.charges_min, r.charges_max) for r in arrays.array_stats(df, "charges").collect()}
    assert stats == {1: (2.0, 1.0, 1.0, 3.0), 2: (2.0, 0.0, 2.0, 2.0), 3: (0.0,) * 4, 4: (0.0,) * 4}
    df = df.withColumn("stats", arrays.array_stats_block("charges"))
    got = {r.id: r.features for r in arrays.combine_blocks(df, [("fp", 2), (["mw", "absent"], 2), ("stats", 4)]).collect()}
    assert got[2] == [0.0, 0.0, 2.0, 0.0, 2.0, 0.0, 2.0, 2.0] and got[3] == [1.0, 1.0] + [0.0] * 6


def test_point_shape(spark):
    line = [(1, float(i), 2.0 * i, 0.0) for i in range(5)]
    plane = [(2, float(i), float(j), 0.0) for i in range(3) for j in range(4)]
    cube = [(3, float(i), float(j), float(k)) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    rng = np.random.default_rng(0)
    cloud = (rng.normal(size=(40, 3)) * [1.0, 2.0, 5.0]) @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    points = spark.createDataFrame(line + plane + cube + [(4, *map(float, p)) for p in cloud], "id long, x double, y double, z double")
    got = {r.id: r for r in point_shape(points).collect()}
    assert got[1].sphericity is None and got[2].sphericity is None
    assert got[3].sphericity == pytest.approx(1.0) and got[3].asphericity == pytest.approx(0.0, abs=1e-9)
    values = np.linalg.eigvalsh(np.cov(cloud.T, bias=True))
    assert [got[4].moment_1, got[4].moment_2, got[4].moment_3] == pytest.approx(values.tolist())
    assert got[4].sphericity == pytest.approx(values[0] / values[2])


def test_text(spark):
    df = spark.createDataFrame([(1, "[13CH3]C.Cl"), (2, "ClCBr.CC[2H]"), (3, None)], "id long, s string")
    got = {r.id: (r.a, r.b) for r in df.select("id", text.normalise_smiles_text("s").alias("a"), text.normalise_smiles_text("s", True).alias("b")).collect()}
    assert got[1] == ("[CH3]C.Cl", "[CH3]C") and got[2] == ("ClCBr.CC[H]", "ClCBr") and got[3] == (None, None)
    counts = text.text_counts(df.filter("id = 2"), "s").first()
    assert (counts.carbon, counts.halogen, counts.heavy_atoms) == (3, 2, 5)
    odd = spark.createDataFrame([(1, "[H]O[H]"), (2, "CC(=O)[O-].[Na+]"), (3, "c1cc[nH]c1[Zn][Sn+2]C%12CC%12[13CH3]")], "id long, s string")
    got = {r.id: (r.heavy_atoms, r.nitrogen, r.oxygen, r.carbon, r.ring_closures) for r in text.text_counts(odd, "s").collect()}
    assert got == {1: (1, 0, 1, 0, 0), 2: (5, 0, 2, 2, 0), 3: (11, 1, 0, 8, 2)}


def test_featurize_keeps_failed_rows(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, "9")], "id long, s string")
    got = {r.id: (r.root, r.is_valid) for r in featurize(df, lambda r: {"root": math.sqrt(float(r["s"]))}, "root double", ["id"], 2).collect()}
    assert got == {1: (2.0, True), 2: (None, False), 3: (3.0, True)}
