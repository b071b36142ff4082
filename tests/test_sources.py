import pytest
from pyspark.sql import functions as F

from coverset.operators.reduction import Reducer
from coverset.session import checkpoint_dir, lookup_join
from coverset.sources import library, records
from coverset.sources.stages import StageStore
from coverset.streaming.score import assign_batches, assign_stream, reduce_stream

GOOD = """benzene-ish
  made here

  2  1  0  0  0  0            999 V2000
    0.0000    0.0000    0.0000 C   0  0
    1.2000   -0.5000    0.0000 O   0  0
  1  2  2  0
M  END
> <IDNUMBER>
 AB-1 

> <NOTE>
two
lines

"""
UNNAMED = GOOD.replace("> <IDNUMBER>\n AB-1 \n\n", "")
BROKEN = "nothing\nto\nread\nhere\nM  END\n> <IDNUMBER>\nX\n\n"


@pytest.fixture()
def sdf(tmp_path):
    path = tmp_path / "three.SDF"
    path.write_text("$$$$\n".join([GOOD, UNNAMED, BROKEN]) + "$$$$\n")
    return str(path)


def test_sdf(spark, sdf, tmp_path):
    found = library.read_library(spark, sdf).persist()
    assert found.count() == 3
    first = found.filter("name = 'AB-1'").first()
    assert first.props["NOTE"] == "two\nlines" and first.n_atoms == 2
    assert [a.elem for a in first.atoms] == ["C", "O"] and first.atoms[1].y == -0.5
    table = sorted((r.name, r.mol_weight) for r in records.sdf_to_table(found).collect())
    assert table == [("", 27.99), ("AB-1", 27.99)]
    assert records.conversion_report(found).first().asDict() == {"total": 3, "processed": 2, "failed": 1, "empty_names": 1}
    out = str(tmp_path / "again.sdf")
    records.write_sdf_records(found, out)
    assert sorted(r.record for r in library.read_library(spark, out).collect()) == sorted([GOOD, UNNAMED, BROKEN])


def test_sdf_line_ends_and_elements(spark, tmp_path):
    rare = GOOD.replace(" O ", " Xx")
    path = tmp_path / "crlf.sdf"
    path.write_bytes(("$$$$\n".join(["\n" + GOOD.split("\n", 1)[1], rare, BROKEN, GOOD]) + "$$$$\n").replace("\n", "\r\n").encode())
    found = library.read_library(spark, str(path))
    report = records.conversion_report(found).first()
    assert (report.total, report.processed) == (4, 3) and {r.name for r in found.filter("is_valid").collect()} == {"AB-1"}
    assert sorted(r.mol_weight or 0 for r in records.sdf_to_table(found).collect()) == [0, 27.99, 27.99]


def test_csv_by_header(spark, tmp_path):
    path = tmp_path / "any.csv"
    path.write_text('Name,MolWeight,SMILES,Extra\nethanol,46.07,CCO,"two\nlines"\n')
    row = library.read_library(spark, str(path), multi_line=True).first()
    assert (row.SMILES, row.Name, row.MolWeight, row.Extra) == ("CCO", "ethanol", 46.07, "two\nlines")
    (tmp_path / "none.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError):
        library.read_library(spark, str(tmp_path / "none.csv"))


def test_csv_library_and_subset(spark, tmp_path):
    path = tmp_path / "lib.csv"
    path.write_text('SMILES,Name,MolWeight\nCCO,Ethanol,46.07\n"C,C","Quoted ""name""",30.07\n')
    df = library.read_library(spark, str(path))
    assert df.dtypes == [("SMILES", "string"), ("Name", "string"), ("MolWeight", "double")]
    assert {r.Name for r in df.collect()} == {"Ethanol", 'Quoted "name"'}
    with pytest.raises(ValueError):
        library.read_library(spark, "x.xlsx")
    ids = df.filter("MolWeight > 40").select("Name")
    target = library.write_subset(df, ids, str(tmp_path / "out"), "Name", "csv", "gzip", run="20200101_000000")
    assert target.endswith("run=20200101_000000")
    assert [r.Name for r in library.read_library(spark, target, "csv").collect()] == ["Ethanol"]
    metrics = str(tmp_path / "metrics")
    library.write_metrics(spark.createDataFrame([(0.5, 2)], "ratio double, n int"), metrics)
    assert {r.value for r in spark.read.text(metrics).collect()} == {"ratio: 0.5", "n: 2.0"}


def test_stage_store(spark, tmp_path, vec_tiny):
    store = StageStore(spark, str(tmp_path), "r1")
    assert store.load_table("x") is None and store.load_json("x") is None and store.load_reducer("x") is None
    assert store.save_table("x", vec_tiny).count() == 6
    store.save_json("c", {"k": 3})
    assert store.load_json("c") == {"k": 3}
    two = vec_tiny.select("id", F.concat("item", F.array(F.col("id") * 2.0)).alias("item"))
    reducer = Reducer("item", 1).fit(two)
    store.save_reducer("r", reducer)
    assert store.load_reducer("r").kept == reducer.kept


def test_streams(spark, tmp_path, vec_tiny):
    source = str(tmp_path / "in")
    vec_tiny.write.parquet(source)
    centers = spark.createDataFrame([(7, [0.0]), (8, [10.5])], "cluster_id long, center array<double>")
    stream = spark.readStream.schema(vec_tiny.schema).parquet(source)
    scored = assign_stream(stream, centers, 5.0)
    out = str(tmp_path / "out")
    scored.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(out).awaitTermination()
    expected = {0: (7, False), 1: (7, False), 2: (7, False), 3: (8, False), 4: (8, False), 5: (8, True)}
    assert {r.id: (r.cluster_id, r.is_far) for r in spark.read.parquet(out).collect()} == expected
    batches = str(tmp_path / "batches")
    assign_batches(stream, centers, 5.0, batches, str(tmp_path / "c2")).awaitTermination()
    assert {r.id: (r.cluster_id, r.is_far) for r in spark.read.parquet(batches).collect()} == expected
    reducer = Reducer("item", 1, 1.0).fit(vec_tiny)
    pcs = str(tmp_path / "pcs")
    reduce_stream(stream, reducer).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c3")).trigger(
        availableNow=True
    ).start(pcs).awaitTermination()
    batch = {r.id: r.item for r in reducer.transform(vec_tiny).collect()}
    assert {r.id: r.item for r in spark.read.parquet(pcs).collect()} == batch


def test_salted_lookup_gives_the_same_rows(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 5).alias("k"))
    table = spark.createDataFrame([(k, k * 10) for k in range(5)], "k long, v long")
    small = lookup_join(rows, table, "k", "id")
    salted = lookup_join(rows, table, "k", "id", bytes_per_row=1 << 40)
    assert sorted(small.select("id", "v").collect()) == sorted(salted.select("id", "v").collect())
    assert "_salt" not in salted.columns and salted.count() == 200


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
