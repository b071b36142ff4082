import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from coverset.operators import cells


def test_small_blocks_do_not_copy_rows_by_their_number(spark):
    """Every pair once, and a row is copied for a few tiles only, however small the blocks asked for."""
    rows = spark.range(600).select("id", F.lit(0).cast("long").alias("cell"))
    counted = lambda x, y: pa.table({"left": np.full(1, x.num_rows), "right": np.full(1, y.num_rows)})
    found = cells.blocked(rows, rows, counted, "left long, right long", True, 5, True).collect()
    assert sum(r.left * r.right for r in found) == 600 * 600
    assert len(found) <= (2 * np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism)) + 1) ** 2  # 14400 block pairs before


def test_long_sets_are_not_copied_for_each_rare_bit(spark):
    rng = np.random.default_rng(1)
    sets = [(i, sorted(rng.choice(900, 60, replace=False).tolist())) for i in range(200)]
    groups = spark.createDataFrame(sets, "id long, item array<int>").withColumn("copies", F.lit(1).cast("long"))
    assert cells.cells_for(groups, "tanimoto", 0.4, 4).split == []


def test_results_of_pieces_are_combined(spark, monkeypatch):
    monkeypatch.setattr(cells, "MAX_BLOCK", 7)
    rows = spark.range(100).select("id", F.lit(0).cast("long").alias("cell"))
    step = cells._block_pairs(
        lambda x, y: pa.table({"id": x["id"], "n": np.full(x.num_rows, y.num_rows), "s": np.full(x.num_rows, float(sum(y["id"].to_pylist())))}),
        pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s", pa.float64())]), cells.summed(["id"], ["n", "s"]),
    )

    def batches():
        for cell in (0, 1):
            for side in (0, 1):
                for ids in np.array_split(np.arange(100), 9):
                    same = [np.full(len(ids), v) for v in (cell, 0, 0, side)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(ids)], names=["cell", "left_block", "right_block", "_side", "id"])

    made = pa.Table.from_batches(list(step(batches()))).to_pylist()
    assert rows.count() == 100 and len(made) == 200
    assert all(r["n"] == 100 and r["s"] == 4950.0 for r in made)
