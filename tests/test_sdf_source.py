"""The SDF data source: splits, streams, both kinds of blocks."""

import gzip
import random

import pytest
from pyarrow import fs as pafs

from coverset.sources import records, sdf_source

NEW = """{title}
  made

  0  0  0     0  0            999 V3000
M  V30 BEGIN CTAB
M  V30 COUNTS {n} 1 0 0 0
M  V30 BEGIN ATOM
M  V30 1 C 0.0 -1.5 2e-1 0
M  V30 2 Cl -1.5 -
M  V30 0.0 0.0 0 CHG=1
M  V30 END ATOM
M  V30 BEGIN BOND
M  V30 1 1 1 2 3.0 4.0
M  V30 END BOND
M  V30 END CTAB
M  END
> <IDNUMBER>
{title}

"""


def plain(text):
    """Records by the rule: parted by lines that begin with the mark."""
    made, now = [], ""
    for line in text.splitlines(keepends=True):
        if line.startswith("$$$$"):
            made.append(now)
            now = ""
        else:
            now += line
    return [r for r in [*made, now] if r.strip()]


@pytest.mark.parametrize("seed", range(4))
def test_every_split_gives_every_record_once(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a line\n", "$$$$\n", "x$$$$ no mark\n", "\n", "$$$$  \n", "$$ $$\n", "é\n"]) for _ in range(60)) + rng.choice(["", "tail", "$$$$"])
    path = tmp_path / "a.sdf"
    path.write_text(text)
    for chunk in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(sdf_source, "CHUNK", chunk)
        for split in (1, 2, 5, 16, 1000):
            parts = sdf_source.ranges(sdf_source.data_files(str(path)), split)
            got = [r for p in parts for r in sdf_source.read_range(pafs.LocalFileSystem(), p) if r.strip()]
            assert got == plain(text), (chunk, split)


def test_both_blocks_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "in.sdf"
    folder.mkdir()
    texts = [NEW.format(title=f"n{k}", n=2 if k else 3) for k in range(6)]
    (folder / "one.sdf").write_text("$$$$\n".join(texts[:4]) + "$$$$\n")
    with gzip.open(folder / "two.sdf.gz", "wt") as out:
        out.write("$$$$\n".join(texts[4:]) + "$$$$\r\n")
    (folder / "_SUCCESS").write_text("")
    found = sdf_source.scan_sdf(spark, str(folder), 100)
    rows = sorted((r.name, r.n_atoms, r.is_valid) for r in found.collect())
    assert rows == [(f"n{k}", 2, k > 0) for k in range(6)]
    first = found.filter("name = 'n1'").first()
    assert [(a.elem, a.x, a.y, a.z) for a in first.atoms] == [("C", 0.0, -1.5, 0.2), ("Cl", -1.5, 0.0, 0.0)]
    assert sorted(r.mol_weight for r in records.sdf_to_table(found).collect()) == [46.97] * 5
    assert records.read_sdf_records(spark, str(folder / "one.sdf")).filter("is_valid").count() == 3
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        made = sdf_source.stream_sdf(spark, str(folder)).select("name", "is_valid")
        made.writeStream.format("parquet").option("checkpointLocation", state).trigger(once=True).start(out).awaitTermination()
        return sorted(r.name for r in spark.read.parquet(out).collect())

    assert go() == [f"n{k}" for k in range(6)]
    (folder / "zlater.sdf").write_text(NEW.format(title="n9", n=2))
    assert go() == [*(f"n{k}" for k in range(6)), "n9"]
    empty = tmp_path / "none"
    empty.mkdir()
    assert sdf_source.scan_sdf(spark, str(empty)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        sdf_source.scan_sdf(spark, str(tmp_path / "nowhere")).count()


def test_many_small_splits_become_wider_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(sdf_source, "MANY_RANGES", 5)
    path = tmp_path / "many.sdf"
    path.write_text("".join(NEW.format(title=f"r{k}", n=2) + "$$$$\n" for k in range(90)))
    reader = sdf_source.SdfReader({"path": str(path), "splitBytes": "64"})
    parts = reader.partitions()
    assert len(parts) <= 5  # one for each 64 bytes before
    texts = [t for part in parts for (t,) in reader.read(part)]
    assert [t.split("\n", 1)[0] for t in texts] == [f"r{k}" for k in range(90)]
