"""Every SQL of this subpackage runs, and its rows are the query's."""

import duckdb
import pytest

from coverset.llm import langid, licenses
from coverset.llm.embeddings import near_duplicates
from coverset.llm.oracle import ORACLE, _holds
from coverset.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", ["op5_decontaminate", "op7_licenses", "op8_sharding", "op12_prefix_trie", "op13_resample"])
def test_rows_are_those_of_the_sql(spark, tables, name):
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    found = tables.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    assert sorted(map(tuple, mine.select(columns).collect()), key=key) == sorted(found, key=key)


def test_every_sql_runs(tables):
    for sql in ORACLE.values():
        assert tables.execute(sql).fetchall()


def test_copyright_lines_in_sql(tables):
    lines = [
        "Copyright 2020 X", "copyright notice and this", "(c) 2001 Firm", "(c) You must", "© Firm", "©", "Copyright Holders BE", "copyright by Jane", "copyright by jane",
        "All rights reserved.", "all rights reserved by us", "# (C) Copyright IBM", "© Copyright holders", "é Copyright X", "copyright, Inc", "Copyright © in", "copyright Ownersx",
    ]
    for line in lines:
        assert tables.execute(f"SELECT {_holds('?::VARCHAR')}", [line] * _holds("?::VARCHAR").count("?::VARCHAR")).fetchone()[0] == bool(licenses.COPYRIGHT.match(line)), line


def test_letters():
    assert langid.has_letter("²½ x") and langid.has_letter("я") and langid.has_letter("ª")
    assert not any(map(langid.has_letter, ["²³", "½ ¼", "12 _", "", "Ⅷ"]))


def test_vectors_of_mixed_length(spark):
    rows = [(1, [1.0, 0.1]), (2, [1.0, 0.11]), (3, [1.0, 0.1, 0.0, 0.0]), (4, [1.0, 0.1, 0.0, 0.01]), (5, [1.0, 0.1, 0.0]), (6, None), (7, [])]
    rows += [(100 + k, [1.0, 0.1] + [0.0] * (k % 4)) for k in range(40)]
    made = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=8).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in made}
    same = {n: [i for i, v in rows if v and len(v) == n] for n in (2, 3, 4, 5)}
    for n, ids in same.items():
        assert all(got[i] == (len(ids) - 1, min(ids)) for i in ids), n
    assert got[6] == (0, 6) and got[7] == (0, 7)
