"""A report over records searches each of them a few times only."""

from pyspark.sql import functions as F

from coverset.sources.records import conversion_report, parse_records, sdf_to_table


def test_report_does_not_take_atoms_apart(spark):
    record = "1\n  made\n\n  2  0  0  0  0  0            999 V2000\n    1.0000    0.5000    0.2500 C   0  0\n    2.0000-   1.0000    0.5000 O   0  0\nM  END\n> <IDNUMBER>\nx\n\n"
    rows = spark.createDataFrame([(record.replace("-", " "),), (None,), ("no record",)], "record string")
    report = conversion_report(parse_records(rows))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 4  # more than ten before: four for the atoms of either block, and the fields once a use
    assert report.first().asDict() == {"total": 3, "processed": 1, "failed": 2, "empty_names": 0}
    assert [r.n_atoms for r in parse_records(rows.filter(F.col("record").isNotNull())).collect()] == [2, 0]


def test_a_table_of_records_searches_each_text_once(spark):
    """The test of a record's validity is not pushed below the parsed columns, where it would parse the text again."""
    ok = "\n  made\n\n  1  0  0  0  0  0            999 V2000\n    1.0000    2.0000    3.0000 C   0  0\nM  END\n> <IDNUMBER>\nA\n\n"
    rows = spark.createDataFrame([(ok,), (ok.replace("  1  0", "  2  0", 1),), (None,)], "record string")
    found = sdf_to_table(parse_records(rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("BEGIN ATOM") == 1 or "Filter" not in plan
    assert [(r.name, r.mol_weight) for r in found.collect()] == [("A", 12.0)]
