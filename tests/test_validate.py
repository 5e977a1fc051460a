"""Validation reports of inputs given in different ways."""

from tabquest.plans.validate import validation_report
from tabquest.session import small_table
from tabquest.sources.manifest import FIELDS


def manifest_of(spark):
    row = ("", 0, "data/survey.csv", "m/s.json", "Mental Survey", "site", None, "", "", "", None)
    return small_table(spark, [row], "manifest_file string, entry_pos int, " + ", ".join(f"{f} string" for f in FIELDS))


def test_sql_and_table_come_from_the_first_place_that_has_them(spark):
    rows = [
        (1, "SELECT a FROM survey;", "SELECT b FROM x", None, None, "Mental survey"),
        (2, "", " SELECT b FROM survey ", "SELECT c FROM y", "survey", None),
        (3, None, None, "SELECT c FROM survey", "other", "Mental Survey"),
        (4, None, None, None, None, None),
        (5, "DROP TABLE survey", None, None, None, "unknown dataset"),
    ]
    inputs = spark.createDataFrame(rows, "input_id int, query string, file_text string, generated_sql string, table_name string, dataset_name string")
    found = {r["input_id"]: r for r in validation_report(inputs, manifest_of(spark)).collect()}
    assert found[1]["normalized_sql"] == "SELECT a FROM survey" and found[1]["expected_table"] is not None
    assert found[2]["normalized_sql"] == "SELECT b FROM survey" and found[2]["is_valid"]
    assert not found[3]["is_valid"] and "unexpected table" in found[3]["violations"][0]
    assert not found[4]["is_valid"] and found[4]["normalized_sql"] == ""
    assert not found[5]["is_valid"] and found[5]["expected_table"] is None


def test_no_inputs_and_missing_fields(spark):
    assert validation_report(spark.createDataFrame([], "input_id int"), manifest_of(spark)).count() == 0
    (row,) = validation_report(spark.createDataFrame([(1, "SELECT a FROM t")], "input_id int, generated_sql string"), manifest_of(spark)).collect()
    assert row["is_valid"] and row["detected_tables"] == ["t"]
