import pytest
from pyspark.sql import functions as F

from tabquest.operators import columns as ops
from tabquest.session import small_table
from tabquest.sources.tables import CATALOG_SCHEMA

CATALOG = [
    ("visits", 1, "Patient Age", "int"),
    ("visits", 2, "fever", "int"),
    ("visits", 3, "fever_days", "int"),
    ("visits", 4, "Record ID", "bigint"),
    ("visits", 5, "country", "string"),
    ("sales", 1, "sold_on", "date"),
    ("sales", 2, "amount", "double"),
    ("wide", 1, "id", "int"),
] + [("wide", i, f"c{i:03d}", "double") for i in range(2, 401)]


@pytest.fixture(scope="module")
def catalog(spark):
    return small_table(spark, CATALOG, CATALOG_SCHEMA)


def ask(spark, *rows):
    return spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(rows)], "question_id int, table_name string, question string")


def test_token_frequency_counts_columns(spark, catalog):
    found = {(r["table_name"], r["token"]): r["frequency"] for r in ops.token_frequency(ops.column_tokens(catalog)).collect()}
    assert found[("visits", "fever")] == 2
    assert found[("visits", "age")] == 1
    assert ("visits", "c001") not in found


def test_scores_exact_partial_and_shared_words(spark, catalog):
    asked = ask(spark, ("visits", "fever in countries, ages"))
    found = {r["ordinal"]: r["score"] for r in ops.score_columns(asked, catalog).collect()}
    # fever is a word of two columns; "ages" only contains "age"; "countries" and "country" contain neither the other.
    assert found == {1: 1.0, 2: 12.5, 3: 12.5}


def test_partial_match_is_divided_by_the_question_words_own_frequency(spark):
    rows = [("t", 1, "day", "int"), ("t", 2, "days", "int"), ("t", 3, "day_two", "int")]
    asked = ask(spark, ("t", "day"))
    found = {r["ordinal"]: r["score"] for r in ops.score_columns(asked, spark.createDataFrame(rows, CATALOG_SCHEMA)).collect()}
    assert found == {1: 12.5, 2: 0.5, 3: 12.5}


def ranked(spark, catalog, question, top):
    rows = ops.rank_columns(ask(spark, question), catalog, top).orderBy("rank").collect()
    return [r["column_name"] for r in rows]


def test_ranking_falls_back_to_table_order(spark, catalog):
    assert ranked(spark, catalog, ("visits", "fever days"), 3) == ["fever_days", "fever", "Patient Age"]
    assert ranked(spark, catalog, ("visits", "is the a"), 2) == ["Patient Age", "fever"]
    assert ranked(spark, catalog, ("visits", "nothing matches"), 2) == ["Patient Age", "fever"]
    assert ranked(spark, catalog, ("visits", "country"), 25) == ["country", "Patient Age", "fever", "fever_days", "Record ID"]


def selected(spark, catalog, question, top):
    row = ops.select_columns(ask(spark, question), catalog, top).first()
    return row["query_mode"], row["column_count"], [c["name"] for c in row["selected_columns"]]


def test_selected_columns_start_with_identifiers(spark, catalog):
    assert selected(spark, catalog, ("visits", "fever days"), 3) == ("focused_filter", 5, ["Record ID", "fever_days", "fever"])
    assert selected(spark, catalog, ("sales", "how many amount"), 2) == ("aggregate", 2, ["sold_on", "amount"])


def test_limit_can_cut_identifiers_but_keeps_one(spark, catalog):
    assert selected(spark, catalog, ("visits", "fever"), 1)[2] == ["Record ID"]
    assert selected(spark, catalog, ("visits", "fever"), 0)[2] == ["Record ID"]


def test_broad_questions_get_the_whole_table(spark, catalog):
    mode, width, names = selected(spark, catalog, ("visits", "full profile"), 1)
    assert (mode, width) == ("broad_profile", 5)
    assert names == ["Record ID", "Patient Age", "fever", "fever_days", "country"]
    assert len(selected(spark, catalog, ("wide", "average of all columns"), 5)[2]) == 400


def test_merge_keeps_first_of_each_name(spark):
    pair = "array<struct<name:string,type:string>>"
    df = spark.createDataFrame([([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4"), ("a", "5")])], f"p {pair}, s {pair}")
    merged = lambda limit: [tuple(c) for c in df.select(ops.merge_columns(F.col("p"), F.col("s"), limit)).first()[0]]
    assert merged(None) == [("a", "1"), ("b", "2"), ("c", "4")]
    assert merged(2) == [("a", "1"), ("b", "2")]
    assert merged(0) == [("a", "1")]


def test_unknown_table_and_unnameable_column_fail(spark, catalog):
    with pytest.raises(Exception, match="Table not found: nowhere"):
        ops.select_columns(ask(spark, ("nowhere", "x")), catalog).collect()
    with pytest.raises(Exception, match="Cannot derive a valid table name"):
        bad = spark.createDataFrame([("t", 1, "%%", "int")], CATALOG_SCHEMA)
        ops.select_columns(ask(spark, ("t", "x")), bad).collect()


def test_questions_are_not_shuffled(spark, catalog):
    asked = spark.range(100_000).selectExpr(
        "id AS question_id", "if(id % 3 = 0, 'sales', 'visits') AS table_name", "concat('fever? ', id) AS question"
    )
    plan = ops.select_columns(asked, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan
