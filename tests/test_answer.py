import json

import pytest
from pyspark.sql import functions as F

from tabquest.operators import lookups
from tabquest.plans.answer import (
    accept_generated,
    answer_batch,
    candidate_contexts,
    enrich,
    generated_payloads,
    inspect_tables,
    prepare_contexts,
    prepare_requests,
    retrieve,
    run_accepted,
)
from tabquest.plans.embed import dataset_documents, embed
from tabquest.plans.profile import build_metadata
from tabquest.plans.prompts import candidates_prompt, plain_number, single_table_prompt
from tabquest.session import small_table, work_dir
from tabquest.sources.manifest import FIELDS
from tabquest.sources.metadata import read_contexts, read_payloads
from tabquest.sources.tables import catalog_of

GENERATED = (
    "question_id int, generated struct<chosen_candidate_index:int, chosen_dataset_name:string, suggested_mode:string, "
    "final_mode:string, mode_decision:string, table_name:string, scope:string, sql:string, "
    "selected_columns_used:array<string>, explanation:string>"
)


@pytest.fixture(scope="module")
def world(spark):
    survey = spark.createDataFrame([(i, "yes" if i % 3 else "no", "a, b") for i in range(30)], "id int, treatment string, tags string")
    labels = spark.createDataFrame([(1, "aspirin50")], "drug_1 int, drug_name string")
    datasets = {"data/survey.csv": survey, "data/labels.csv": labels}
    survey.createOrReplaceTempView("mental_survey")
    labels.createOrReplaceTempView("labels")
    rows = [
        ("", 0, "data/survey.csv", "m/s.json", "Mental Survey", "site", None, "", "Survey about treatment of respondents.", "tags is a list", None),
        ("", 1, "data/labels.csv", "m/l.json", "", "", None, "", "Drug labels with side effects.", "", "Labels"),
    ]
    manifest = small_table(spark, rows, "manifest_file string, entry_pos int, " + ", ".join(f"{f} string" for f in FIELDS))
    metadata = build_metadata(manifest, datasets)
    catalog = catalog_of(spark, {"mental_survey": survey, "labels": labels})
    store = embed(dataset_documents(metadata, manifest), "document")
    return manifest, metadata, catalog, store, lookups.dataset_contexts(manifest, metadata, catalog)


QUESTIONS = [(1, "How many respondents received treatment?"), (2, "Show all columns of drug labels"), (3, "side effects of drug aspirin")]


@pytest.fixture(scope="module")
def questions(spark):
    return small_table(spark, QUESTIONS, "question_id int, question string")


def test_retrieve_and_enrich(world, questions):
    manifest, metadata, catalog, store, datasets = world
    rows = enrich(retrieve(questions, store), datasets).orderBy("question_id", "rank").collect()
    assert [(r["question_id"], r["rank"], r["table_name"]) for r in rows] == [
        (1, 1, "mental_survey"), (1, 2, "labels"), (2, 1, "labels"), (2, 2, "mental_survey"),
        (3, 1, "labels"), (3, 2, "mental_survey"),
    ]
    assert rows[0]["description"].startswith("Survey about treatment of respondents. It contains 30 rows and 3 columns")
    assert rows[0]["notes"] == "tags is a list" and [c["name"] for c in rows[0]["schema"]] == ["id", "treatment", "tags"]
    assert rows[1]["dataset_name"] == "labels"


def test_unknown_records_fail(spark, world):
    manifest, metadata, catalog, _, datasets = world
    found = spark.createDataFrame([(1, "data/gone.csv"), (2, " data/labels.csv ")], "question_id int, file_path string")
    assert enrich(found.filter("question_id = 2"), datasets).first()["table_name"] == "labels"
    with pytest.raises(Exception, match="was not found in the manifest: data/gone.csv"):
        enrich(found, datasets).collect()
    with pytest.raises(Exception, match="Table not found: labels"):
        fewer = lookups.dataset_contexts(manifest, metadata, catalog.filter("table_name != 'labels'"))
        enrich(found.filter("question_id = 2"), fewer).collect()


def test_contexts_and_prompts(world, questions):
    manifest, metadata, catalog, store, datasets = world
    asked = enrich(retrieve(questions, store), datasets).join(questions, "question_id")
    contexts = candidate_contexts(asked, catalog, top_columns=1)
    row = contexts.select("*", candidates_prompt(F.col("question"), F.col("context")).alias("p")).filter("question_id = 1").first()
    first, second = row["context"]["candidates"]
    assert row["context"]["suggested_candidate_index"] == 0 and row["context"]["suggested_dataset_name"] == "Mental Survey"
    assert (first["candidate_index"], first["query_mode"], first["column_count"]) == (0, "aggregate", 3)
    assert [c["name"] for c in first["selected_columns"]] == ["id"] and second["table_name"] == "labels"
    lines = row["p"].split("\n")
    assert lines[1:6] == [
        "Question: How many respondents received treatment?", "Suggested candidate index: 0",
        "Suggested dataset name: Mental Survey", "", "Candidates:",
    ]
    assert lines[6] == "Candidate 0:" and "- Available columns:" in lines and "  - id (int)" in lines
    start = lines.index("Candidate 1:")
    assert lines[start - 1] == "" and lines[lines.index("Requirements:") - 2 :][:2] == ["", ""]


def test_single_table_prompt_and_blank_question(spark, world):
    catalog = world[2]
    asked = small_table(spark, [(1, "labels", "drug name")], "question_id int, table_name string, question string")
    row = prepare_contexts(asked, catalog).select(
        single_table_prompt(F.col("question"), F.col("query_mode"), F.col("table_name"), F.col("column_count"), F.col("selected_columns")).alias("p")
    ).first()
    assert row["p"].split("\n")[1:9] == [
        "Question: drug name", "Suggested mode: focused_filter", "Table name: labels", "Full column count: 2",
        "Available columns:", "- drug_1 (int)", "- drug_name (string)", "",
    ]
    with pytest.raises(Exception, match="Question is required"):
        prepare_contexts(asked.withColumn("question", F.lit("  ")), catalog).collect()


def test_requests_by_table_or_dataset(spark, world):
    manifest, _, catalog, _, _ = world
    rows = [(1, "drug name", None, "LABELS"), (2, "", "mental_survey", None), (3, "tags?", "", " mental survey ")]
    asked = small_table(spark, rows, "question_id int, question string, table_name string, dataset_name string")
    named = asked.filter("question_id > 1")
    found = {r["question_id"]: r for r in inspect_tables(named, manifest, catalog, 1).collect()}
    assert found[2]["suggested_columns"] is None and found[2]["column_count"] == 3
    assert [c["name"] for c in found[3]["suggested_columns"]] == ["tags"] and len(found[3]["schema"]) == 3
    row = prepare_requests(named.filter("question_id = 3"), manifest, catalog, 2).first()
    assert row["table_name"] == "mental_survey" and [c["name"] for c in row["selected_columns"]] == ["id", "tags"]
    with pytest.raises(Exception, match="Dataset not found in manifest: LABELS"):
        prepare_requests(asked.filter("question_id = 1"), manifest, catalog).collect()
    with pytest.raises(Exception, match="Provide a table or a dataset"):
        prepare_requests(asked.filter("question_id = 1").withColumn("dataset_name", F.lit("")), manifest, catalog).collect()


def test_saved_contexts_and_payloads_read_back(spark, world, questions):
    manifest, metadata, catalog, store, datasets = world
    asked = enrich(retrieve(questions, store), datasets).join(questions, "question_id")
    contexts = candidate_contexts(asked, catalog, top_columns=2)
    folder = work_dir(spark, "saved")
    contexts.select("question", "context.*").write.json(f"{folder}/contexts")
    again = read_contexts(spark, f"{folder}/contexts", one_per_file=False)
    assert {r["question"]: r["candidates"] for r in again.collect()} == {
        r["question"]: r["context"]["candidates"] for r in contexts.collect()
    }
    record = (0, "Mental Survey", "aggregate", "aggregate", "kept", "mental_survey", "focused_schema", "SELECT 1 FROM mental_survey", ["id"], "why")
    generated = spark.createDataFrame([(1, record)], GENERATED)
    accepted = accept_generated(contexts, generated)
    assert accepted.filter("problem is not null").count() == 2  # two questions without generated SQL
    generated_payloads(accepted, "some-model").write.json(f"{folder}/payloads")
    row = read_payloads(spark, f"{folder}/payloads", one_per_file=False).first()
    assert row["table_name"] == "mental_survey" and tuple(row["generated_query"])[7] == "SELECT 1 FROM mental_survey"


def test_plain_number(spark):
    df = small_table(spark, [(0.0,), (0.5,), (0.000123,), (1.25,), (1.0,)], "x double")
    assert [r[0] for r in df.select(plain_number(F.col("x"))).collect()] == ["0.0", "0.5", "0.000123", "1.25", "1.0"]


def test_answer_batch(spark, world, questions):
    manifest, metadata, catalog, store, datasets = world

    def written(index, table, sql, mode="aggregate"):
        return (index, "d", "s", mode, "kept", table, "focused_schema", sql, [], "")

    generated = spark.createDataFrame(
        [
            (1, written(0, "mental_survey", 'SELECT "treatment", COUNT(*) AS n FROM "mental_survey" GROUP BY "treatment" ORDER BY n;')),
            (2, written(1, "mental_survey", "SELECT a FROM mental_survey JOIN labels ON 1 = 1")),
            (3, written(1, "labels", "SELECT 1 FROM labels")),
        ],
        GENERATED,
    )
    output, metrics = answer_batch(spark, questions, store, manifest, metadata, catalog, generated)
    rows = {r["question_id"]: r for r in output.collect()}
    assert rows[1]["status"] == "executed"
    assert [json.loads(x) for x in rows[1]["records"]] == [{"treatment": "no", "n": 10}, {"treatment": "yes", "n": 20}]
    assert rows[1]["selected_dataset"]["table_name"] == "mental_survey"
    assert [c["table_name"] for c in rows[1]["retrieved_candidates"]] == ["mental_survey", "labels"]
    assert rows[2]["status"] == "validation_failed" and rows[2]["records"] is None
    assert rows[2]["validation"]["violations"] == ["JOIN queries are not allowed in the current phase."]
    assert rows[2]["selected_dataset"]["dataset_name"] == "Mental Survey"
    assert rows[3]["status"] == "error" and rows[3]["problem"].startswith("Generated table name does not match")
    found = {r["question"]: r for r in metrics.collect()}
    assert found[QUESTIONS[0][1]]["execution"] == (True, 2)
    assert found[QUESTIONS[1][1]]["retrieval"]["candidate_changed_by_model"] is True
    assert found[QUESTIONS[1][1]]["validation"] == (False, 1)
    assert found[QUESTIONS[2][1]]["validation"] == (None, 0) and found[QUESTIONS[2][1]]["error_message"]


def test_query_that_spark_rejects_is_an_invalid_one(spark, world, questions):
    manifest, metadata, catalog, store, datasets = world
    generated = spark.createDataFrame(
        [(1, (0, "d", "s", "aggregate", "k", "mental_survey", "focused_schema", "SELECT nope FROM mental_survey", [], ""))], GENERATED
    )
    output, _ = answer_batch(spark, questions.filter("question_id = 1"), store, manifest, metadata, catalog, generated)
    row = output.first()
    assert row["status"] == "validation_failed" and not row["validation"]["is_valid"]
    assert row["validation"]["violations"][0].startswith("Spark rejected the query")


def one_more(spark, n):
    spark.range(n).selectExpr("id", "id % 7 AS g").createOrReplaceTempView("numbers")


def audited_rows(spark, texts):
    rows = [(i, sql, True) for i, sql in enumerate(texts)]
    return spark.createDataFrame(rows, "question_id long, normalized_sql string, is_valid boolean")


def test_concurrent_queries_lose_nothing(spark):
    one_more(spark, 50)
    texts = [f'SELECT "id", {i} AS k FROM "numbers" WHERE "g" = {i % 7}' for i in range(110)] + ['SELECT "id" FROM "numbers"'] * 10
    results, outcomes = run_accepted(spark, audited_rows(spark, texts), limit=5, at_once=8)
    found = {r["question_id"]: r for r in outcomes.collect()}
    assert len(found) == 120
    assert all(r["engine_error"] is None and r["run_error"] is None and r["row_count_returned"] == 5 for r in found.values())
    rows = results.groupBy("question_id").agg(F.count("*").alias("n"), F.min("record").alias("r")).collect()
    assert len(rows) == 120 and {r["n"] for r in rows} == {5}
    assert all(r["question_id"] >= 110 or json.loads(r["r"])["k"] == r["question_id"] for r in rows)


def test_outcomes_tell_rejected_from_failed(spark):
    one_more(spark, 10)
    texts = ["SELECT id FROM numbers", "SELECT nope FROM numbers", "SELECT FROM WHERE", "SELECT 1 / (id - id) FROM numbers"]
    results, outcomes = run_accepted(spark, audited_rows(spark, texts), at_once=4)
    found = {r["question_id"]: r for r in outcomes.collect()}
    assert found[0]["row_count_returned"] == 10
    assert all(found[i]["engine_error"] and found[i]["run_error"] is None for i in (1, 2))
    assert found[3]["engine_error"] is None and "DIVIDE_BY_ZERO" in found[3]["run_error"]
    assert all(found[i]["row_count_returned"] is None for i in (1, 2, 3))
    assert {r["question_id"] for r in results.collect()} == {0}
    empty, nothing = run_accepted(spark, audited_rows(spark, texts).filter("question_id < 0"))
    assert empty.count() == nothing.count() == 0


def test_every_question_has_one_row(spark, world, questions):
    manifest, metadata, catalog, store, datasets = world

    def written(sql):
        return (0, "d", "s", "aggregate", "kept", "mental_survey", "focused_schema", sql, [], "")

    texts = {1: "SELECT id FROM mental_survey", 2: "SELECT nope FROM mental_survey", 3: "SELECT id FROM mental_survey JOIN x ON 1 = 1"}
    first = questions.filter("question_id = 1").first()["question"]
    asked = small_table(
        spark, [(i, first) for i in (1, 2, 3, 4, 5)] + [(6, "  "), (7, None)], "question_id int, question string"
    )
    texts[4] = "SELECT 1 / 0 AS x FROM mental_survey"
    generated = spark.createDataFrame([(i, written(sql)) for i, sql in texts.items()], GENERATED)
    output, metrics = answer_batch(spark, asked, store, manifest, metadata, catalog, generated)
    rows = {r["question_id"]: r for r in output.collect()}
    assert len(rows) == output.count() == metrics.count() == 7
    assert [rows[i]["status"] for i in range(1, 8)] == ["executed", "validation_failed", "validation_failed", "error", "error", "error", "error"]
    assert "DIVIDE_BY_ZERO" in rows[4]["problem"]
    assert rows[6]["problem"] == rows[7]["problem"] == "Question is required."


def test_unknown_dataset_is_a_problem_of_its_question(spark, world, questions):
    manifest, metadata, catalog, store, datasets = world
    lost = store.withColumn("file_path", F.when(F.col("dataset_name") == "Mental Survey", F.lit("gone.csv")).otherwise(F.col("file_path")))
    generated = spark.createDataFrame([], GENERATED)
    output, metrics = answer_batch(spark, questions, lost, manifest, metadata, catalog, generated)
    problems = {r["problem"] for r in output.collect()}
    assert problems == {"Retrieved dataset was not found in the manifest: gone.csv"}
    assert output.count() == metrics.count() == questions.count()


def test_prompts_can_name_the_engine(spark):
    columns = F.array(F.struct(F.lit("id").alias("name"), F.lit("int").alias("type")))
    make = lambda **more: single_table_prompt(F.lit("q"), F.lit("m"), F.lit("t"), F.lit(1), columns, **more)
    fixed, named = spark.range(1).select(make().alias("a"), make(dialect="Spark").alias("b")).first()
    assert "DuckDB" in fixed and "DuckDB" not in named and fixed.replace("DuckDB", "Spark") == named
