"""Many queries from few scans, against each query run by itself."""

import json

import pytest
from pyspark.sql import functions as F

from tabquest.operators import shared_scan
from tabquest.operators.audit import audit, quoted_identifiers
from tabquest.operators.single_table import result_records
from tabquest.plans.answer import run_accepted


@pytest.fixture(scope="module")
def things(spark):
    rows = [(i, f"n{i % 7}", f"it's {i % 3}" if i % 5 else None, i % 11 / 2, i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, 'id int, name string, "kind of" string, x double, flag boolean'.replace('"kind of"', "`kind of`"))
    df = df.withColumn("day", F.expr("date'2024-01-01' + id % 10")).repartition(3)
    df.createOrReplaceTempView("things")
    return df


PLAIN = [
    "SELECT count(*) FROM things",
    "SELECT count(*) AS n, sum(x) AS s, count(DISTINCT name) AS d FROM things WHERE id > 20",
    "SELECT max(x) - min(x) AS width, avg(x) / count(*) FROM things WHERE name = 'n3' OR flag",
    "SELECT sum(x) AS s FROM things WHERE id < 0",
    "SELECT name, count(*) AS n FROM things GROUP BY name ORDER BY n DESC, name",
    "SELECT name, count(*) AS n FROM things WHERE flag GROUP BY name ORDER BY n DESC, name",
    "SELECT name, count(*) AS n FROM things WHERE id < 5 GROUP BY 1 HAVING count(*) > 0 ORDER BY 2 DESC, 1 LIMIT 3",
    'SELECT "kind of", max(day) AS last FROM things WHERE "kind of" IS NOT NULL GROUP BY "kind of" ORDER BY "kind of"',
    "SELECT id, name, day FROM things WHERE \"kind of\" = 'it''s 2' ORDER BY id LIMIT 4",
    "SELECT id, \"kind of\" FROM things ORDER BY \"kind of\" NULLS LAST, id DESC LIMIT 9",
    "SELECT * FROM things WHERE id = 17",
    "select upper(name) as \"big name\", id from things where id in (3, 4, 5) order by id",
    "SELECT 'a, b from c where d' AS t, id FROM things WHERE name <> ' group by ' ORDER BY id LIMIT 2",
]
ALONE = [
    "SELECT DISTINCT name FROM things ORDER BY name",
    "SELECT id, row_number() OVER (ORDER BY id) AS r FROM things ORDER BY id LIMIT 3",
    "SELECT collect_set(flag) AS f FROM things WHERE id < 1",
]


def records(spark, sql):
    with quoted_identifiers(spark):
        return [json.loads(r["record"]) for r in result_records(spark.sql(sql), 50).collect()]


def accepted(spark, texts):
    return audit(spark.createDataFrame(list(enumerate(texts)), "question_id int, sql string").withColumn("expected_table", F.lit("things")))


def test_answers_equal_those_of_each_query(spark, things):
    texts = PLAIN + ALONE
    results, outcomes = run_accepted(spark, accepted(spark, texts), limit=50)
    found = {}
    for r in results.orderBy("question_id", "position").collect():
        found.setdefault(r["question_id"], []).append(json.loads(r["record"]))
    for i, sql in enumerate(texts):
        assert found.get(i, []) == records(spark, sql), sql
    rows = outcomes.collect()
    assert len(rows) == len(texts) and all(r["engine_error"] is None and r["run_error"] is None for r in rows)


@pytest.mark.parametrize("sql", PLAIN)
def test_plain_queries_have_clauses(spark, things, sql):
    with quoted_identifiers(spark):
        query = shared_scan.Query("q", shared_scan.clauses_of(sql), spark.sql(sql).schema)
        assert shared_scan.compiled(spark, query)


@pytest.mark.parametrize("sql", ALONE[:2] + ["SELECT a FROM (SELECT b FROM t)", "SELECT a FROM t UNION SELECT a FROM t", "SELECT a FROM t, u", "SELECT a FROM t WHERE x = (SELECT 1)", "SELECT"])
def test_other_texts_have_none(sql):
    assert shared_scan.clauses_of(sql) is None


def test_aggregates_within_expressions_are_filtered():
    assert shared_scan.with_filter("sum(f(a)) / count(*) + 'max('", "x > 1") == "sum(f(a)) FILTER (WHERE x > 1) / count(*) FILTER (WHERE x > 1) + 'max('"


def test_a_thousand_texts_take_few_jobs(spark, things):
    texts = [f"SELECT count(*) AS n, max(id) AS top FROM things WHERE id % {k} = 0 AND x >= 0" for k in range(1, 401)]
    texts += [f"SELECT name, count(*) AS n FROM things WHERE id > {k} GROUP BY name ORDER BY name" for k in range(300)]
    texts += [f"SELECT id, name FROM things WHERE id >= {k} ORDER BY id LIMIT 3" for k in range(300)]
    group = "shared-scan-test"
    rows = accepted(spark, texts)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    results, outcomes = run_accepted(spark, rows, limit=20, at_once=1)
    found = results.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    by_id = {}
    for r in found:
        by_id.setdefault(r["question_id"], []).append((r["position"], json.loads(r["record"])))
    assert all(by_id[k - 1][0][1] == {"n": 1 + 299 // k, "top": 299 // k * k} for k in range(1, 401))
    assert [v["n"] for _, v in sorted(by_id[400 + 290])] == [sum(i % 7 == j for i in range(291, 300)) for j in range(7)]
    assert all([v["id"] for _, v in sorted(by_id.get(700 + k, []))] == list(range(k, min(k + 3, 300))) for k in range(300))
    assert len([j for j in tracker.getJobIdsForGroup(group)]) < 40
    assert outcomes.where("row_count_returned IS NULL").count() == 0


def test_a_failing_query_does_not_take_others_with_it(spark, things):
    texts = ["SELECT count(*) AS n FROM things", "SELECT 1 / (id - id) AS z FROM things WHERE id = 1 ORDER BY id", "SELECT id FROM things WHERE id = 3 ORDER BY id"]
    results, outcomes = run_accepted(spark, accepted(spark, texts))
    errors = {r["question_id"]: r["run_error"] for r in outcomes.collect()}
    assert errors[0] is None and errors[2] is None and "DIVIDE_BY_ZERO" in errors[1]
    assert {r["question_id"]: json.loads(r["record"]) for r in results.collect()} == {0: {"n": 300}, 2: {"id": 3}}


def test_the_plan_scans_once_and_limits_before_the_shuffle(spark, things):
    with quoted_identifiers(spark):
        queries = []
        for k in range(5):
            sql = f"SELECT id FROM things WHERE id > {k} ORDER BY id"
            queries.append(shared_scan.Query(str(k), shared_scan.clauses_of(sql), spark.sql(sql).schema))
        ((_, df),) = shared_scan.passes(spark, queries, 10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Scan ExistingRDD") <= 1
