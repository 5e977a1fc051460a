"""Structured plans: reasons and records on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tabquest.plans.structured import PLAN_SCHEMA, check_plans, run_plans
from tabquest.sources.tables import catalog_of


@pytest.fixture(scope="module")
def goods(spark):
    rows = [(i, f"it's \\ {i % 4}" if i % 6 else None, i * 1.5, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, `full name` string, price double, sold boolean").withColumn("day", F.expr("date'2024-02-01' + id"))
    df.createOrReplaceTempView("goods")
    return df


def checked(spark, goods, plans):
    rows = [(i, None if p is None else json.dumps(p)) for i, p in enumerate(plans)]
    df = spark.createDataFrame(rows, "plan_id int, text string").select("plan_id", F.from_json("text", PLAN_SCHEMA).alias("plan"))
    return check_plans(df, catalog_of(spark, {"goods": goods}))


def records(spark, goods, plans, limit=100):
    found = {}
    for r in run_plans(spark, checked(spark, goods, plans), limit).orderBy("plan_id", "position").collect():
        found.setdefault(r["plan_id"], []).append(json.loads(r["record"]))
    return [found.get(i, []) for i in range(len(plans))]


def plan(mode="filtered", filters=(), **more):
    named = [dict(zip(("column", "op", "values"), f)) for f in filters]
    return {"dataset": "GOODS", "mode": mode, "filters": named, **more}


def test_filters_find_the_rows_they_name(spark, goods):
    cases = [
        (("full name", "=", ["it's \\ 2"]), lambda r: r["full name"] == "it's \\ 2"),
        (("full name", "is null", []), lambda r: r["full name"] is None),
        (("full name", "IS NOT NULL", None), lambda r: r["full name"] is not None),
        (("full name", "like", ["it's%3"]), lambda r: r["full name"] and r["full name"].endswith("3")),
        (("id", "in", ["3", "4", "99"]), lambda r: r["id"] in (3, 4)),
        (("price", "between", ["3", "7.5"]), lambda r: 3 <= r["price"] <= 7.5),
        (("sold", "=", ["true"]), lambda r: r["sold"]),
        (("day", "<", ["2024-02-04"]), lambda r: str(r["day"]) < "2024-02-04"),
        (("id", "<>", ["0"]), lambda r: r["id"] != 0),
    ]
    plans = [plan(filters=[f], columns=["id"], order_by=[{"name": "id"}]) for f, _ in cases]
    rows = goods.collect()
    for (f, right), found in zip(cases, records(spark, goods, plans)):
        assert [r["id"] for r in found] == sorted(r["id"] for r in rows if right(r)), f


def test_groups_orders_and_limits(spark, goods):
    count = {"function": "count", "column": "*", "name": "n"}
    plans = [
        plan("aggregation", aggregation=[count, {"function": "avg", "column": "price", "name": "p"}], group_by=["sold"], order_by=[{"name": "sold", "descending": True}]),
        plan("aggregation", aggregation=[count], filters=[("id", "<", ["0"])]),
        plan("top_n", columns=["id"], order_by=[{"name": "price", "descending": True}], limit=2),
        plan("full", limit=1, order_by=[{"name": "id"}]),
    ]
    found = records(spark, goods, plans)
    assert found[0] == [{"sold": True, "n": 20, "p": 28.5}, {"sold": False, "n": 20, "p": 30.0}]
    assert found[1] == [{"n": 0}] and found[2] == [{"id": 39}, {"id": 38}]
    assert found[3] == [{"id": 0, "full name": None, "price": 0.0, "sold": True, "day": "2024-02-01"}]
    assert [len(r) for r in records(spark, goods, [plan("full")], limit=7)] == [7]


def test_wrong_plans_give_reasons_and_do_not_run(spark, goods):
    plans = [
        None, {}, plan("full", columns=["nope", None]), plan(filters=[("id", "=", ["x"])]), plan(filters=[("id", "=", None), (None, None, None)]),
        plan("aggregation", aggregation=[{"function": "count_distinct", "column": None, "name": ""}]), plan(filters=[("full name", "=", ["'; DROP TABLE goods"])]),
    ]
    problems = [r["problems"] for r in checked(spark, goods, plans).orderBy("plan_id").collect()]
    assert problems[:2] == [["no plan"], ["unknown dataset: null"]]
    assert problems[2] == ["unknown column: nope", "unknown column: null"]
    assert problems[3] == ["value of another type: id ="]
    assert problems[4] == ["wrong number of values: id =", "unknown column: null"]
    assert problems[5] == ["unknown column: null"] and problems[6] == []
    assert records(spark, goods, plans) == [[]] * len(plans)
    assert records(spark, goods, []) == []


def test_plans_of_equal_shape_share_a_pass(spark, goods):
    plans = [plan(filters=[("id", ">", [str(k)])], columns=["id"], order_by=[{"name": "id"}], limit=1) for k in range(120)]
    assert records(spark, goods, plans) == [[{"id": k + 1}] if k < 39 else [] for k in range(120)]
