"""Allowed joins: paths against a walk in Python, rows against nested loops, the Bloom filter in the plan."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tabquest.operators import relationships

REQUESTS = "request_id int, start_table string, end_table string"


def plain_path(edges, start, end):
    """The first of the shortest paths, by breadth: paths of one length are tried in order."""
    best, queue = {start: ()}, deque([start])
    while queue:
        level = list(queue)
        queue.clear()
        found = {}
        for at in level:
            for e in edges:
                if e[0] == at and e[2] not in best:
                    path = best[at] + (e,)
                    found[e[2]] = min(found.get(e[2], path), path)
        best.update(found)
        queue.extend(found)
    return best.get(end)


def test_paths_are_the_shortest(spark):
    rng = random.Random(4)
    given = sorted({(f"t{rng.randrange(14)}", "k", f"t{rng.randrange(14)}", rng.choice("xy")) for _ in range(18)})
    edges = {e for a, b, c, d in given if a != c for e in ((a, b, c, d), (c, d, a, b))}
    names = [f"t{i}" for i in range(15)]
    asked = [(i * 15 + j, a, b) for i, a in enumerate(names) for j, b in enumerate(names)]
    found = relationships.join_paths(spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(given, relationships.RELATIONSHIP_SCHEMA), 14)
    rows = {r["request_id"]: r for r in found.collect()}
    for i, a, b in asked:
        path = plain_path(edges, a, b)
        assert rows[i]["path"] == (None if path is None else [tuple(s) for s in path]) or list(map(tuple, rows[i]["path"])) == list(path)
        assert (rows[i]["problem"] is None) == (path is not None)


def test_odd_requests(spark):
    none = spark.createDataFrame([], relationships.RELATIONSHIP_SCHEMA)
    asked = spark.createDataFrame([(1, "a", "a"), (2, None, "a"), (3, "a", None), (4, "a", "b"), (4, "a", "b")], REQUESTS)
    rows = sorted((r["request_id"], r["path"], r["problem"]) for r in relationships.join_paths(asked, none).collect())
    assert rows[0] == (1, [], None) and len(rows) == 5
    assert [r[2] for r in rows[1:]] == [f"no allowed relationship leads from {a} to {b}" for a, b in (("null", "a"), ("a", "null"), ("a", "b"), ("a", "b"))]
    assert relationships.join_paths(asked.where("request_id < 0"), none).count() == 0


@pytest.fixture(scope="module")
def shop(spark):
    lines = spark.createDataFrame([(i, i % 50, i % 7) for i in range(500)] + [(900, None, 1)], "id int, order_id int, q int")
    orders = spark.createDataFrame([(i, i % 9, "x") for i in range(45)], "id int, client int, note string")
    clients = spark.createDataFrame([(i, "A" if i < 2 else "B") for i in range(9)], "id int, area string")
    allowed = spark.createDataFrame([("lines", "order_id", "orders", "id"), ("orders", "client", "clients", "id")], relationships.RELATIONSHIP_SCHEMA)
    return {"lines": lines, "orders": orders, "clients": clients}, allowed


def test_joined_rows(spark, shop):
    tables, allowed = shop
    found = relationships.joined_answer(
        spark, tables, allowed, "lines", "clients", {"area": "clients.area"}, {"n": F.count("*"), "q": F.sum("`lines.q`")}, {"clients": "id <> 1"}
    )
    expected = {}
    for line in tables["lines"].collect():
        for order in tables["orders"].collect():
            if line["order_id"] == order["id"] and order["client"] != 1:
                area = "A" if order["client"] < 2 else "B"
                n, q = expected.get(area, (0, 0))
                expected[area] = (n + 1, q + line["q"])
    assert {r["area"]: (r["n"], r["q"]) for r in found.collect()} == expected


def test_only_allowed_joins(spark, shop):
    tables, allowed = shop
    with pytest.raises(ValueError, match="no allowed relationship leads from lines to clients"):
        relationships.joined_answer(spark, tables, allowed.limit(1), "lines", "clients", {}, {"n": F.count("*")})
    with pytest.raises(ValueError, match="not on the path"):
        relationships.join_along(tables, "lines", [], {"clients": "id = 1"})


def test_a_bloom_filter_reaches_the_large_scan(spark, shop, tmp_path):
    tables, _ = shop
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    stored = {name: spark.read.parquet(str(tmp_path / name)) for name in tables}
    path = [dict(left_table="lines", left_column="order_id", right_table="orders", right_column="id")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with relationships.bloom_filters(spark):
            plan = relationships.join_along(stored, "lines", path, {"orders": "client = 3"})._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "might_contain" in plan and "bloom_filter_agg" in plan
