"""Registered queries over tables of questions: shared scans, structured plans, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabquest.operators import relationships
from tabquest.operators.audit import audit
from tabquest.operators.evaluation import POISSON_STEPS, evaluate
from tabquest.plans.answer import run_accepted
from tabquest.plans.structured import PLAN_SCHEMA, check_plans, run_plans
from tabquest.registry.common import TABLES, given_catalog, given_tables, registrar, table
from tabquest.session import small_table
from tabquest.sources.tables import catalog_of

QUERIES, ORACLES = {}, {}
register = registrar(QUERIES, ORACLES)

# Per size of part: a total, groups, first rows, and for some sizes a query that runs by itself.
_TEXTS = """array(
  'SELECT count(*) AS n, min(p_name) AS low, sum(p_size) AS total FROM answer_part WHERE p_size = ' || s || ' AND p_retailprice >= 950',
  'SELECT p_brand, count(*) AS n FROM "answer_part" WHERE p_size > ' || s || ' GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5',
  'SELECT p_partkey, p_name FROM answer_part WHERE p_size = ' || s || ' ORDER BY p_name DESC, p_partkey LIMIT 7;',
  CASE WHEN s % 25 = 0 THEN 'SELECT DISTINCT p_type FROM answer_part WHERE p_size = ' || s || ' ORDER BY p_type LIMIT 3' END)"""


@register(
    "shared_scan_answers",
    """WITH sizes AS (SELECT DISTINCT p_size AS s FROM part WHERE p_size IS NOT NULL),
found AS (
  SELECT s * 10 AS question_id, 1 AS position, '{"n":' || count(p_partkey) || ',"low":' || coalesce('"' || min(p_name) || '"', 'null')
         || ',"total":' || coalesce(CAST(sum(p_size) AS BIGINT)::VARCHAR, 'null') || '}' AS record
  FROM sizes LEFT JOIN part ON p_size = s AND p_retailprice >= 950 GROUP BY s
  UNION ALL
  SELECT s * 10 + 1, row_number() OVER (PARTITION BY s ORDER BY n DESC, p_brand), '{"p_brand":"' || p_brand || '","n":' || n || '}'
  FROM (SELECT s, p_brand, count(*) AS n FROM sizes JOIN part ON p_size > s GROUP BY 1, 2)
  UNION ALL
  SELECT s * 10 + 2, row_number() OVER (PARTITION BY s ORDER BY p_name DESC, p_partkey), '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}'
  FROM sizes JOIN part ON p_size = s
  UNION ALL
  SELECT s * 10 + 3, row_number() OVER (PARTITION BY s ORDER BY p_type), '{"p_type":"' || p_type || '"}'
  FROM (SELECT DISTINCT s, p_type FROM sizes JOIN part ON p_size = s WHERE s % 25 = 0))
SELECT question_id, position, record FROM found WHERE position <= CASE question_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 3 END""",
)
def shared_scan_answers(spark, sf_dir):
    """Records of all texts; those of one shape come from one pass over the table."""
    part = table(spark, sf_dir, "part")
    part.createOrReplaceTempView("answer_part")
    sizes = part.where("p_size IS NOT NULL").select(F.col("p_size").alias("s")).distinct()
    texts = sizes.select("s", F.posexplode(F.expr(_TEXTS)).alias("k", "sql")).where("sql IS NOT NULL")
    asked = texts.select((F.col("s") * 10 + F.col("k")).alias("question_id"), "sql", F.lit("answer_part").alias("expected_table"))
    results, _ = run_accepted(spark, audit(asked))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("position"))
    return results.select("question_id", place.alias("position"), "record")


# Plans as JSON, one per part, and the reasons against them.
_PLANS = (
    ("""'{"dataset":"part","mode":"full"}'""", "''"),
    ("""'{"dataset":"Orders","mode":"filtered","columns":["o_orderkey"],"filters":[{"column":"o_totalprice","op":">","values":["' || p_size || '"]}]}'""", "''"),
    ("""'{"dataset":"' || p_name || '","mode":"full"}'""", "'unknown dataset: ' || p_name"),
    ("""'{"dataset":"part","mode":"' || p_brand || '"}'""", "'unknown mode: ' || p_brand"),
    ("""'{"dataset":"part","mode":"filtered","columns":["p_name","' || p_type || '"]}'""", "'unknown column: ' || p_type || '|filtered without a filter'"),
    ("""'{"dataset":"part","mode":"filtered","filters":[{"column":"p_size","op":"=","values":["' || p_name || '"]},{"column":"p_size","op":"between","values":["1"]}]}'""",
     "'value of another type: p_size =|wrong number of values: p_size between'"),
    ("""'{"dataset":"part","mode":"filtered","filters":[{"column":"p_name","op":"near","values":["a"]},{"column":"p_size","op":"like","values":["1"]}]}'""",
     "'unknown operator: p_name near|not a text column: p_size like'"),
    ("""'{"dataset":"part","mode":"aggregation","aggregation":[{"function":"sum","column":"p_brand","name":"s"},{"function":"mode","column":"p_size","name":"S"}],"order_by":[{"name":"t"}]}'""",
     "'not a numeric column: p_brand|unknown function: mode|two results of one name|cannot sort by: t'"),
    ("""'{"dataset":"lineitem","mode":"aggregation","aggregation":[{"function":"count","name":"n"}],"group_by":["l_returnflag"],"order_by":[{"name":"n","descending":true}],"limit":' || p_size || '}'""", "''"),
    ("""'{"dataset":"part","mode":"top_n","columns":["p_name"],"group_by":["p_brand"],"limit":0}'""",
     "'limit below one|groups without an aggregate|top_n without an order or a limit'"),
    ("NULL", "'no plan'"),
    ("""'{"dataset":"events","mode":"filtered","filters":[{"column":"ts","op":"<","values":["2024-02-30"]},{"column":"ts","op":"is null"},{"column":"value","op":"in","values":["1","x"]}]}'""",
     "'value of another type: ts <|value of another type: value in'"),
)
_PLAN_CASE = f"CASE p_partkey % {len(_PLANS)} " + " ".join(f"WHEN {i} THEN {p}" for i, (p, _) in enumerate(_PLANS)) + " END"
_REASON_CASE = f"CASE p_partkey % {len(_PLANS)} " + " ".join(f"WHEN {i} THEN {r}" for i, (_, r) in enumerate(_PLANS)) + " END"


@register("plan_checks", f"SELECT p_partkey AS plan_id, {_REASON_CASE} AS problems, {_REASON_CASE} = '' AS is_good FROM part")
def plan_checks(spark, sf_dir):
    """What is wrong with every plan, checked against the catalog of the given tables."""
    plans = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("plan_id"), F.from_json(F.expr(_PLAN_CASE), PLAN_SCHEMA).alias("plan")
    )
    checked = check_plans(plans, given_catalog(spark, sf_dir))
    return checked.select("plan_id", F.array_join("problems", "|").alias("problems"), (F.size("problems") == 0).alias("is_good"))


_RUN_PLANS = """array(
  '{"dataset":"PLAN_PART","mode":"top_n","columns":["p_partkey","p_name"],"filters":[{"column":"p_size","op":"=","values":["' || s || '"]}],
    "order_by":[{"name":"p_name","descending":true},{"name":"p_partkey"}],"limit":3}',
  '{"dataset":"plan_part","mode":"aggregation","aggregation":[{"function":"count","column":"*","name":"n"},{"function":"max","column":"p_partkey","name":"top"}],
    "filters":[{"column":"p_size","op":"between","values":["' || s || '","' || (s + 5) || '"]},{"column":"p_type","op":"like","values":["%S%"]}],
    "group_by":["p_brand"],"order_by":[{"name":"n","descending":true},{"name":"p_brand"}],"limit":4}',
  '{"dataset":"plan_part","mode":"aggregation","aggregation":[{"function":"count_distinct","column":"p_brand","name":"brands"}],
    "filters":[{"column":"p_size","op":"in","values":["' || s || '","' || (s * 2) || '"]}]}')"""


@register(
    "plan_results",
    """WITH sizes AS (SELECT DISTINCT p_size AS s FROM part WHERE p_size IS NOT NULL),
found AS (
  SELECT s * 10 AS plan_id, row_number() OVER (PARTITION BY s ORDER BY p_name DESC, p_partkey) AS position,
         '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}' AS record, 3 AS most FROM sizes JOIN part ON p_size = s
  UNION ALL
  SELECT s * 10 + 1, row_number() OVER (PARTITION BY s ORDER BY n DESC, p_brand), '{"p_brand":"' || p_brand || '","n":' || n || ',"top":' || top || '}', 4
  FROM (SELECT s, p_brand, count(*) AS n, max(p_partkey) AS top FROM sizes JOIN part ON p_size BETWEEN s AND s + 5 AND p_type LIKE '%S%' GROUP BY 1, 2)
  UNION ALL
  SELECT s * 10 + 2, 1, '{"brands":' || count(DISTINCT p_brand) || '}', 1 FROM sizes LEFT JOIN part ON p_size IN (s, s * 2) GROUP BY s)
SELECT plan_id, position, record FROM found WHERE position <= most""",
)
def plan_results(spark, sf_dir):
    """Records of plans of three shapes, one for each size of part."""
    part = table(spark, sf_dir, "part")
    part.createOrReplaceTempView("plan_part")
    sizes = part.where("p_size IS NOT NULL").select(F.col("p_size").alias("s")).distinct()
    plans = sizes.select("s", F.posexplode(F.expr(_RUN_PLANS)).alias("k", "text"))
    plans = plans.select((F.col("s") * 10 + F.col("k")).alias("plan_id"), F.from_json("text", PLAN_SCHEMA).alias("plan"))
    return run_plans(spark, check_plans(plans, catalog_of(spark, {"plan_part": part})))


_POISSON_SQL = " + ".join(f"CAST(u >= {step!r} AS INTEGER)" for step in POISSON_STEPS)


@register(
    "evaluation",
    f"""WITH runs AS (
  SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 < 8 THEN o_orderpriority END AS expected,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '5-LOW' END AS first, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '1-URGENT' END AS second,
         o_orderstatus AS status, o_totalprice > 20000 AS valid, o_totalprice < 250000 AS executed, o_orderkey % 1000 AS ms FROM orders),
hits AS (
  SELECT key, unnest(['selection_accuracy', 'top2_recall', 'mode_accuracy', 'validity_rate', 'success_rate', 'response_ms']) AS metric,
         unnest([CASE WHEN expected IS NOT NULL THEN CAST(first = expected AS DOUBLE) END,
                 CASE WHEN expected IS NOT NULL THEN CAST(expected IN (first, second) AS DOUBLE) END,
                 CAST(status = 'O' AS DOUBLE), CAST(valid AS DOUBLE), CASE WHEN valid THEN CAST(executed AS DOUBLE) END, CAST(ms AS DOUBLE)]) AS hit FROM runs),
uniform AS (
  SELECT metric, hit, b, CAST(('0x' || substr(md5(key || ':' || b), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM hits, range(0, 41) AS samples(b) WHERE hit IS NOT NULL),
means AS (
  SELECT metric, b, sum(w * hit) / sum(w) AS mean, sum(w) AS n
  FROM (SELECT *, CASE WHEN b = 0 THEN 1 ELSE {_POISSON_SQL} END AS w FROM uniform) GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean) AS place FROM means WHERE b > 0)
SELECT m.metric, CAST(m.n AS BIGINT) AS n, round(m.mean, 6) AS estimate, round(l.mean, 6) AS low, round(h.mean, 6) AS high
FROM means m JOIN placed l ON m.metric = l.metric AND l.place = 3 JOIN placed h ON m.metric = h.metric AND h.place = 38 WHERE m.b = 0""",
)
def evaluation(spark, sf_dir):
    """Metrics of runs derived from orders with 90 % intervals of 40 samples; the SQL draws the same weights."""
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.expr("CASE WHEN o_orderkey % 10 < 8 THEN o_orderpriority END").alias("expected_dataset"),
        F.expr("array(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '5-LOW' END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '1-URGENT' END)").alias("ranked"),
        F.lit("O").alias("expected_mode"),
        F.col("o_orderstatus").alias("query_mode"),
        F.expr("o_totalprice > 20000").alias("is_valid"),
        F.expr("o_totalprice < 250000").alias("executed"),
        F.expr("o_orderkey % 1000").alias("elapsed_ms"),
    )
    rounded = {c: F.round(c, 6) for c in ("estimate", "low", "high")}
    return evaluate(runs, samples=40, level=0.9).withColumns(rounded)


# Which columns of the given tables may be joined.
_RELATIONSHIPS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("documents", "doc_id", "labels", "doc_id"),
]
_EDGES_SQL = "edges(lt, lc, rt, rc) AS (VALUES " + ", ".join(
    f"('{a}', '{b}', '{c}', '{d}'), ('{c}', '{d}', '{a}', '{b}')" for a, b, c, d in _RELATIONSHIPS
) + ")"
_PAIR = [f"element_at(array({', '.join(repr(t) for t in TABLES)}), CAST({key} % {len(TABLES)} AS int) + 1)" for key in ("p_partkey", "p_size")]
_PAIR_SQL = [f"([{', '.join(repr(t) for t in TABLES)}])[{key} % {len(TABLES)} + 1]" for key in ("p_partkey", "p_size")]


@register(
    "join_paths",
    f"""WITH RECURSIVE {_EDGES_SQL},
walks(first, here, seen, path) AS (
  SELECT DISTINCT lt, lt, [lt], CAST([] AS VARCHAR[]) FROM edges
  UNION ALL
  SELECT first, rt, list_append(seen, rt), list_append(path, lt || '.' || lc || '=' || rt || '.' || rc)
  FROM walks JOIN edges ON here = lt WHERE NOT list_contains(seen, rt) AND len(path) < 8),
best AS (SELECT first, here, path FROM walks QUALIFY row_number() OVER (PARTITION BY first, here ORDER BY len(path), path) = 1),
asked AS (SELECT p_partkey AS request_id, {_PAIR_SQL[0]} AS s, {_PAIR_SQL[1]} AS e FROM part)
SELECT request_id, CASE WHEN s = e THEN '' ELSE array_to_string(path, '|') END AS path,
       CASE WHEN s <> e AND path IS NULL THEN 'no allowed relationship leads from ' || s || ' to ' || e END AS problem
FROM asked LEFT JOIN best ON s = first AND e = here""",
)
def paths_between_tables(spark, sf_dir):
    """The shortest allowed path between two tables for every part."""
    asked = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"), F.expr(_PAIR[0]).alias("start_table"), F.expr(_PAIR[1]).alias("end_table")
    )
    found = relationships.join_paths(asked, small_table(spark, _RELATIONSHIPS, relationships.RELATIONSHIP_SCHEMA))
    return found.select("request_id", relationships.path_text(F.col("path")).alias("path"), "problem")


@register(
    "joined_answers",
    """SELECT n_name AS nation, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(DISTINCT o_custkey) AS customers
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE n_regionkey IN (1, 2) AND c_acctbal > 0 GROUP BY 1""",
)
def joined_answers(spark, sf_dir):
    """Lines per nation of customers, over the path that the allowed relationships give."""
    allowed = [r for r in _RELATIONSHIPS if "supplier" not in r]
    return relationships.joined_answer(
        spark,
        given_tables(spark, sf_dir),
        small_table(spark, allowed, relationships.RELATIONSHIP_SCHEMA),
        "lineitem",
        "nation",
        group_by={"nation": "nation.n_name"},
        aggregates={
            "n_lines": F.count("*"),
            "quantity": F.sum("`lineitem.l_quantity`").cast("long"),
            "customers": F.countDistinct("`orders.o_custkey`"),
        },
        filters={"nation": "n_regionkey IN (1, 2)", "customer": "c_acctbal > 0"},
    )
