"""Audit of SQL texts derived from the parts table, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions.sqltext import strip_quoted_content
from tabquest.operators.audit import audit, guarded_sql, sanity_problem, violation_rows
from tabquest.operators.lookups import sql_input
from tabquest.operators.single_table import result_records, result_summary
from tabquest.plans.validate import validation_report
from tabquest.registry.common import given_manifest, quoted, registrar, table
from tabquest.session import configure, work_dir
from tabquest.sources.metadata import read_payloads
from tabquest.streaming.audit import start_audit_stream

QUERIES, ORACLES = {}, {}


register = registrar(QUERIES, ORACLES)


# One SQL text per part; the same expression is read by both engines.
_TEXTS = (
    "'SELECT p_name FROM part WHERE p_size = ' || p_size",
    "'select \"p_name\" from \"part\" where \"p_brand\" = ''' || p_brand || ''';'",
    "'SELECT * FROM part; DROP TABLE part_' || p_partkey",
    "'WITH t AS (SELECT ' || p_size || ') SELECT * FROM t'",
    "'SELECT p_name FROM part JOIN orders ON p_partkey = ' || p_partkey",
    "'SELECT a FROM part, orders WHERE a = ''' || p_name || ''''",
    "'SELECT replace(p_name, ''a'', ''b'') FROM part WHERE k = ' || p_partkey",
    "'SELECT EXTRACT(year FROM d) FROM part GROUP BY ' || p_name",
    "'SELECT ' || p_size || ' -- ' || p_name",
    "'SELECT ''it''''s -- fine; drop'' FROM part WHERE p_name = ''' || p_name || ''''",
    "''",
    "'   ;; '",
    "'SELECT p_name FROM orders WHERE k = ' || p_partkey",
    "'SELECT count(*) FROM part WHERE p_size > ' || p_size || ';;'",
    "'SELECT \"update\" FROM part WHERE k = ' || p_partkey",
    "'SELECT updated FROM part WHERE created = ' || p_size",
    "'INSERT INTO part VALUES (' || p_partkey || ')'",
    "'SELECT a FROM (SELECT b FROM part WHERE k = ' || p_partkey || ') GROUP BY a, b'",
    "'SELECT a FROM part ORDER BY a, b LIMIT ' || p_size",
    "'SELECT /* ' || p_name || ' */ a FROM part'",
    "'SELECT a FROM part WHERE n = ''unterminated; ' || p_name",
    "'SELECT \"a;b\" FROM part; ''' || p_name || ''''",
    "'  ' || chr(10) || ' select A from PART ' || chr(10) || ' where x = ' || p_size || chr(10) || ' ; '",
    "'SELECT a FROM part WINDOW w AS (PARTITION BY ' || p_type || ', b)'",
    "'Select \"x\" From \"Part\" HAVING merge > 1 AND call(truncate) = ' || p_size",
)
_TEXT_CASE = "CASE p_partkey % 25 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS)) + " END"
_EXPECTED_CASE = "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'PART' WHEN 2 THEN '' ELSE 'part' END"


def sql_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"),
        F.expr(_TEXT_CASE).alias("sql"),
        F.expr(_EXPECTED_CASE).alias("expected_table"),
    )


_KEYWORD_ROWS = ", ".join(f"({i}, {quoted(k)})" for i, k in enumerate(fv.FORBIDDEN_KEYWORDS))
_RULES_SQL = rf"""texts AS (SELECT p_partkey AS query_id, {_TEXT_CASE} AS sql, {_EXPECTED_CASE} AS expected FROM part),
clean AS (SELECT *, regexp_replace(sql, '^\s+|\s+$', '', 'g') AS stripped FROM texts),
norm AS (SELECT *, regexp_replace(regexp_replace(stripped, ';+$', ''), '\s+$', '') AS normalized_sql FROM clean),
plain AS (SELECT *, lower(regexp_replace(normalized_sql, '''(''''|[^''])*''', '''''', 'g')) AS p FROM norm),
tabled AS (SELECT *, [trim(t, '"') FOR t IN regexp_extract_all(p, '\bfrom\s+("[^"]+"|[a-zA-Z_][a-zA-Z0-9_]*)', 1)] AS tables,
  regexp_extract(p, '(?s)\bfrom\b(.*?)(\bwhere\b|\bgroup\s+by\b|\border\s+by\b|\blimit\b|\bhaving\b|$)', 1) AS clause FROM plain),
keywords(k, word) AS (VALUES {_KEYWORD_ROWS}),
found AS (
  SELECT query_id, 0 AS rule, {quoted(fv.MSG_EMPTY)} AS violation FROM tabled WHERE normalized_sql = ''
  UNION ALL SELECT query_id, 1, {quoted(fv.MSG_COMMENTS)} FROM tabled WHERE contains(p, '--') OR contains(p, '/*') OR contains(p, '*/')
  UNION ALL SELECT query_id, 2, {quoted(fv.MSG_MULTIPLE)} FROM tabled
    WHERE regexp_matches(regexp_replace(stripped, '''[^'']*(''|$)|"[^"]*("|$)', 'q', 'g'), ';\s*\S')
  UNION ALL SELECT query_id, 3, {quoted(fv.MSG_NOT_SELECT)} FROM tabled WHERE NOT starts_with(p, 'select')
  UNION ALL SELECT query_id, 10 + k, {quoted(fv.MSG_KEYWORD)} || word FROM tabled, keywords WHERE regexp_matches(p, '\b' || word || '\b')
  UNION ALL SELECT query_id, 40, {quoted(fv.MSG_JOIN)} FROM tabled WHERE regexp_matches(p, '\bjoin\b')
  UNION ALL SELECT query_id, 41, {quoted(fv.MSG_COMMA_FROM)} FROM tabled WHERE contains(clause, ',')
  UNION ALL SELECT query_id, 42, {quoted(fv.MSG_ONE_TABLE)} FROM tabled WHERE len(tables) <> 1
  UNION ALL SELECT query_id, 43, 'Query references unexpected table ''' || tables[1] || ''', expected ''' || expected || '''.'
    FROM tabled WHERE len(tables) = 1 AND expected <> '' AND tables[1] <> lower(expected))"""
_AUDIT_SQL = f"""WITH {_RULES_SQL}
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rule) - 1 AS INTEGER) AS position, violation FROM found"""


@register("sql_audit", _AUDIT_SQL)
def sql_audit(spark, sf_dir):
    return violation_rows(audit(sql_texts(spark, sf_dir)), "query_id")


@register(
    "sql_audit_verdicts",
    f"""WITH {_RULES_SQL}, counts AS (SELECT query_id, count(*) AS n FROM found GROUP BY 1)
        SELECT query_id, normalized_sql, coalesce(n, 0) AS violation_count, n IS NULL AS is_valid,
               array_to_string(tables, '|') AS detected_tables, p AS unquoted_sql
        FROM tabled LEFT JOIN counts USING (query_id)""",
)
def sql_audit_verdicts(spark, sf_dir):
    return audit(sql_texts(spark, sf_dir)).select(
        "query_id",
        "normalized_sql",
        F.size("violations").cast("bigint").alias("violation_count"),
        "is_valid",
        F.array_join("detected_tables", "|").alias("detected_tables"),
        F.lower(strip_quoted_content(F.col("normalized_sql"))).alias("unquoted_sql"),
    )


@register(
    "sql_sanity",
    f"""SELECT query_id, CASE WHEN NOT starts_with(s, 'select') THEN {quoted(fv.MSG_SANITY_SELECT)}
          WHEN NOT contains(s, 'orders') THEN {quoted(fv.MSG_SANITY_TABLE)} END AS problem
        FROM (SELECT p_partkey AS query_id, lower(regexp_replace({_TEXT_CASE}, '^\\s+|\\s+$', '', 'g')) AS s FROM part)""",
)
def sql_sanity(spark, sf_dir):
    return sql_texts(spark, sf_dir).select("query_id", sanity_problem(F.col("sql"), F.lit("Orders")).alias("problem"))


_GUARDED = 'SELECT "l_orderkey", "l_linenumber", "l_quantity" FROM "{0}" WHERE "l_quantity" >= 45 ORDER BY "l_quantity" DESC, "l_orderkey", "l_linenumber", "l_partkey"'


@register(
    "guarded_query",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45
       ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20""",
)
def guarded_query(spark, sf_dir):
    """An accepted query with quoted identifiers over the whole table, capped as the feature demands."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("guarded_lineitem")
    return guarded_sql(spark, _GUARDED.format("guarded_lineitem") + " ;", "guarded_lineitem")


@register(
    "result_export",
    """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","since":"2024-01-0' || (1 + c_nationkey % 9) || '"}' AS record
       FROM customer ORDER BY c_name, c_custkey LIMIT 20""",
)
def result_export(spark, sf_dir):
    people = table(spark, sf_dir, "customer").orderBy("c_name", "c_custkey").select(
        "c_custkey", "c_name", F.expr("date_add(date'2024-01-01', c_nationkey % 9)").alias("since")
    )
    return result_records(people)


@register(
    "result_summary",
    """WITH found AS (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_name, c_custkey LIMIT 21)
       SELECT 'c_custkey,c_name' AS columns, least(count(*), 20) AS row_count_returned, CAST(20 AS BIGINT) AS limit_applied,
         count(*) > 20 AS is_truncated, min_by('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}', c_name) AS first_row
       FROM found""",
)
def summary_of_result(spark, sf_dir):
    """A capped result with what was returned and whether there is more, from one run."""
    people = table(spark, sf_dir, "customer").filter("c_acctbal > 0").orderBy("c_name", "c_custkey")
    summary = result_summary(people.select("c_custkey", "c_name"))
    return summary.select(
        F.array_join("columns", ",").alias("columns"), "row_count_returned", "limit_applied", "is_truncated",
        F.get("rows", F.lit(0)).alias("first_row"),
    )


@register(
    "sql_inputs",
    f"""SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN 'query ' || p_name
               WHEN p_partkey % 3 = 1 THEN 'file ' || p_name
               ELSE nullif(regexp_replace({_TEXT_CASE}, '^\\s+|\\s+$', '', 'g'), '') END AS sql FROM part""",
)
def sql_inputs(spark, sf_dir):
    """Which SQL is looked at; the generated ones are read from saved payload files."""
    folder = work_dir(configure(spark), "payloads")
    part = table(spark, sf_dir, "part")
    payload = part.select(
        F.col("p_partkey").cast("string").alias("question"),
        F.struct(F.expr(_TEXT_CASE).alias("sql")).alias("generated_query"),
    )
    payload.write.json(folder)
    saved = read_payloads(spark, folder, one_per_file=False)
    asked = part.select(
        F.col("p_partkey").alias("query_id"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN '  query ' || p_name || ' ' WHEN 1 THEN '' END").alias("query"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'unused' WHEN 1 THEN ' file ' || p_name || chr(10) END").alias("file_text"),
    )
    generated = saved.select(F.col("question").cast("bigint").alias("query_id"), F.col("generated_query.sql").alias("generated_sql"))
    chosen = sql_input(F.col("query"), F.col("file_text"), F.col("generated_sql"))
    return asked.join(generated, "query_id").select("query_id", F.nullif(chosen, F.lit("")).alias("sql"))


@register("audit_stream", _AUDIT_SQL)
def audit_stream(spark, sf_dir):
    """The same texts arrive as files of a stream and are audited as they come."""
    spark = configure(spark)
    folder = work_dir(spark, "audit")
    sql_texts(spark, sf_dir).write.json(f"{folder}/in")
    arriving = spark.readStream.schema("query_id long, sql string, expected_table string").json(f"{folder}/in")
    start_audit_stream(arriving, f"{folder}/out", f"{folder}/state").awaitTermination()
    return violation_rows(spark.read.parquet(f"{folder}/out"), "query_id")


# The table may be named by the payload, the generated query, the argument or, as a dataset, by the manifest.
_NAMED_CASE = "CASE p_partkey % 4 WHEN 1 THEN 'PART' WHEN 2 THEN '' WHEN 3 THEN 'part' END"


@register(
    "validation_report",
    f"""WITH {_RULES_SQL}, counts AS (SELECT query_id, string_agg(violation, '|' ORDER BY rule) AS violations FROM found GROUP BY 1)
        SELECT query_id AS input_id, normalized_sql, nullif(expected, '') AS expected_table, array_to_string(tables, '|') AS detected_tables,
               coalesce(violations, '') AS violations, violations IS NULL AS is_valid
        FROM tabled LEFT JOIN counts USING (query_id)""",
)
def validation_of_inputs(spark, sf_dir):
    """Inputs whose SQL and table come from different places, validated together."""
    part = table(spark, sf_dir, "part")
    sql_at = {f"{name}": f"CASE WHEN p_partkey % 3 = {i} THEN {_TEXT_CASE} END" for i, name in enumerate(("query", "file_text", "generated_sql"))}
    inputs = part.select(
        F.col("p_partkey").alias("input_id"),
        *[F.expr(text).alias(name) for name, text in sql_at.items()],
        *[F.expr(f"CASE WHEN p_partkey % 5 = {i} THEN {_NAMED_CASE} END").alias(n) for i, n in enumerate(("payload_table", "generated_table"))],
        F.expr(f"CASE WHEN p_partkey % 5 >= 2 THEN {_NAMED_CASE} END").alias("table_name"),
    )
    report = validation_report(inputs, given_manifest(spark))
    joined = {c: F.array_join(c, "|") for c in ("detected_tables", "violations")}
    return report.withColumns(joined)
