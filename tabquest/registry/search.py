"""Registered column search and refresh plan, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabquest.operators import column_search
from tabquest.plans import refresh
from tabquest.registry.common import (
    CATALOG_SQL,
    COLUMNS,
    DESCRIPTIONS,
    DOMAINS,
    NOTES,
    QUESTIONS_SQL,
    TABLES,
    given_catalog,
    given_tables,
    questions,
    quoted,
    registrar,
    table,
    tokens_sql,
)
from tabquest.session import materialise, small_table, work_dir

QUERIES, ORACLES = {}, {}
register = registrar(QUERIES, ORACLES)

# Text columns whose values are names or codes; whole texts and pages are not values to search columns by.
_VALUE_COLUMNS = {
    t: [c for c, kind in COLUMNS[t] if kind == "string" and c not in ("text", "html", "url", "props", "c_name", "s_name")] for t in TABLES
}
_DESCRIBED = [(t, " ".join(filter(None, (t, DOMAINS.get(t), DESCRIPTIONS.get(t), NOTES.get(t))))) for t in TABLES]
_VALUES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, row_number() OVER () AS row_id, {c} AS value FROM {t} WHERE {c} IS NOT NULL"
    for t in TABLES
    for c in _VALUE_COLUMNS[t]
)


@register(
    "column_search",
    f"""WITH {QUESTIONS_SQL}, {CATALOG_SQL},
described(table_name, description) AS (VALUES {", ".join(f"('{t}', {quoted(d)})" for t, d in _DESCRIBED)}),
cells AS ({_VALUES_SQL}),
{tokens_sql('cell_terms', 'cells', 'table_name, column_name, row_id', 'value')},
{tokens_sql('name_terms', 'catalog', 'table_name, column_name', "replace(column_name, '_', ' ')")},
{tokens_sql('dataset_terms', 'described', 'table_name', 'description')},
{tokens_sql('asked', 'questions', 'question_id', 'question')},
held AS (
  SELECT table_name, column_name, token, 0.5::DOUBLE + 0.5::DOUBLE * count(*) / any_value(total) AS share
  FROM cell_terms JOIN (SELECT table_name, column_name, count(*) AS total FROM cells GROUP BY 1, 2) USING (table_name, column_name)
  GROUP BY 1, 2, 3
  UNION ALL SELECT table_name, column_name, token, 2.0 FROM name_terms),
shares AS (
  SELECT 'column' AS kind, table_name, ordinal, column_name, token, sum(share) AS share
  FROM held JOIN catalog USING (table_name, column_name) GROUP BY ALL
  UNION ALL SELECT 'dataset', table_name, 0, '', token, 1.0 FROM dataset_terms),
sizes AS (SELECT 'column' AS kind, count(*) AS size FROM catalog UNION ALL SELECT 'dataset', count(*) FROM described),
weights AS (
  SELECT s.*, share * ln(1 + (size - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS weight
  FROM shares s JOIN (SELECT kind, token, count(*) AS df FROM shares GROUP BY 1, 2) USING (kind, token) JOIN sizes USING (kind)),
hits AS (
  SELECT question_id, kind, table_name, ordinal, column_name, round(sum(weight), 6) AS weight
  FROM asked JOIN weights USING (token) GROUP BY ALL),
places AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, kind ORDER BY weight DESC, table_name, ordinal) AS place FROM hits QUALIFY place <= 50),
fused AS (
  SELECT c.question_id, c.table_name, c.ordinal, c.column_name, c.place AS column_rank, d.place AS dataset_rank,
         round(1::DOUBLE / (60 + c.place) + coalesce(1::DOUBLE / (60 + d.place), 0), 9) AS score
  FROM places c LEFT JOIN places d ON d.kind = 'dataset' AND d.question_id = c.question_id AND d.table_name = c.table_name
  WHERE c.kind = 'column')
SELECT question_id, table_name, column_name, CAST(column_rank AS INTEGER) AS column_rank, CAST(dataset_rank AS INTEGER) AS dataset_rank, score,
       CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, table_name, ordinal) AS INTEGER) AS rank
FROM fused QUALIFY rank <= 10""",
)
def columns_for_questions(spark, sf_dir):
    """The ten best columns for every question, by names, values and datasets."""
    values = materialise(column_search.value_terms(given_tables(spark, sf_dir), _VALUE_COLUMNS), "value-terms")
    descriptions = small_table(spark, _DESCRIBED, "table_name string, description string")
    path = work_dir(spark, "column-index")
    column_search.write_index(column_search.postings(given_catalog(spark, sf_dir), values, descriptions), path)
    return column_search.search(questions(spark, sf_dir), path)


@register(
    "refresh_plan",
    """WITH before AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1),
now AS (SELECT c_nationkey AS k, count(*) AS n, bool_or(k % 5 = 1 AND c_acctbal < 0) AS changed FROM customer WHERE c_nationkey <> 7 GROUP BY 1)
SELECT 'c_nationkey=' || coalesce(b.k, a.k) AS file_path, b.n AS lines_before, a.n AS lines_after,
       CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'removed' WHEN changed THEN 'changed' ELSE 'unchanged' END AS status
FROM before b FULL JOIN now a ON a.k = b.k""",
)
def refresh_by_content(spark, sf_dir):
    """Two versions of the customers, one CSV dataset per nation: what a refresh has to profile again."""
    customers = table(spark, sf_dir, "customer")
    mended = F.when((F.col("c_nationkey") % 5 == 1) & (F.col("c_acctbal") < 0), 0.0).otherwise(F.col("c_acctbal"))
    digests = []
    for rows in (customers.where("c_nationkey <> 3"), customers.where("c_nationkey <> 7").withColumn("c_acctbal", mended)):
        path = work_dir(spark, "datasets")
        rows.write.partitionBy("c_nationkey").csv(path)
        digests.append(refresh.content_digests(refresh.folder_lines(spark, path)))
    return refresh.refresh_plan(digests[1], digests[0]).drop("digest")
