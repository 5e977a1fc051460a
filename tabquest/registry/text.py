"""Tokens, query modes and columns for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions.text import query_mode, tokenize
from tabquest.operators import columns as ops
from tabquest.plans.answer import inspect_tables, prepare_contexts, prepare_requests, table_payloads
from tabquest.plans.prompts import single_table_prompt
from tabquest.registry.common import (
    CATALOG_SQL,
    QUESTIONS_SQL,
    TABLES,
    file_path,
    given_catalog,
    quoted,
    questions,
    registrar,
    table,
    tokens_sql,
)
from tabquest.sources.manifest import manifest_from_rows

QUERIES, ORACLES = {}, {}


register = registrar(QUERIES, ORACLES)


@register(
    "tokenize_docs",
    f"WITH {tokens_sql('t', 'documents', 'doc_id', 'text')} SELECT doc_id, token FROM t",
)
def tokenize_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tokenize(F.col("text"))).alias("token"))


@register(
    "token_frequency",
    f"""WITH {tokens_sql('t', 'documents', 'doc_id, lang', 'text')}
        SELECT lang AS table_name, token, count(*) AS frequency FROM t GROUP BY 1, 2""",
)
def token_frequency(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("table_name"), F.explode(tokenize(F.col("text"))).alias("token")
    )
    return ops.token_frequency(tokens)


def _any_sql(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(p)})" for p in phrases) + ")"


def mode_sql(column: str) -> str:
    broad, aggregate = _any_sql(column, fv.BROAD_PROFILE_HINTS), _any_sql(column, fv.AGGREGATE_HINTS)
    return (
        f"CASE WHEN {broad} AND {aggregate} THEN 'broad_aggregate' WHEN {broad} THEN 'broad_profile' "
        f"WHEN {aggregate} THEN 'aggregate' ELSE 'focused_filter' END"
    )


@register(
    "query_modes",
    f"""WITH {QUESTIONS_SQL} SELECT 'question' AS kind, question_id AS id, 0 AS turn, {mode_sql('lower(question)')} AS mode FROM questions
        UNION ALL SELECT role, conv_id, CAST(turn AS INTEGER), {mode_sql('lower(text)')} FROM conversations""",
)
def query_modes(spark, sf_dir):
    asked = questions(spark, sf_dir).select(
        F.lit("question").alias("kind"),
        F.col("question_id").alias("id"),
        F.lit(0).alias("turn"),
        query_mode(F.col("question")).alias("mode"),
    )
    said = table(spark, sf_dir, "conversations").select(
        F.col("role"), F.col("conv_id"), F.col("turn").cast("int"), query_mode(F.col("text"))
    )
    return asked.union(said)


SCORES_SQL = f"""{tokens_sql('qt', 'questions', 'question_id, table_name', 'question')},
{tokens_sql('ct', 'catalog', 'table_name, ordinal', "replace(column_name, '_', ' ')")},
cf AS (SELECT table_name, token, count(*) AS n FROM ct GROUP BY 1, 2),
hits AS (SELECT qt.question_id, qt.table_name, ct.ordinal, qt.token, max(CASE WHEN qt.token = ct.token THEN 1 ELSE 0 END) AS exact
  FROM qt JOIN ct ON qt.table_name = ct.table_name AND (contains(ct.token, qt.token) OR contains(qt.token, ct.token))
  GROUP BY 1, 2, 3, 4),
scores AS (SELECT question_id, hits.table_name, ordinal,
    round(sum(CASE exact WHEN 1 THEN 25.0 ELSE 1.0 END / CAST(coalesce(n, 1) AS DOUBLE)), 9) AS score
  FROM hits LEFT JOIN cf ON hits.table_name = cf.table_name AND hits.token = cf.token GROUP BY 1, 2, 3)"""
BASE_SQL = f"{QUESTIONS_SQL}, {CATALOG_SQL}, {SCORES_SQL}"


@register("column_scores", f"WITH {BASE_SQL} SELECT question_id, table_name, ordinal, score FROM scores")
def column_scores(spark, sf_dir):
    return ops.score_columns(questions(spark, sf_dir), given_catalog(spark, sf_dir))


def ranked_sql(top: int) -> str:
    return f"""ranked AS (SELECT * FROM (
  SELECT q.question_id, q.table_name, q.question, c.ordinal, c.column_name, coalesce(s.score, 0.0) AS score,
    row_number() OVER (PARTITION BY q.question_id, q.table_name ORDER BY coalesce(s.score, 0.0) DESC, c.ordinal) AS rank
  FROM questions q JOIN catalog c ON q.table_name = c.table_name
  LEFT JOIN scores s ON s.question_id = q.question_id AND s.table_name = q.table_name AND s.ordinal = c.ordinal)
  WHERE rank <= {top})"""


@register(
    "ranked_columns",
    f"WITH {BASE_SQL}, {ranked_sql(5)} SELECT question_id, table_name, ordinal, score, CAST(rank AS INTEGER) AS rank FROM ranked",
)
def ranked_columns(spark, sf_dir):
    ranked = ops.rank_columns(questions(spark, sf_dir), given_catalog(spark, sf_dir), top_columns=5)
    return ranked.select("question_id", "table_name", "ordinal", "score", "rank")


_ID_NAMES = ", ".join(quoted(n) for n in fv.IDENTIFIER_COLUMN_NAMES)


def context_sql(top: int) -> str:
    return f"""{ranked_sql(top)},
moded AS (SELECT *, {mode_sql('lower(question)')} AS mode FROM questions),
marked AS (SELECT *, column_name IN ({_ID_NAMES}) AS is_id FROM catalog),
ids AS (SELECT table_name, column_name, ordinal FROM marked m
  WHERE is_id OR (ordinal = 1 AND NOT EXISTS (SELECT 1 FROM marked x WHERE x.table_name = m.table_name AND x.is_id))),
offered AS (
  SELECT m.question_id, m.table_name, m.mode, i.column_name, 0 AS part, i.ordinal AS place FROM moded m JOIN ids i USING (table_name)
  UNION ALL SELECT m.question_id, m.table_name, m.mode, c.column_name, 1, c.ordinal FROM moded m JOIN catalog c USING (table_name)
    WHERE m.mode LIKE 'broad%'
  UNION ALL SELECT m.question_id, m.table_name, m.mode, r.column_name, 1, r.rank FROM moded m
    JOIN ranked r USING (question_id, table_name) WHERE m.mode NOT LIKE 'broad%'),
uniq AS (SELECT *, row_number() OVER (PARTITION BY question_id, table_name, column_name ORDER BY part, place) AS seen FROM offered),
listed AS (SELECT question_id, table_name, mode, column_name,
    row_number() OVER (PARTITION BY question_id, table_name ORDER BY part, place) AS position FROM uniq WHERE seen = 1),
context AS (SELECT l.*, c.data_type FROM listed l JOIN catalog c USING (table_name, column_name)
  WHERE mode LIKE 'broad%' OR position <= {top})"""


@register(
    "context_columns",
    f"""WITH {BASE_SQL}, {context_sql(4)}
        SELECT question_id, table_name, mode, column_name, data_type, CAST(position AS INTEGER) AS position FROM context""",
)
def context_columns(spark, sf_dir):
    chosen = ops.select_columns(questions(spark, sf_dir), given_catalog(spark, sf_dir), top_columns=4)
    return chosen.select(
        "question_id", "table_name", F.col("query_mode").alias("mode"), F.posexplode("selected_columns").alias("p", "c")
    ).select(
        "question_id", "table_name", "mode", F.col("c.name").alias("column_name"),
        F.col("c.type").alias("data_type"), (F.col("p") + 1).alias("position"),
    )


def _requirements_sql() -> str:
    return " || ".join(f"chr(10) || {quoted(line)}" for line in ("", *fv.PROMPT_REQUIREMENTS))


@register(
    "prompt_text",
    f"""WITH {BASE_SQL}, {context_sql(4)},
        lines AS (SELECT question_id, table_name, mode,
            string_agg('- ' || column_name || ' (' || data_type || ')', chr(10) ORDER BY position) AS body
          FROM context GROUP BY 1, 2, 3)
        SELECT question_id, {quoted(fv.PROMPT_ONE_HEADER)} || chr(10) || 'Question: ' || question || chr(10)
          || 'Suggested mode: ' || mode || chr(10) || 'Table name: ' || lines.table_name || chr(10)
          || 'Full column count: ' || (SELECT count(*) FROM catalog c WHERE c.table_name = lines.table_name) || chr(10)
          || 'Available columns:' || chr(10) || body || {_requirements_sql()} AS prompt
        FROM lines JOIN questions USING (question_id)""",
)
def prompt_text(spark, sf_dir):
    contexts = prepare_contexts(questions(spark, sf_dir), given_catalog(spark, sf_dir), top_columns=4)
    prompt = single_table_prompt(
        F.col("question"), F.col("query_mode"), F.col("table_name"), F.col("column_count"), F.col("selected_columns")
    )
    return contexts.select("question_id", prompt.alias("prompt"))


@register(
    "sql_contexts",
    f"""WITH {BASE_SQL}, {context_sql(4)}
        SELECT question_id, table_name, mode AS query_mode, count(*) AS selected_column_count,
          (SELECT count(*) FROM catalog c WHERE c.table_name = context.table_name) AS column_count
        FROM context GROUP BY question_id, table_name, mode""",
)
def sql_contexts(spark, sf_dir):
    contexts = prepare_contexts(questions(spark, sf_dir), given_catalog(spark, sf_dir), top_columns=4)
    return contexts.select("question_id", "table_name", "query_mode", "selected_column_count", "column_count")


def _requests(spark, sf_dir):
    """Each question names its table, or a dataset in some case with spaces around it."""
    by_table = F.col("question_id") % 2 == 0
    return questions(spark, sf_dir).select(
        "question_id",
        "question",
        F.when(by_table, F.col("table_name")).alias("table_name"),
        F.when(~by_table, F.concat(F.lit(" "), F.upper("table_name"))).alias("dataset_name"),
    )


def _named_datasets(spark) -> DataFrame:
    """A manifest that knows every given table by its own name."""
    rows = spark.createDataFrame([(i, t, file_path(t)) for i, t in enumerate(TABLES)], "position int, dataset_name string, file_path string")
    return manifest_from_rows(rows, "position")


@register("contexts_from_arguments", ORACLES["sql_contexts"])
def contexts_from_arguments(spark, sf_dir):
    """Contexts for questions about a table or a dataset that the user names."""
    contexts = prepare_requests(_requests(spark, sf_dir), _named_datasets(spark), given_catalog(spark, sf_dir), top_columns=4)
    return contexts.select("question_id", "table_name", "query_mode", "selected_column_count", "column_count")


@register(
    "inspect_tables",
    f"""WITH {BASE_SQL} SELECT question_id, table_name, count(*) AS column_count,
          string_agg(column_name || ' ' || data_type, ', ' ORDER BY ordinal) AS listed, least(count(*), 4) AS suggested
        FROM questions JOIN catalog USING (table_name) GROUP BY 1, 2""",
)
def inspected_tables(spark, sf_dir):
    """Schema of the table each question is about, and how many of its columns are suggested."""
    found = inspect_tables(_requests(spark, sf_dir), _named_datasets(spark), given_catalog(spark, sf_dir), top_columns=4)
    listed = F.array_join(F.transform("schema", lambda c: F.concat_ws(" ", c["name"], c["type"])), ", ")
    return found.select("question_id", "table_name", "column_count", listed.alias("listed"), F.size("suggested_columns").cast("long").alias("suggested"))


@register(
    "table_payloads",
    f"""WITH {BASE_SQL}, {context_sql(4)}
        SELECT question, mode AS suggested_mode, table_name, count(*) AS selected, 'model-1' AS sql_generation_model
        FROM context JOIN questions USING (question_id, table_name) WHERE question_id % 3 <> 0
        GROUP BY question_id, question, table_name, mode""",
)
def payloads_of_tables(spark, sf_dir):
    """Saved records of queries written for single tables; every third text is no query of its table."""
    asked = questions(spark, sf_dir)
    contexts = prepare_contexts(asked, given_catalog(spark, sf_dir), top_columns=4)
    text = F.when(F.col("question_id") % 3 == 0, F.lit("SELECT 1")).otherwise(F.concat(F.lit("SELECT * FROM "), "table_name"))
    generated = asked.select("question_id", F.struct("table_name", text.alias("sql")).alias("generated"))
    found = table_payloads(contexts, generated, "model-1")
    return found.select(
        "question", "suggested_mode", "table_name", F.size("selected_columns").cast("long").alias("selected"), "sql_generation_model"
    )
