"""Vectors, embedding, top-k, record stores and candidates for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions.vectors import filled_positions, l2_norm, l2_normalize
from tabquest.operators import lookups
from tabquest.operators.audit import generated_problem
from tabquest.operators.similarity import top_k
from tabquest.plans.answer import candidate_contexts, enrich, retrieve
from tabquest.plans.embed import dataset_documents, embed, refresh_embeddings
from tabquest.plans.prompts import candidates_prompt
from tabquest.registry.common import (
    CATALOG_SQL,
    QUESTIONS_SQL,
    TABLES,
    given_catalog,
    given_manifest,
    questions,
    quoted,
    registrar,
    table,
    tokens_sql,
    weights_sql,
)
from tabquest.registry.tables import PROFILE_SQL, profiles
from tabquest.registry.text import SCORES_SQL, _requirements_sql, context_sql
from tabquest.session import configure, materialise, work_dir
from tabquest.sources import vector_store

QUERIES, ORACLES = {}, {}


register = registrar(QUERIES, ORACLES)


@register(
    "l2_normalize",
    """SELECT vec_id, i - 1 AS position, round(x / norm, 6) + 0.0 AS value, round(norm, 6) AS norm FROM (
         SELECT vec_id, unnest(v) AS x, unnest(range(1, 65)) AS i, sqrt(list_sum([y * y FOR y IN v])) AS norm FROM (
           SELECT vec_id, [CAST(e AS DOUBLE) * (1 + vec_id % 7) FOR e IN embedding] AS v FROM embeddings))""",
)
def normalized_vectors(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda e: e.cast("double") * (1 + F.col("vec_id") % 7)).alias("v")
    )
    return scaled.select(
        "vec_id", F.round(l2_norm(F.col("v")), 6).alias("norm"), F.posexplode(l2_normalize(F.col("v"))).alias("p", "x")
    ).select("vec_id", F.col("p").cast("bigint").alias("position"), (F.round("x", 6) + 0.0).alias("value"), "norm")


_TOPK_SQL = """WITH v AS (SELECT vec_id, [CAST(e AS DOUBLE) FOR e IN embedding] AS e FROM embeddings),
  u AS (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN e])) FOR x IN e] AS e FROM v)
SELECT query_id, vector_id, round(distance, 6) AS distance, CAST(n AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vector_id) AS n FROM (
    SELECT q.vec_id AS query_id, u.vec_id AS vector_id, round(1 - list_dot_product(q.e, u.e), 10) + 0.0 AS distance
    FROM u q, u)) WHERE n <= 3"""


def _embedded(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("query_id"), "embedding"), rows.select(
        F.col("vec_id").alias("vector_id"), "embedding"
    )


@register("cosine_topk", _TOPK_SQL)
def cosine_topk(spark, sf_dir):
    return top_k(*_embedded(spark, sf_dir), k=3)


@register("cosine_topk_cells", _TOPK_SQL)
def cosine_topk_cells(spark, sf_dir):
    """The same result by the partitioned way, which large inputs take."""
    return top_k(*_embedded(spark, sf_dir), k=3, max_broadcast_rows=0)


@register(
    "hash_embed",
    f"""WITH {tokens_sql('t', 'documents', 'doc_id', 'text')}, {weights_sql('w', 't', 'doc_id')}
        SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(weight, 5) AS weight FROM w""",
)
def hash_embed(spark, sf_dir):
    embedded = embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return filled_positions(embedded, "doc_id", "embedding").withColumn("weight", F.round("weight", 5))


@register(
    "document_search",
    f"""WITH asked AS (SELECT conv_id * 1000 + turn AS question_id, text FROM conversations),
        {tokens_sql('qt', 'asked', 'question_id', 'text')}, {weights_sql('qw', 'qt', 'question_id')},
        {tokens_sql('dt', 'documents', 'doc_id', 'text')}, {weights_sql('dw', 'dt', 'doc_id')},
        dots AS (SELECT question_id, doc_id, sum(qw.weight * dw.weight) AS dot FROM qw JOIN dw USING (bucket) GROUP BY 1, 2),
        dist AS (SELECT a.question_id, d.doc_id, round(1 - coalesce(dot, 0), 10) + 0.0 AS distance
          FROM asked a CROSS JOIN documents d LEFT JOIN dots ON dots.question_id = a.question_id AND dots.doc_id = d.doc_id)
        SELECT question_id, doc_id, round(distance, 6) AS distance, CAST(n AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, doc_id) AS n FROM dist) WHERE n <= 3""",
)
def document_search(spark, sf_dir):
    """Every conversation turn against every document, whole texts on both sides."""
    asked = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"
    )
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vector_id"), "text")
    vectors = materialise(embed(stored, "text").drop("text"), "document-vectors")
    queries = materialise(embed(asked, "text").drop("text"), "question-vectors")
    found = top_k(queries, vectors, k=3)
    return found.withColumnRenamed("query_id", "question_id").withColumnRenamed("vector_id", "doc_id")


# ---- record stores ------------------------------------------------------------


@register(
    "vector_upsert",
    """WITH batch AS (
         SELECT doc_id AS record_id, lang AS document, n_chars AS num_rows, 0 AS place, n_chars * 64.0 AS vector_sum FROM documents
         UNION ALL SELECT doc_id, 'labelled', quality * 10 + toxic, 1, quality * 64.0 FROM labels),
       latest AS (SELECT record_id, document, num_rows, vector_sum FROM (
         SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY place DESC) AS n FROM batch) WHERE n = 1),
       stored AS (SELECT vec_id * 3 AS record_id, 'old' AS document, CAST(label AS BIGINT) AS num_rows,
           list_sum([CAST(e AS DOUBLE) FOR e IN embedding]) AS vector_sum FROM embeddings
         WHERE vec_id * 3 NOT IN (SELECT record_id FROM latest)
         UNION ALL SELECT * FROM latest)
       SELECT record_id, document, num_rows, round(CAST(vector_sum AS DOUBLE), 4) + 0.0 AS vector_sum FROM stored""",
)
def vector_upsert(spark, sf_dir):
    """Store the embeddings, then upsert a batch with repeats (the last one wins), and compact."""
    spark = configure(spark)
    path = work_dir(spark, "store")
    constant = lambda value: F.array_repeat(F.expr(value).cast("float"), 64)
    first = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") * 3).alias("record_id"),
        F.lit("old").alias("document"),
        F.col("label").cast("bigint").alias("num_rows"),
        F.lit(0).alias("place"),
        "embedding",
    )
    batch = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"), F.col("lang").alias("document"), F.col("n_chars").alias("num_rows"),
        F.lit(0).alias("place"), constant("n_chars").alias("embedding"),
    )
    relabelled = table(spark, sf_dir, "labels").select(
        F.col("doc_id"), F.lit("labelled"), (F.col("quality") * 10 + F.col("toxic")).cast("bigint"), F.lit(1), constant("quality")
    )
    vector_store.upsert(spark, path, first, "record_id", F.col("place"), buckets=8)
    vector_store.upsert(spark, path, batch.union(relabelled), "record_id", F.col("place"))
    vector_store.compact(spark, path)
    return vector_store.read_store(spark, path).select("record_id", "document", "num_rows", _vector_sum())


def _vector_sum():
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return (F.round(total, 4) + 0.0).alias("vector_sum")


@register(
    "embed_skip_existing",
    """SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def embed_skip_existing(spark, sf_dir):
    batch = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return vector_store.new_records(batch, table(spark, sf_dir, "labels"), "doc_id")


@register(
    "stored_records",
    """SELECT vec_id, label, round(list_sum([CAST(e AS DOUBLE) FOR e IN embedding]), 4) + 0.0 AS vector_sum
       FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)""",
)
def stored_records(spark, sf_dir):
    """Records with given ids from a store of two versions; the second replaces half of the first."""
    spark = configure(spark)
    path = work_dir(spark, "store")
    rows = table(spark, sf_dir, "embeddings")
    blank = rows.withColumn("label", F.lit(-1)).withColumn("embedding", F.array().cast("array<float>"))
    half = F.col("vec_id") % 2 == 0
    vector_store.upsert(spark, path, rows.filter(half).union(blank.filter(~half)), "vec_id", F.col("label"), buckets=16)
    vector_store.upsert(spark, path, rows.filter(~half), "vec_id", F.col("label"))
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return vector_store.lookup(spark, path, wanted).select("vec_id", "label", _vector_sum())


# ---- datasets for questions ---------------------------------------------------


def _documents(spark, sf_dir):
    """Search documents of the given tables; every second one's text already holds the notes."""
    return dataset_documents(profiles(spark, sf_dir), given_manifest(spark))


@register(
    "embed_documents",
    f"""WITH {PROFILE_SQL}, later AS (SELECT p.*, CASE WHEN m.entry_pos % 2 = 0 THEN 'Extra rule ' || m.entry_pos ELSE notes END AS now
          FROM profile p JOIN (SELECT entry_pos, file_path FROM manifest) m USING (file_path))
        SELECT regexp_extract(file_path, '([^/]*)[.]csv$', 1) AS record_id, now AS data_interpretation_notes, num_rows,
          CASE WHEN now = '' OR contains(embedding_text, '{fv.NOTES_LABEL}' || now) THEN embedding_text
               ELSE embedding_text || ' {fv.NOTES_LABEL}' || now END AS document FROM later""",
)
def embed_documents(spark, sf_dir):
    """Notes that changed after the profile was written are added, known ones are not repeated."""
    changed = F.expr("CASE WHEN entry_pos % 2 = 0 THEN 'Extra rule ' || entry_pos ELSE data_interpretation_notes END")
    profiled = profiles(spark, sf_dir).withColumn("data_interpretation_notes", changed)
    documents = dataset_documents(profiled, given_manifest(spark))
    return documents.select("record_id", "data_interpretation_notes", "num_rows", "document")


_SKIPPED_SQL = f"""WITH {PROFILE_SQL} SELECT 'skip' AS step, regexp_extract(file_path, '([^/]*)[.]csv$', 1) AS record_id, num_rows,
  embedding_text AS document FROM profile"""


@register(
    "embed_store",
    f"""SELECT * FROM ({_SKIPPED_SQL})
        UNION ALL SELECT 'force', record_id, num_rows, document FROM ({ORACLES["embed_documents"]})""",
)
def embed_store(spark, sf_dir):
    """Embed and store the profiles; changed ones are skipped at first and replaced when forced."""
    spark = configure(spark)
    path = work_dir(spark, "store")
    manifest, profiled = given_manifest(spark), materialise(profiles(spark, sf_dir), "profiles")
    changed = F.expr("CASE WHEN entry_pos % 2 = 0 THEN 'Extra rule ' || entry_pos ELSE data_interpretation_notes END")
    later = profiled.withColumn("data_interpretation_notes", changed)
    seen = []
    for step, metadata, force in (("first", profiled, False), ("skip", later, False), ("force", later, True)):
        refresh_embeddings(spark, metadata, manifest, path, force)
        unit = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).between(0.999999, 1.000001)
        stored = vector_store.read_store(spark, path).filter(unit)
        seen.append(materialise(stored.select(F.lit(step).alias("step"), "record_id", "num_rows", "document"), step))
    return seen[1].union(seen[2])


RETRIEVED_SQL = f"""{QUESTIONS_SQL}, {PROFILE_SQL},
records AS (SELECT *, regexp_extract(file_path, '([^/]*)[.]csv$', 1) AS record_id FROM profile),
{tokens_sql('atok', 'questions', 'question_id', 'question')}, {weights_sql('aw', 'atok', 'question_id')},
{tokens_sql('rt', 'records', 'record_id', 'embedding_text')}, {weights_sql('rw', 'rt', 'record_id')},
dots AS (SELECT question_id, record_id, sum(aw.weight * rw.weight) AS dot FROM aw JOIN rw USING (bucket) GROUP BY 1, 2),
near AS (SELECT q.question_id, r.record_id, round(1 - coalesce(dot, 0), 10) + 0.0 AS distance
  FROM questions q CROSS JOIN records r LEFT JOIN dots ON dots.question_id = q.question_id AND dots.record_id = r.record_id),
found AS (SELECT * REPLACE (round(distance, 6) AS distance) FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, record_id) AS rank FROM near) WHERE rank <= 3),
enriched AS (SELECT f.question_id, f.record_id, f.distance, f.rank, r.dataset_name, r.source,
    r.record_id AS table_name, r.description, r.notes FROM found f JOIN records r USING (record_id))"""


def _enriched(spark, sf_dir):
    profiled = materialise(profiles(spark, sf_dir), "profiles")
    manifest = given_manifest(spark)
    store = materialise(embed(dataset_documents(profiled, manifest), "document"), "store")
    asked = questions(spark, sf_dir).select("question_id", "question")
    found = retrieve(asked, store)
    contexts = lookups.dataset_contexts(manifest, profiled, given_catalog(spark, sf_dir))
    return enrich(found, materialise(contexts, "contexts")), asked


@register(
    "candidate_enrichment",
    f"""WITH {RETRIEVED_SQL}, {CATALOG_SQL}
        SELECT question_id, CAST(rank AS INTEGER) AS rank, record_id, distance, dataset_name, source, table_name, description, notes,
          (SELECT count(*) FROM catalog c WHERE c.table_name = enriched.table_name) AS column_count,
          (SELECT c.column_name FROM catalog c WHERE c.table_name = enriched.table_name AND ordinal = 2) AS second_column
        FROM enriched""",
)
def candidate_enrichment(spark, sf_dir):
    enriched, _ = _enriched(spark, sf_dir)
    return enriched.select(
        "question_id", "rank", "record_id", "distance", "dataset_name", "source", "table_name", "description", "notes",
        "column_count", F.col("schema")[1]["name"].alias("second_column"),
    )


# Two candidates of a question have different tables, so the pair identifies one.
_CANDIDATE_SQL = f"""{RETRIEVED_SQL.replace('questions AS (', 'asked AS (', 1).replace('questions', 'asked')},
questions AS (SELECT e.question_id, e.table_name, question FROM enriched e JOIN asked USING (question_id) WHERE rank <= 2),
{CATALOG_SQL}, {SCORES_SQL}, {context_sql(6)}"""


def _contexts(spark, sf_dir):
    enriched, asked = _enriched(spark, sf_dir)
    return candidate_contexts(enriched.join(asked, "question_id"), given_catalog(spark, sf_dir), top_columns=6)


@register(
    "candidate_contexts",
    f"""WITH {_CANDIDATE_SQL}
        SELECT c.question_id, CAST(e.rank - 1 AS INTEGER) AS candidate_index, e.dataset_name, e.table_name, e.distance, c.mode AS query_mode,
          CAST(c.position AS INTEGER) AS position, c.column_name, c.data_type,
          first_value(e.dataset_name) OVER (PARTITION BY c.question_id ORDER BY e.rank) AS suggested_dataset_name
        FROM context c JOIN enriched e ON e.question_id = c.question_id AND e.table_name = c.table_name""",
)
def contexts_of_candidates(spark, sf_dir):
    listed = _contexts(spark, sf_dir).select(
        "question_id", F.col("context.suggested_dataset_name"), F.explode("context.candidates").alias("c")
    )
    return listed.select(
        "question_id", "suggested_dataset_name", "c.candidate_index", "c.dataset_name", "c.table_name", "c.distance",
        "c.query_mode", F.posexplode("c.selected_columns").alias("p", "column"),
    ).select(
        "question_id", "suggested_dataset_name", "candidate_index", "dataset_name", "table_name", "distance",
        "query_mode", (F.col("p") + 1).alias("position"), F.col("column.name").alias("column_name"),
        F.col("column.type").alias("data_type"),
    )


@register(
    "candidate_prompts",
    f"""WITH {_CANDIDATE_SQL},
        blocks AS (SELECT c.question_id, e.rank, e.dataset_name,
            'Candidate ' || (e.rank - 1) || ':' || chr(10) || '- Dataset name: ' || e.dataset_name || chr(10)
            || '- Table name: ' || e.table_name || chr(10) || '- Source: ' || e.source || chr(10)
            || '- Retrieval distance: ' || CAST(e.distance AS VARCHAR) || chr(10) || '- Description: ' || e.description || chr(10)
            || '- Data interpretation notes: ' || e.notes || chr(10) || '- Suggested mode: ' || c.mode || chr(10)
            || '- Full column count: ' || (SELECT count(*) FROM catalog k WHERE k.table_name = e.table_name) || chr(10)
            || '- Available columns:' || chr(10)
            || string_agg('  - ' || c.column_name || ' (' || c.data_type || ')', chr(10) ORDER BY c.position) || chr(10) AS body
          FROM context c JOIN enriched e ON e.question_id = c.question_id AND e.table_name = c.table_name
          GROUP BY c.question_id, e.rank, e.dataset_name, e.table_name, e.source, e.distance, e.description, e.notes, c.mode)
        SELECT b.question_id, {quoted(fv.PROMPT_MANY_HEADER)} || chr(10) || 'Question: ' || any_value(question) || chr(10)
          || 'Suggested candidate index: 0' || chr(10) || 'Suggested dataset name: ' || min(CASE WHEN rank = 1 THEN dataset_name END)
          || chr(10) || chr(10) || 'Candidates:' || chr(10) || string_agg(body, chr(10) ORDER BY rank) || {_requirements_sql()} AS prompt
        FROM blocks b JOIN asked USING (question_id) GROUP BY b.question_id""",
)
def candidate_prompts(spark, sf_dir):
    prompt = candidates_prompt(F.col("question"), F.col("context"))
    return _contexts(spark, sf_dir).select("question_id", prompt.alias("prompt"))


# ---- generated queries against their candidates --------------------------------

_INDEX_CASE = "CASE question_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 7 ELSE 0 END"
_TABLE_CASE = (
    "CASE question_id % 6 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'part' WHEN 2 THEN 'orders' "
    "WHEN 3 THEN 'customer' WHEN 4 THEN 'documents' ELSE 'lineitem' END"
)
_SQL_CASE = f"CASE question_id % 4 WHEN 0 THEN 'WITH x' ELSE ' SELECT 1 FROM ' || CASE question_id % 7 WHEN 0 THEN 'PART' ELSE {_TABLE_CASE} END END"


def _generated(asked):
    return asked.select(
        "question_id",
        F.expr(_INDEX_CASE).cast("int").alias("chosen_candidate_index"),
        F.expr(_TABLE_CASE).alias("table_name"),
        F.expr(_SQL_CASE).alias("sql"),
    )


@register(
    "selected_dataset",
    f"""WITH {RETRIEVED_SQL}, generated AS (
          SELECT question_id, CAST({_INDEX_CASE} AS INTEGER) AS chosen_candidate_index, {_TABLE_CASE} AS chosen_table FROM questions)
        SELECT g.question_id, g.chosen_candidate_index, g.chosen_table, CAST(e.rank AS INTEGER) AS rank, e.dataset_name, e.distance
        FROM generated g LEFT JOIN enriched e ON e.question_id = g.question_id AND e.table_name = g.chosen_table""",
)
def selected_dataset(spark, sf_dir):
    enriched, asked = _enriched(spark, sf_dir)
    retrieved = enriched.select("question_id", "rank", "table_name", "dataset_name", "distance")
    return lookups.selected_datasets(_generated(asked), retrieved).drop("table_name")


@register(
    "generated_checks",
    f"""WITH {RETRIEVED_SQL}, generated AS (
          SELECT question_id, CAST({_INDEX_CASE} AS INTEGER) AS i, {_TABLE_CASE} AS t, {_SQL_CASE} AS s FROM questions)
        SELECT g.question_id, CASE
            WHEN e.table_name IS NULL THEN {quoted(fv.MSG_INDEX)} || coalesce(CAST(i AS VARCHAR), 'None')
            WHEN e.table_name <> t THEN {quoted(fv.MSG_TABLE)} || t
            WHEN NOT starts_with(lower(trim(s)), 'select') THEN {quoted(fv.MSG_SANITY_SELECT)}
            WHEN NOT contains(lower(s), t) THEN {quoted(fv.MSG_SANITY_TABLE)} END AS problem
        FROM generated g LEFT JOIN enriched e ON e.question_id = g.question_id AND e.rank = g.i + 1 AND e.rank <= 2""",
)
def generated_checks(spark, sf_dir):
    enriched, asked = _enriched(spark, sf_dir)
    candidate = F.struct((F.col("rank") - 1).alias("candidate_index"), "table_name")
    listed = (
        enriched.filter(F.col("rank") <= fv.DEFAULT_SQL_CANDIDATES)
        .groupBy("question_id")
        .agg(F.collect_list(candidate).alias("candidates"))
    )
    problem = generated_problem(
        F.col("candidates"), F.col("chosen_candidate_index"), F.col("table_name"), F.col("sql")
    )
    return listed.join(_generated(asked), "question_id").select("question_id", problem.alias("problem"))


@register(
    "missing_tables",
    f"""WITH wanted AS (SELECT DISTINCT {_TABLE_CASE.replace('question_id', 'p_partkey')} AS table_name FROM part)
        SELECT table_name FROM wanted WHERE table_name NOT IN ({', '.join(quoted(t) for t in TABLES)})""",
)
def missing_tables(spark, sf_dir):
    asked = questions(spark, sf_dir).select("question_id")
    return lookups.missing_tables(_generated(asked), given_catalog(spark, sf_dir))
