"""From questions to datasets, columns, SQL contexts and answers, for whole tables of questions."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions.names import strip
from tabquest.functions.vectors import Encoder
from tabquest.operators import lookups, shared_scan
from tabquest.operators.audit import audit, generated_problem, quoted_identifiers, sanity_problem
from tabquest.operators.columns import ranked_columns, select_columns, shown, with_schemas
from tabquest.operators.metrics import build_records
from tabquest.operators.similarity import top_k
from tabquest.operators.single_table import result_records
from tabquest.plans.embed import embed
from tabquest.session import materialise, small_table, work_dir

MSG_NO_CANDIDATE = "No dataset was found for the question."


def retrieve(
    questions: DataFrame,
    store: DataFrame,
    k: int = fv.DEFAULT_TOP_K,
    make_encoder: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """The k nearest stored records of every question, best first.

    ``questions`` has ``question_id`` and ``question``; the result adds ``rank``,
    ``distance`` and the record's scalars.
    """
    asked = embed(questions.select("question_id", "question"), "question", make_encoder)
    vectors = store.withColumnRenamed("record_id", "vector_id")
    near = top_k(asked.withColumnRenamed("question_id", "query_id"), vectors, k)
    scalars = store.select("record_id", "dataset_name", "file_path", "domain", "source", "document")
    return (
        near.withColumnRenamed("query_id", "question_id")
        .withColumnRenamed("vector_id", "record_id")
        .join(scalars, "record_id")
        .withColumnRenamed("document", "embedding_text")
    )


def _record_problem() -> Column:
    """Why a retrieved record cannot be used, or null."""
    unknown = F.concat(F.lit(fv.MSG_NOT_IN_MANIFEST), F.coalesce("file_path", F.lit("")))
    no_table = F.concat(F.lit(fv.MSG_NO_TABLE), F.coalesce("table_name", F.lit("")))
    return F.when(F.col("is_known").isNull(), unknown).when(F.col("schema").isNull(), no_table)


def enrich(retrieved: DataFrame, contexts: DataFrame, strict: bool = True) -> DataFrame:
    """Add table name, schema, description and notes to retrieved records; ranks stay.

    ``contexts`` comes from :func:`tabquest.operators.lookups.dataset_contexts`.
    A record that the manifest does not know, or without a table, fails the job; if not
    ``strict`` column ``problem`` says so instead.
    """
    known = contexts.withColumn("is_known", F.lit(True))
    joined = retrieved.withColumn("lookup_key", strip(F.col("file_path"))).join(known, "lookup_key", "left")
    problem = _record_problem()
    if strict:
        failed = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("schema"))
        return joined.withColumn("schema", failed).drop("is_known", "lookup_key")
    return joined.withColumn("problem", problem).drop("is_known", "lookup_key")


def prepare_contexts(
    questions: DataFrame, catalog: DataFrame, top_columns: int = fv.DEFAULT_TOP_COLUMNS
) -> DataFrame:
    """Add mode, counts and selected columns to rows with ``question`` and ``table_name``.

    A blank question fails the job.
    """
    problem = F.raise_error(F.lit(fv.MSG_NO_QUESTION)).cast("string")
    given = F.when(strip(F.coalesce("question", F.lit(""))) == "", problem).otherwise(F.col("question"))
    return select_columns(questions.withColumn("question", given), catalog, top_columns).withColumn(
        "selected_column_count", F.size("selected_columns").cast("long")
    )


def prepare_requests(
    requests: DataFrame, manifest: DataFrame, catalog: DataFrame, top_columns: int = fv.DEFAULT_TOP_COLUMNS
) -> DataFrame:
    """Contexts for questions about a table or a dataset named by the user.

    ``requests`` has ``question_id``, ``question``, ``table_name`` and
    ``dataset_name``; a request without a known table fails the job.
    """
    named = lookups.resolve_table_names(requests, manifest, strict=True)
    asked = named.select("question_id", "question", F.col("resolved_table").alias("table_name"))
    return prepare_contexts(asked, catalog, top_columns)


def inspect_tables(
    requests: DataFrame, manifest: DataFrame, catalog: DataFrame, top_columns: int = fv.DEFAULT_TOP_COLUMNS
) -> DataFrame:
    """Schema of every requested table, with suggested columns where a question is given."""
    named = lookups.resolve_table_names(requests, manifest, strict=True)
    asked = named.select("question_id", "question", F.col("resolved_table").alias("table_name"))
    ranked = ranked_columns(F.col("question"), F.col("columns"), F.col("frequency"), top_columns)
    return with_schemas(asked, catalog).select(
        "question_id",
        "question",
        "table_name",
        F.size("columns").cast("long").alias("column_count"),
        shown(F.col("columns")).alias("schema"),
        F.when(F.col("question") != "", shown(ranked)).alias("suggested_columns"),
    )


CANDIDATE_FIELDS = (
    "candidate_index", "dataset_name", "table_name", "description", "data_interpretation_notes",
    "source", "distance", "query_mode", "column_count", "selected_column_count", "selected_columns",
)


def candidate_contexts(
    enriched: DataFrame,
    catalog: DataFrame,
    candidates: int = fv.DEFAULT_SQL_CANDIDATES,
    top_columns: int = fv.DEFAULT_TOP_COLUMNS,
) -> DataFrame:
    """One row per question with its first candidates: ``(question_id, question, context)``.

    ``enriched`` holds the question's text and the columns of :func:`enrich`.
    """
    kept = (
        enriched.filter(F.col("rank") <= candidates)
        .withColumn("candidate_index", F.col("rank") - 1)
        .drop("column_count")
        .withColumnRenamed("notes", "data_interpretation_notes")
    )
    fields = prepare_contexts(kept, catalog, top_columns)
    listed = F.array_sort(F.collect_list(F.struct("candidate_index", F.struct(*CANDIDATE_FIELDS).alias("c"))))
    return (
        fields.groupBy("question_id", "question")
        .agg(F.transform(listed, lambda x: x["c"]).alias("candidates"))
        .select(
            "question_id",
            "question",
            F.struct(
                F.lit(0).alias("suggested_candidate_index"),
                F.element_at("candidates", 1)["dataset_name"].alias("suggested_dataset_name"),
                "candidates",
            ).alias("context"),
        )
    )


def accept_generated(contexts: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated queries next to their contexts, with ``problem`` where one must be refused.

    ``generated`` has ``question_id`` and the struct ``generated`` of ten fields.
    """
    return contexts.join(generated, "question_id", "left").withColumn(
        "problem",
        generated_problem(
            F.col("context.candidates"),
            F.col("generated.chosen_candidate_index"),
            F.col("generated.table_name"),
            F.col("generated.sql"),
        ),
    )


def run_accepted(
    spark: SparkSession, audited: DataFrame, limit: int = fv.DEFAULT_ROW_LIMIT, at_once: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Run every valid query and return ``(results, outcomes)``, both read from written tables.

    Each distinct text is answered once, whatever the number of questions that share it.  The driver
    walks the texts, a thousand at a time, and lets Spark analyse them.  Plain queries of one
    table are answered together from shared scans of it; any other text, and those of a shared job
    that fails, run as a job of their own, a few at a time, each into a folder of its own.  An outcome's
    ``engine_error`` says that Spark did not accept the query, ``run_error`` that it failed while it
    ran; ``sql_execution`` is the time of the job that answered it.
    """
    folder = work_dir(spark, "answers")
    outcome_schema = "query string, engine_error string, run_error string, sql_execution double"
    query_of = F.concat(F.lit("q"), F.sha2("normalized_sql", 256)).alias("query")
    valid = audited.filter("is_valid").select("question_id", "normalized_sql", query_of)

    def since(started: float) -> float:
        return (time.perf_counter() - started) * 1000.0

    def analysed(row) -> tuple:
        """The row with its shared form, if it has one, or the error that Spark finds."""
        started = time.perf_counter()
        try:
            schema = spark.sql(row["normalized_sql"]).schema
        except (AnalysisException, ParseException) as error:
            return row, None, (row["query"], str(error), None, since(started))
        clauses = shared_scan.clauses_of(row["normalized_sql"])
        query = shared_scan.Query(row["query"], clauses, schema) if clauses else None
        return row, query if query and shared_scan.compiled(spark, query) else None, None

    def run_alone(row) -> tuple:
        started, failed = time.perf_counter(), None
        try:
            found = result_records(spark.sql(row["normalized_sql"]), limit)
            found.select(F.monotonically_increasing_id().alias("position"), "record").write.mode("overwrite").parquet(
                f"{folder}/results/query={row['query']}"
            )
        except Exception as error:  # a failing query becomes an outcome, not a failed batch
            failed = str(error)
        return row["query"], None, failed, since(started)

    def run_shared(job: tuple) -> tuple[list, list]:
        """Outcomes of a shared job, or the tags of its queries if it fails."""
        number, (queries, found) = job
        started = time.perf_counter()
        try:
            found.write.mode("overwrite").parquet(f"{folder}/shared/job={number}")
        except Exception:  # which query fails shows when each runs alone
            small_table(spark, [], "query string, position long, record string").write.mode("overwrite").parquet(f"{folder}/shared/job={number}")
            return [], [q.tag for q in queries]
        return [(q.tag, None, None, since(started)) for q in queries], []

    texts = valid.select("query", "normalized_sql").distinct()
    small_table(spark, [], outcome_schema).write.parquet(f"{folder}/outcomes/group=0")
    small_table(spark, [], "position long, record string").write.parquet(f"{folder}/results/query=none")
    small_table(spark, [], "query string, position long, record string").write.parquet(f"{folder}/shared/job=none")
    with quoted_identifiers(spark), ThreadPoolExecutor(at_once) as pool:
        for number, group in enumerate(batched(texts.toLocalIterator(), 1000), start=1):
            looked_at = list(pool.map(analysed, group))
            shared = [query for _, query, _ in looked_at if query]
            jobs = ((f"{number}-{i}", job) for i, job in enumerate(shared_scan.passes(spark, shared, limit)))
            done = list(pool.map(run_shared, jobs))
            again = {tag for _, tags in done for tag in tags}
            alone = [row for row, query, error in looked_at if not error and (not query or query.tag in again)]
            outcomes = [error for _, _, error in looked_at if error] + [o for found, _ in done for o in found]
            outcomes += pool.map(run_alone, alone)
            small_table(spark, outcomes, outcome_schema).write.mode("overwrite").parquet(f"{folder}/outcomes/group={number}")
    names = ("position", "record", "query")
    rows = spark.read.schema("position long, record string, query string").parquet(f"{folder}/results").select(*names)
    together = spark.read.schema("query string, position long, record string").parquet(f"{folder}/shared").select(*names)
    rows = rows.unionByName(together)
    counts = rows.groupBy("query").agg(F.count("*").alias("row_count_returned"))
    outcomes = spark.read.schema(outcome_schema).parquet(f"{folder}/outcomes").join(counts, "query", "left")
    fine = F.col("engine_error").isNull() & F.col("run_error").isNull()
    outcomes = outcomes.withColumn("row_count_returned", F.when(fine, F.coalesce("row_count_returned", F.lit(0))))
    asked = valid.select("question_id", "query")
    return asked.join(rows, "query").drop("query"), asked.join(outcomes, "query").drop("query")


def answer_status(problem: Column, run_error: Column, is_valid: Column) -> Column:
    """error, executed or validation_failed: what became of a question."""
    return (
        F.when(problem.isNotNull() | run_error.isNotNull(), "error").when(is_valid, "executed").otherwise("validation_failed")
    )


def generated_payloads(accepted: DataFrame, model: str) -> DataFrame:
    """The record that is saved for every accepted generated query over several candidates.

    Mode and columns are null here; :func:`table_payloads` sets them for single tables.
    """
    return accepted.filter(F.col("problem").isNull()).select(
        "question",
        F.lit(None).cast("string").alias("suggested_mode"),
        F.col("generated.table_name").alias("table_name"),
        F.lit(model).alias("sql_generation_model"),
        F.lit(None).cast("array<struct<name:string,type:string>>").alias("selected_columns"),
        F.col("context.candidates").alias("candidate_contexts"),
        F.col("generated").alias("generated_query"),
    )


def table_payloads(contexts: DataFrame, generated: DataFrame, model: str) -> DataFrame:
    """The records saved for queries about single tables, whose contexts come from :func:`prepare_contexts`.

    A generated query that cannot be right for its table is left out.
    """
    problem = sanity_problem(F.col("generated.sql"), F.col("generated.table_name"))
    return contexts.drop("table_name").join(generated, "question_id").filter(problem.isNull()).select(
        "question",
        F.col("query_mode").alias("suggested_mode"),
        F.col("generated.table_name").alias("table_name"),
        F.lit(model).alias("sql_generation_model"),
        "selected_columns",
        F.lit(None).cast("array<struct<candidate_index:int,dataset_name:string,table_name:string>>").alias("candidate_contexts"),
        F.col("generated").alias("generated_query"),
    )


def answer_batch(
    spark: SparkSession,
    questions: DataFrame,
    store: DataFrame,
    manifest: DataFrame,
    metadata: DataFrame,
    catalog: DataFrame,
    generated: DataFrame,
    top_columns: int = fv.DEFAULT_TOP_COLUMNS,
    limit: int = fv.DEFAULT_ROW_LIMIT,
    make_encoder: Callable[[], Encoder] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answer a table of questions whose SQL was written elsewhere: ``(output, metrics)``.

    Retrieval, contexts and audit are one plan over all questions.  Output and metrics have
    one row per question; one that cannot be answered tells why in ``problem`` and has status
    ``error``.  Output has candidates, selected dataset, context, audit result and records.
    """
    datasets = materialise(lookups.dataset_contexts(manifest, metadata, catalog), "dataset-contexts")
    asked = questions.select("question_id", "question")
    blank = strip(F.coalesce("question", F.lit(""))) == ""
    found = materialise(
        enrich(retrieve(asked.filter(~blank), store, fv.DEFAULT_TOP_K, make_encoder), datasets, strict=False), "found"
    )
    unusable = found.filter(F.col("problem").isNotNull()).groupBy("question_id").agg(
        F.min_by("problem", "rank").alias("record_problem")
    )
    usable_records = found.join(unusable, "question_id", "left_anti").drop("problem").join(asked, "question_id")
    contexts = candidate_contexts(usable_records, catalog, fv.DEFAULT_SQL_CANDIDATES, top_columns).drop("question")
    every = asked.join(contexts, "question_id", "left").join(unusable, "question_id", "left")
    asked_problem = (
        F.when(blank, fv.MSG_NO_QUESTION)
        .when(F.col("record_problem").isNotNull(), F.col("record_problem"))
        .when(F.col("context").isNull(), MSG_NO_CANDIDATE)
    )
    accepted = materialise(
        accept_generated(every, generated).withColumn("problem", F.coalesce(asked_problem, "problem")).drop("record_problem"),
        "accepted",
    )
    usable = accepted.filter(F.col("problem").isNull()).select(
        "question_id", F.col("generated.sql").alias("sql"), F.col("generated.table_name").alias("expected_table")
    )
    audited = materialise(audit(usable), "audited")
    results, outcomes = run_accepted(spark, audited, limit)

    rejected = F.concat(F.lit("Spark rejected the query: "), F.col("engine_error"))
    checked = (
        audited.join(outcomes, "question_id", "left")
        .withColumn("is_valid", F.col("is_valid") & F.col("engine_error").isNull())
        .withColumn("violations", F.array_compact(F.concat("violations", F.array(rejected))))
    )
    validation = checked.select(
        "question_id",
        F.struct("is_valid", "normalized_sql", "expected_table", "detected_tables", "violations").alias("validation"),
        F.when(F.col("row_count_returned").isNotNull(), F.struct("row_count_returned")).alias("execution"),
        "sql_execution",
        "run_error",
    )
    runs = (
        accepted.join(validation, "question_id", "left")
        .withColumn("status", answer_status(F.col("problem"), F.col("run_error"), F.col("validation.is_valid")))
        .withColumn("problem", F.coalesce("problem", "run_error"))
    )
    other_stages = [F.lit(None).cast("double").alias(s) for s in fv.TIMING_STAGES if s != "sql_execution"]
    metrics = build_records(
        runs.withColumn("error_message", F.col("problem")).withColumn(
            "timings_ms", F.struct("sql_execution", *other_stages)
        )
    )
    retrieved = found.groupBy("question_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "dataset_name", "table_name", "distance", "source"))),
            lambda c: F.struct(
                c["dataset_name"].alias("dataset_name"), c["table_name"].alias("table_name"),
                c["distance"].alias("distance"), c["source"].alias("source"),
            ),
        ).alias("retrieved_candidates")
    )
    chosen = lookups.selected_datasets(
        generated.select("question_id", "generated.chosen_candidate_index", "generated.table_name"),
        found.select("question_id", "rank", "dataset_name", "table_name", "source", "distance"),
    ).select(
        "question_id", F.struct("dataset_name", "table_name", "source", "distance").alias("selected_dataset")
    )
    rows = results.groupBy("question_id").agg(  # at most `limit` records per question
        F.transform(F.array_sort(F.collect_list(F.struct("position", "record"))), lambda r: r["record"]).alias("records")
    )
    output = (
        runs.join(retrieved, "question_id", "left")
        .join(chosen, "question_id", "left")
        .join(rows, "question_id", "left")
        .select(
            "question_id", "question", "status", "problem", "retrieved_candidates", "selected_dataset",
            "context", "generated", "validation", "execution", "records",
        )
    )
    return output, metrics
