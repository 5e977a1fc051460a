"""Metrics records derived from the events table, their log, summaries and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.operators import metrics as ops
from tabquest.plans.report import report
from tabquest.registry.common import registrar, table
from tabquest.session import configure, work_dir
from tabquest.sources.metrics_log import append_records, read_log, stream_log
from tabquest.streaming import metrics as streams

QUERIES, ORACLES = {}, {}


register = registrar(QUERIES, ORACLES)


# Every event stands for one answered question; both engines read these expressions.
_MODE = "CASE {0} % 4 WHEN 0 THEN 'focused_filter' WHEN 1 THEN 'aggregate' WHEN 2 THEN 'broad_profile' ELSE '' END"
_CASES = {
    "status": "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'validation_failed' ELSE 'executed' END",
    "has_context": "(event_type <> 'error' OR event_id % 2 = 1)",
    "mode_0": _MODE.format("user_id"),
    "mode_1": _MODE.format("(event_id // 4)"),
    "chosen": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END",
    "final_mode": "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'broad_profile' WHEN 3 THEN 'aggregate' ELSE 'focused_filter' END",
    "is_valid": "(event_type <> 'signup')",
    "violations": "event_id % 3",
    "rows": "event_id % 21",
}


def _spark(name: str) -> str:
    return _CASES[name].replace("(event_id // 4)", "(event_id div 4)")


def runs(spark, sf_dir):
    executed = "status = 'executed'"
    return (
        table(spark, sf_dir, "events")
        .select(
            "ts", "value",
            F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("question"),
            F.lit(None).cast("string").alias("error_message"),
            *[F.expr(_spark(c)).alias(c) for c in _CASES],
        )
        .withColumn(
            "context",
            F.expr(
                """CASE WHEN has_context THEN named_struct('suggested_candidate_index', 0,
                   'suggested_dataset_name', 'first', 'candidates', array(
                     named_struct('candidate_index', 0, 'query_mode', mode_0),
                     named_struct('candidate_index', 1, 'query_mode', mode_1))) END"""
            ),
        )
        .withColumn(
            "generated",
            F.expr(
                """named_struct('chosen_candidate_index', cast(chosen as int), 'chosen_dataset_name', 'second',
                   'final_mode', final_mode, 'mode_decision', 'kept')"""
            ),
        )
        .withColumn(
            "validation",
            F.expr(
                """CASE WHEN status <> 'error' THEN named_struct('is_valid', is_valid, 'violations',
                   array_repeat('broken', cast(CASE WHEN is_valid THEN 0 ELSE violations END as int))) END"""
            ),
        )
        .withColumn("execution", F.expr(f"CASE WHEN {executed} THEN named_struct('row_count_returned', rows) END"))
        .withColumn(
            "timings_ms",
            F.expr(
                f"""named_struct('retrieval', value, 'context_enrichment', cast(NULL as double),
                    'sql_context_preparation', value / 7, 'sql_generation', value * 3.3D,
                    'sql_validation', CASE WHEN status <> 'error' THEN value + 1 END,
                    'sql_execution', CASE WHEN {executed} THEN value * 2 END, 'total', value * 10)"""
            ),
        )
    )


def records(spark, sf_dir):
    """Records stamped with the event's own time, so that they can be compared."""
    return ops.build_records(runs(spark, sf_dir), recorded_at=F.col("ts"))


_RECORDS_SQL = f"""base AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in _CASES.items())} FROM events),
records AS (SELECT ts, 'event ' || event_id AS question, status,
  round(value, 3) AS ms_retrieval, CAST(NULL AS DOUBLE) AS ms_context_enrichment, round(value / 7, 3) AS ms_sql_context_preparation,
  round(value * 3.3, 3) AS ms_sql_generation, CASE WHEN status <> 'error' THEN round(value + 1, 3) END AS ms_sql_validation,
  CASE WHEN status = 'executed' THEN round(value * 2, 3) END AS ms_sql_execution, round(value * 10, 3) AS ms_total,
  CASE WHEN has_context THEN 2 ELSE 0 END AS candidates,
  coalesce(has_context AND chosen <> 0, false) AS candidate_changed,
  CASE WHEN has_context THEN CASE chosen WHEN 0 THEN mode_0 WHEN 1 THEN mode_1 END END AS suggested_mode, final_mode,
  CASE WHEN status <> 'error' THEN is_valid END AS validation_success,
  CASE WHEN status = 'validation_failed' THEN violations ELSE 0 END AS violation_count,
  status = 'executed' AS execution_success, CASE WHEN status = 'executed' THEN rows ELSE 0 END AS row_count FROM base),
flat AS (SELECT *, candidate_changed OR mode_changed AS any_model_change FROM (
  SELECT *, coalesce(suggested_mode <> '' AND final_mode <> '' AND suggested_mode <> final_mode, false) AS mode_changed FROM records))"""


@register(
    "metrics_build",
    f"""WITH {_RECORDS_SQL}
        SELECT question, status, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS recorded_at, ms_sql_context_preparation,
          ms_sql_generation, ms_sql_execution, ms_total, CAST(candidates AS BIGINT) AS retrieved_candidate_count,
          candidate_changed, mode_changed, any_model_change, suggested_mode, final_mode, validation_success,
          CAST(violation_count AS BIGINT) AS violation_count, execution_success, CAST(row_count AS BIGINT) AS row_count_returned
        FROM flat""",
)
def metrics_build(spark, sf_dir):
    return records(spark, sf_dir).select(
        "question", "status", "recorded_at",
        *[F.col(f"timings_ms.{s}").alias(f"ms_{s}") for s in ("sql_context_preparation", "sql_generation", "sql_execution", "total")],
        "retrieval.retrieved_candidate_count",
        F.col("retrieval.candidate_changed_by_model").alias("candidate_changed"),
        F.col("query_mode.mode_changed_by_model").alias("mode_changed"),
        F.col("openai_decision.changed_candidate_or_mode").alias("any_model_change"),
        F.col("query_mode.suggested_mode_for_chosen_candidate").alias("suggested_mode"),
        "query_mode.final_mode",
        F.col("validation.is_valid").alias("validation_success"),
        "validation.violation_count",
        F.col("execution.executed").alias("execution_success"),
        "execution.row_count_returned",
    )


def _log(spark, sf_dir):
    folder = work_dir(configure(spark), "metrics")
    append_records(records(spark, sf_dir), folder)
    return folder


@register(
    "metrics_append_load",
    f"""WITH {_RECORDS_SQL}
        SELECT status, candidate_changed, mode_changed, any_model_change, validation_success, execution_success,
          suggested_mode, final_mode, ms_total, ms_sql_validation, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS recorded_at
        FROM flat""",
)
def metrics_append_load(spark, sf_dir):
    loaded = read_log(spark, _log(spark, sf_dir))
    return loaded.select(
        "status", *ops.COUNTED, "suggested_mode", "final_mode", "ms_total", "ms_sql_validation", "recorded_at"
    )


def _flat(spark, sf_dir):
    return ops.flat_records(records(spark, sf_dir))


@register("metrics_status_counts", f"WITH {_RECORDS_SQL} SELECT status, count(*) AS query_count FROM flat GROUP BY status")
def metrics_status_counts(spark, sf_dir):
    return ops.status_counts(_flat(spark, sf_dir))


@register(
    "metrics_rates",
    f"WITH {_RECORDS_SQL} SELECT count(*) AS total_queries, "
    + ", ".join(
        f"count(*) FILTER ({c}) AS {c}_count, round(100.0 * count(*) FILTER ({c}) / nullif(count(*), 0), 3) AS {c}_rate"
        for c in ops.COUNTED
    )
    + " FROM flat",
)
def metrics_rates(spark, sf_dir):
    return ops.totals(_flat(spark, sf_dir))


_STAGES_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS stage, round(avg(ms_{s}), 3) AS average_ms FROM flat" for s in fv.TIMING_STAGES
)


@register("metrics_stage_avg", f"WITH {_RECORDS_SQL} {_STAGES_SQL}")
def metrics_stage_avg(spark, sf_dir):
    return ops.stage_averages(_flat(spark, sf_dir))


_MODES_SQL = """modes AS (
  SELECT 'suggested' AS kind, suggested_mode AS mode FROM flat WHERE suggested_mode <> ''
  UNION ALL SELECT 'final', final_mode FROM flat WHERE final_mode <> ''
  UNION ALL SELECT 'transition', suggested_mode || ' -> ' || final_mode FROM flat WHERE suggested_mode <> '' AND final_mode <> '')"""


@register(
    "metrics_transitions",
    f"WITH {_RECORDS_SQL}, {_MODES_SQL} SELECT kind, mode, count(*) AS query_count FROM modes GROUP BY kind, mode",
)
def metrics_transitions(spark, sf_dir):
    return ops.mode_counts(_flat(spark, sf_dir))


_SUMMARY_SQL = (
    f"WITH {_RECORDS_SQL}, {_MODES_SQL}, summary AS (SELECT 'total' AS section, 'total_queries' AS name, CAST(count(*) AS DOUBLE) AS value FROM flat "
    + " ".join(
        f"UNION ALL SELECT 'count', '{c}', count(*) FILTER ({c}) FROM flat "
        f"UNION ALL SELECT 'rate', '{c}', round(100.0 * count(*) FILTER ({c}) / nullif(count(*), 0), 3) FROM flat"
        for c in ops.COUNTED
    )
    + " "
    + " ".join(f"UNION ALL SELECT 'average_ms', '{s}', round(avg(ms_{s}), 3) FROM flat" for s in fv.TIMING_STAGES)
    + """ UNION ALL SELECT 'status', status, count(*) FROM flat GROUP BY status
          UNION ALL SELECT CASE kind WHEN 'transition' THEN kind ELSE kind || '_mode' END, mode, count(*) FROM modes GROUP BY kind, mode)
          SELECT section, name, CAST(value AS DOUBLE) AS value FROM summary"""
)


@register("metrics_summary", _SUMMARY_SQL)
def metrics_summary(spark, sf_dir):
    return ops.summary_rows(_flat(spark, sf_dir))


@register("metrics_report", _SUMMARY_SQL)
def metrics_report(spark, sf_dir):
    """The summary read back from the log's files."""
    return report(spark, _log(spark, sf_dir))


@register("metrics_stream", _SUMMARY_SQL)
def metrics_stream(spark, sf_dir):
    """The summary kept by a stream over the log's files."""
    source, out = _log(spark, sf_dir), work_dir(spark, "summary")
    streams.start_group_stream(stream_log(spark, source), f"{out}/groups", f"{out}/state").awaitTermination()
    return streams.read_summary(spark, f"{out}/groups")


@register(
    "metrics_stream_daily",
    f"""WITH {_RECORDS_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, status, count(*) AS query_count,
          count(*) FILTER (execution_success) AS executed_count, 
          round(sum(CAST(round(ms_total * 1000) AS BIGINT)) / 1000.0::DOUBLE / nullif(count(ms_total), 0), 3) AS average_total_ms
        FROM flat GROUP BY 1, 2""",
)
def metrics_stream_daily(spark, sf_dir):
    """The log arrives in three batches in shuffled order of days; every one may be late."""
    out = work_dir(configure(spark), "daily")
    arriving = records(spark, sf_dir)
    turn = F.pmod(F.xxhash64("recorded_at", "question"), F.lit(3))
    for batch in range(3):
        append_records(arriving.filter(turn == batch), f"{out}/log")
        timed = stream_log(spark, f"{out}/log").withColumn("recorded_at", F.to_timestamp("recorded_at"))
        streams.start_daily_stream(timed, f"{out}/days", f"{out}/state").awaitTermination()
    return streams.read_daily(spark, f"{out}/days")
