"""The append-only log of metrics records: JSON, one object per line."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.sources.metadata import path_missing


def append_records(records: DataFrame, folder: str) -> None:
    """Add records to the log."""
    records.write.mode("append").option("ignoreNullFields", False).json(folder)


def _at(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "variant")


def _flag(path: str) -> Column:
    """A strict JSON boolean; anything else is null."""
    return F.when(
        F.schema_of_variant(_at(path)) == "BOOLEAN", F.try_variant_get("v", f"$.{path}", "boolean")
    )


def _number(path: str) -> Column:
    """A JSON number (or boolean, as 1 or 0); text is ignored even if it looks like a number."""
    return F.when(
        F.schema_of_variant(_at(path)) != "STRING", F.try_variant_get("v", f"$.{path}", "double")
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Flat summary columns from a table or stream of JSON lines.

    Blank lines are skipped and a malformed line fails the job.  A missing
    status becomes ``unknown``; an explicit null stays null.
    """
    parsed = lines.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select(
        F.parse_json("value").alias("v")
    )
    status = F.when(_at("status").isNull(), F.lit("unknown")).otherwise(F.try_variant_get("v", "$.status", "string"))
    return parsed.select(
        status.alias("status"),
        _flag("retrieval.candidate_changed_by_model").alias("candidate_changed"),
        _flag("query_mode.mode_changed_by_model").alias("mode_changed"),
        _flag("openai_decision.changed_candidate_or_mode").alias("any_model_change"),
        _flag("validation.is_valid").alias("validation_success"),
        _flag("execution.executed").alias("execution_success"),
        F.try_variant_get("v", "$.query_mode.suggested_mode_for_chosen_candidate", "string").alias("suggested_mode"),
        F.try_variant_get("v", "$.query_mode.final_mode", "string").alias("final_mode"),
        *[_number(f"timings_ms.{s}").alias(f"ms_{s}") for s in fv.TIMING_STAGES],
        F.try_variant_get("v", "$.recorded_at", "string").alias("recorded_at"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of the log; no rows when there is no log yet."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as problem:
        if not path_missing(problem):
            raise
        lines = spark.createDataFrame([], "value string")
    return parse_lines(lines)


def stream_log(spark: SparkSession, folder: str) -> DataFrame:
    """The same records as they arrive in a folder."""
    return parse_lines(spark.readStream.text(folder))
