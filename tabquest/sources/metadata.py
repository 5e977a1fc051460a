"""Dataset metadata and saved query records, one JSON object per file or line."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_SCHEMA = (
    "dataset_name string, source string, file_path string, num_rows long, num_columns long, "
    "columns array<string>, sample_rows array<map<string,string>>, domain string, "
    "data_interpretation_notes string, description string, embedding_text string"
)

# The ten-field record a SQL writer returns, inside its saved payload.
PAYLOAD_SCHEMA = (
    "question string, suggested_mode string, table_name string, generated_query struct<"
    "chosen_candidate_index: int, chosen_dataset_name: string, suggested_mode: string, "
    "final_mode: string, mode_decision: string, table_name: string, scope: string, sql: string, "
    "selected_columns_used: array<string>, explanation: string>"
)

_COLUMNS = "array<struct<name: string, type: string>>"
CONTEXT_SCHEMA = (
    "question string, query_mode string, table_name string, column_count long, selected_column_count long, "
    f"selected_columns {_COLUMNS}, suggested_candidate_index int, suggested_dataset_name string, "
    "candidates array<struct<candidate_index: int, dataset_name: string, table_name: string, description: string, "
    "data_interpretation_notes: string, source: string, distance: double, query_mode: string, column_count: long, "
    f"selected_column_count: long, selected_columns: {_COLUMNS}>>"
)


def path_missing(problem: AnalysisException) -> bool:
    return problem.getCondition() == "PATH_NOT_FOUND"


def read_metadata(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Metadata files below ``root``; ``metadata_path`` is each file's path relative to it.

    Missing sample values are written as a bare NaN and become null.
    """
    base = root.rstrip("/")
    raw = spark.read.option("multiLine", True).schema(METADATA_SCHEMA).json(f"{base}/{pattern}")
    without_nan = F.transform(
        "sample_rows", lambda row: F.transform_values(row, lambda _, v: F.nullif(v, F.lit("NaN")))
    )
    relative = F.substring_index(F.col("_metadata.file_path"), f"{base}/", -1)
    return raw.withColumn("metadata_path", relative).withColumn("sample_rows", without_nan)


def write_metadata(metadata: DataFrame, folder: str) -> None:
    """Write metadata as JSON, one folder per dataset; only datasets present are replaced."""
    (
        metadata.withColumn("record", F.col("metadata_path"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", False)
        .partitionBy("record")
        .json(folder)
    )


def read_written_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`write_metadata` wrote; empty when nothing was written yet."""
    schema = METADATA_SCHEMA + ", metadata_path string"
    try:
        return spark.read.schema(schema).json(folder).select(*_names(spark, schema))
    except AnalysisException as problem:
        if not path_missing(problem):
            raise
        return spark.createDataFrame([], schema)


def _names(spark: SparkSession, schema: str) -> list[str]:
    return spark.createDataFrame([], schema).columns


def read_payloads(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Saved generated queries as one table: one object per file, or one per line."""
    return (
        spark.read.option("multiLine", one_per_file)
        .schema(PAYLOAD_SCHEMA)
        .json(path)
        .withColumn("payload_file", F.col("_metadata.file_path"))
    )


def read_contexts(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Saved contexts as one table; ``candidates`` is null for a single-table context."""
    return (
        spark.read.option("multiLine", one_per_file)
        .schema(CONTEXT_SCHEMA)
        .json(path)
        .withColumn("context_file", F.col("_metadata.file_path"))
    )
