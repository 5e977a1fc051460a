"""Manifests: lists of datasets, their files and their descriptions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabquest.functions.names import file_stem, first_non_blank, fold

FIELDS = (
    "file_path", "metadata_path", "dataset_name", "source", "created_at",
    "domain", "description", "data_interpretation_notes", "table_name",
)
ENTRY_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the manifest file, or of every manifest file in a folder.

    Each file must hold a JSON array; ``manifest_file`` and ``entry_pos`` keep
    the order of entries.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("manifest_file"), "value"
    )
    checked = F.when(
        F.col("value").rlike(r"^\s*\["), F.col("value")
    ).otherwise(F.raise_error(F.lit("Manifest must be a JSON array of dataset entries.")).cast("string"))
    entries = F.from_json(checked, T.ArrayType(ENTRY_SCHEMA), {"mode": "FAILFAST"})
    return files.select("manifest_file", F.posexplode(entries).alias("entry_pos", "entry")).select(
        "manifest_file", "entry_pos", "entry.*"
    )


def manifest_from_rows(rows: DataFrame, order: str) -> DataFrame:
    """Rows that already have manifest fields, given a manifest's order columns."""
    known = [F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in FIELDS]
    return rows.select(F.lit("").alias("manifest_file"), F.col(order).alias("entry_pos"), *known)


def filter_manifest(manifest: DataFrame, dataset_names: Iterable[str] | None = None) -> DataFrame:
    """Entries with one of the names, whatever their case; all entries without names."""
    wanted = sorted({name.strip().lower() for name in dataset_names or ()})
    return manifest.filter(fold(F.col("dataset_name")).isin(wanted)) if wanted else manifest


def split_valid(manifest: DataFrame, required: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Entries that have every required field, and the rest with ``missing_field``."""
    missing = F.coalesce(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f)) for f in required])
    marked = manifest.withColumn("missing_field", missing)
    return (
        marked.filter(F.col("missing_field").isNull()).drop("missing_field"),
        marked.filter(F.col("missing_field").isNotNull()),
    )


def require_fields(manifest: DataFrame, required: Iterable[str]) -> DataFrame:
    """Fail the job on an entry that lacks a required field."""
    checked = manifest
    for field in required:
        problem = F.raise_error(F.lit(f"Manifest entry is missing required field: {field}")).cast("string")
        checked = checked.withColumn(field, F.when(F.coalesce(F.col(field), F.lit("")) == "", problem).otherwise(F.col(field)))
    return checked


def with_defaults(manifest: DataFrame) -> DataFrame:
    """Entries with the name defaulting to the file's, and texts stripped."""
    return (
        manifest.withColumn(
            "dataset_name",
            F.coalesce(F.nullif(F.col("dataset_name"), F.lit("")), file_stem(F.col("file_path"))),
        )
        .withColumn("source", F.coalesce("source", F.lit("")))
        .withColumn("domain", F.coalesce("domain", F.lit("")))
        .withColumn("description", first_non_blank(F.col("description")))
        .withColumn("data_interpretation_notes", first_non_blank(F.col("data_interpretation_notes")))
    )
