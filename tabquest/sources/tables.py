"""Tables: CSV scans, managed imports and the catalog of columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabquest.functions.names import table_name_of
from tabquest.session import small_table
from tabquest.sources.manifest import require_fields

CATALOG_SCHEMA = "table_name string, ordinal int, column_name string, data_type string"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True
) -> DataFrame:
    """CSV with a header row; types are inferred unless a schema is given.

    Inference reads the data once more, so give a schema for large files.  Line breaks inside
    quotes belong to a value, so a file is read by one task.  With ``multiline`` off, files are split
    across tasks; then every line must be a whole record, and one that is not fails the job.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    if not multiline:
        reader = reader.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def schema_for(
    schemas: Mapping[str, T.StructType | str] | None, path: str, table: str
) -> T.StructType | str | None:
    """The schema given for a dataset, by table name or by file path."""
    given = schemas or {}
    return given.get(table, given.get(path))


def import_csv(
    spark: SparkSession,
    path: str,
    table: str,
    force: bool = False,
    schema: T.StructType | str | None = None,
    location: str | None = None,
    multiline: bool = True,
) -> str:
    """Create a table from a CSV; an existing one is kept, or replaced when ``force``."""
    if spark.catalog.tableExists(table) and not force:
        return f"Skipping existing table: {table}"
    writer = read_csv(spark, path, schema, multiline).write.mode("overwrite").format("parquet")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(table)
    return f"Imported dataset into table: {table}"


def import_manifest(
    spark: SparkSession,
    manifest: DataFrame,
    force: bool = False,
    schemas: Mapping[str, T.StructType | str] | None = None,
    location: str | None = None,
    multiline: bool = True,
) -> list[str]:
    """Import every dataset of a manifest; each import is a distributed job of its own."""
    entries = require_fields(manifest, ["file_path"]).select(
        "manifest_file",
        "entry_pos",
        "file_path",
        table_name_of(F.col("table_name"), F.col("dataset_name"), F.col("file_path")).alias("table"),
    )
    messages = []
    for entry in entries.orderBy("manifest_file", "entry_pos").toLocalIterator():
        path, table = entry["file_path"], entry["table"]
        own = f"{location}/{table}" if location else None
        messages.append(import_csv(spark, path, table, force, schema_for(schemas, path, table), own, multiline))
    return messages


def catalog_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of the given tables: ``(table_name, ordinal, column_name, data_type)``."""
    rows = [
        (table, ordinal, field.name, field.dataType.simpleString())
        for table, df in tables.items()
        for ordinal, field in enumerate(df.schema.fields, start=1)
    ]
    return small_table(spark, rows, CATALOG_SCHEMA)


def session_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database)]


def session_catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Columns of every table and view the session knows."""
    return catalog_of(spark, {name: spark.table(name) for name in session_tables(spark, database)})


def table_columns(catalog: DataFrame, table: str) -> list[dict]:
    """Ordered columns of one table; an unknown table is an error."""
    found = catalog.filter(F.col("table_name") == table).orderBy("ordinal").toLocalIterator()
    columns = [{"name": r["column_name"], "type": r["data_type"]} for r in found]
    if not columns:
        raise ValueError(f"Table not found: {table}")
    return columns
