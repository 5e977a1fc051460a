"""Lookups of datasets, tables and candidates.

The looked-up sides (manifest, metadata, catalog) hold one row per dataset or
column.  They are reduced to one row per key first; Spark broadcasts them when
their size allows it and joins by shuffle when it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabquest.functions.names import first_non_blank, fold, non_blank, strip, table_name_of


def _first_entry(manifest: DataFrame, key: Column) -> DataFrame:
    """First manifest entry per key, in manifest order."""
    entry = F.struct(*[F.col(c) for c in manifest.columns])
    return (
        manifest.withColumn("lookup_key", key)
        .groupBy("lookup_key")
        .agg(F.min_by(entry, F.struct("manifest_file", "entry_pos")).alias("entry"))
    )


def find_entries(df: DataFrame, manifest: DataFrame, file_path: str = "file_path") -> DataFrame:
    """Add ``entry``, the first manifest entry of the same file; null without a match."""
    keyed = df.withColumn("lookup_key", strip(F.col(file_path)))
    return keyed.join(entries_by_file(manifest), "lookup_key", "left").drop("lookup_key")


def entries_by_file(manifest: DataFrame) -> DataFrame:
    """``(lookup_key, entry)``: the first manifest entry of every file."""
    return _first_entry(manifest, strip(F.col("file_path")))


def resolve_table_names(requests: DataFrame, manifest: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``resolved_table`` to rows with ``table_name`` and ``dataset_name``.

    A given table wins untouched; otherwise the first manifest entry with the
    dataset's name, whatever its case.  Rows without either, or with an unknown
    name, get null, or fail the job when ``strict``.
    """
    entries = _first_entry(manifest, fold(F.col("dataset_name"))).select(
        "lookup_key",
        table_name_of(
            F.col("entry.table_name"), F.col("entry.dataset_name"), F.col("entry.file_path"), strict=False
        ).alias("manifest_table"),
    )
    explicit = F.nullif(F.col("table_name"), F.lit(""))
    asked = F.when(explicit.isNull() & (F.col("dataset_name") != ""), fold(F.col("dataset_name")))
    found = requests.withColumn("lookup_key", asked).join(entries, "lookup_key", "left")
    resolved = F.coalesce(explicit, F.col("manifest_table"))
    if strict:
        name = F.nullif(F.col("dataset_name"), F.lit(""))
        problem = F.when(name.isNull(), F.lit("Provide a table or a dataset.")).otherwise(
            F.concat(F.lit("Dataset not found in manifest: "), name)
        )
        resolved = F.when(resolved.isNull(), F.raise_error(problem).cast("string")).otherwise(resolved)
    return found.withColumn("resolved_table", resolved).drop("lookup_key", "manifest_table")


def expected_tables(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``expected_table``: the payload's table, the generated query's, the argument, the dataset's.

    Rows carry ``payload_table``, ``generated_table``, ``table_name`` and
    ``dataset_name``; the first that is set wins, and null means no expectation.
    """
    given = F.coalesce(
        *[F.nullif(F.col(c), F.lit("")) for c in ("payload_table", "generated_table", "table_name")]
    )
    asked = requests.withColumn("argument_table", F.col("table_name")).withColumn("table_name", given)
    return (
        resolve_table_names(asked, manifest)
        .withColumnRenamed("resolved_table", "expected_table")
        .drop("table_name")
        .withColumnRenamed("argument_table", "table_name")
    )


def sql_input(query: Column, file_text: Column, generated_sql: Column) -> Column:
    """The SQL to look at: query, else file, else generated; stripped, null without any."""
    return strip(F.coalesce(F.nullif(query, F.lit("")), file_text, F.nullif(generated_sql, F.lit(""))))


def nested_schemas(catalog: DataFrame) -> DataFrame:
    """One row per table with its ordered columns (as many as the table is wide)."""
    column = F.struct("ordinal", F.col("column_name").alias("name"), F.col("data_type").alias("type"))
    return catalog.groupBy("table_name").agg(
        F.transform(
            F.array_sort(F.collect_list(column)),
            lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type")),
        ).alias("schema"),
        F.count("*").alias("column_count"),
    )


def dataset_contexts(manifest: DataFrame, metadata: DataFrame, catalog: DataFrame) -> DataFrame:
    """What is known of every file: table name, schema, description and notes.

    Worked out once per dataset, however many questions find it; write the
    result, so that Spark knows its size when it is joined.
    """
    name = table_name_of(
        F.col("entry.table_name"), F.col("entry.dataset_name"), F.col("entry.file_path"), strict=False
    )
    named = entries_by_file(manifest).withColumn("table_name", name)
    return described(named.join(nested_schemas(catalog), "table_name", "left"), metadata).drop("entry")


def described(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add ``description`` and ``notes`` of each row's ``entry``.

    Metadata, keyed by ``metadata_path``, goes before the manifest's own text
    wherever it is not blank.
    """
    texts = metadata.select(
        F.col("metadata_path").alias("lookup_path"),
        F.col("description").alias("metadata_description"),
        F.col("data_interpretation_notes").alias("metadata_notes"),
    )
    joined = df.withColumn("lookup_path", non_blank(F.col("entry.metadata_path"))).join(
        texts, "lookup_path", "left"
    )
    return joined.select(
        *[c for c in df.columns],
        first_non_blank(F.col("metadata_description"), F.col("entry.description")).alias("description"),
        first_non_blank(F.col("metadata_notes"), F.col("entry.data_interpretation_notes")).alias("notes"),
    )


def candidate_at(candidates: Column, index: Column) -> Column:
    """The candidate with an index, from a question's own short list; the last one wins."""
    return F.try_element_at(F.filter(candidates, lambda c: c["candidate_index"] == index), F.lit(-1))


def missing_tables(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidate tables that do not exist; empty when all is well."""
    return candidates.select("table_name").distinct().join(
        catalog.select("table_name").distinct(), "table_name", "left_anti"
    )


def selected_datasets(generated: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The retrieved row each generated query refers to.

    By index if its table agrees, else the best-ranked row of that table.  Rows
    of ``retrieved`` have ``question_id``, ``rank`` (from 1) and ``table_name``;
    unresolved queries keep a null ``rank``.
    """
    wanted = generated.select("question_id", "chosen_candidate_index", F.col("table_name").alias("chosen_table"))
    same_table = wanted.join(
        retrieved.withColumn("chosen_table", F.col("table_name")), ["question_id", "chosen_table"], "left"
    )
    by_index = F.col("rank") == F.col("chosen_candidate_index") + 1
    details = [c for c in retrieved.columns if c != "question_id"]
    preferred = F.struct(F.when(by_index, 0).otherwise(1), F.col("rank"))
    return (
        same_table.groupBy("question_id", "chosen_candidate_index", "chosen_table")
        .agg(F.min_by(F.struct(*details), preferred).alias("selected"))
        .select("question_id", "chosen_candidate_index", "chosen_table", "selected.*")
    )
