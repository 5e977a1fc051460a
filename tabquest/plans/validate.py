"""Validation reports for whole tables of inputs: which SQL is meant, which table it may read, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabquest.operators.audit import audit
from tabquest.operators.lookups import expected_tables, sql_input

# Where an input's SQL and its table may be given, in the order in which they count.
SQL_FIELDS = ("query", "file_text", "generated_sql")
TABLE_FIELDS = ("payload_table", "generated_table", "table_name", "dataset_name")


def validation_report(inputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """input_id, normalized_sql, expected_table, detected_tables, violations and is_valid of every input.

    ``inputs`` has ``input_id`` and any of the fields above; fields that it lacks count as null.  The SQL is
    the query, else the file's text, else the generated one; an input without any is empty SQL.  The
    table is the payload's, else the generated query's, the argument's, or the named dataset's;
    without one, or with an unknown dataset, any single table will do.
    """
    missing = [c for c in (*SQL_FIELDS, *TABLE_FIELDS) if c not in inputs.columns]
    whole = inputs.withColumns({c: F.lit(None).cast("string") for c in missing}).select("input_id", *SQL_FIELDS, *TABLE_FIELDS)
    asked = expected_tables(whole, manifest).select(
        "input_id", F.coalesce(sql_input(*[F.col(c) for c in SQL_FIELDS]), F.lit("")).alias("sql"), "expected_table"
    )
    return audit(asked).select("input_id", "normalized_sql", "expected_table", "detected_tables", "violations", "is_valid")
