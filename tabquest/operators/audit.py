"""Read-only rules for SQL text, as columns over a table or stream of queries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions import sqltext
from tabquest.functions.names import strip


def audit(queries: DataFrame, sql: str = "sql", expected: str = "expected_table") -> DataFrame:
    """Add ``normalized_sql``, ``detected_tables``, ``violations`` and ``is_valid``.

    Every rule looks at its own row only, so the same call works on a batch and
    on a stream, without a shuffle.  ``expected`` may be null: no expectation.
    A plain search goes before the patterns that only matter where it finds something.
    """
    given = F.coalesce(F.col(sql), F.lit(""))
    prepared = (
        queries.withColumn("normalized_sql", sqltext.normalize_sql(given))
        .withColumn("_plain", F.lower(sqltext.strip_quoted_content(F.col("normalized_sql"))))
        .withColumn("detected_tables", sqltext.from_tables(F.col("_plain")))
    )
    plain, tables = F.col("_plain"), F.col("detected_tables")
    wanted = F.nullif(F.col(expected), F.lit(""))

    def rule(broken: Column, message) -> Column:
        return F.array_compact(F.array(F.when(broken, message if isinstance(message, Column) else F.lit(message))))

    other_table = F.try_element_at(tables, F.lit(1)) != F.lower(wanted)
    one_table = F.size(tables) == 1
    violations = F.concat(
        rule(F.col("normalized_sql") == "", fv.MSG_EMPTY),
        rule(plain.contains("--") | plain.contains("/*") | plain.contains("*/"), fv.MSG_COMMENTS),
        rule(given.contains(";") & sqltext.has_multiple_statements(given), fv.MSG_MULTIPLE),
        rule(~plain.startswith("select"), fv.MSG_NOT_SELECT),
        F.transform(sqltext.forbidden_keywords(plain), lambda k: F.concat(F.lit(fv.MSG_KEYWORD), k)),
        rule(plain.rlike(r"(?U)\bjoin\b"), fv.MSG_JOIN),
        rule(plain.contains(",") & sqltext.from_clause(plain).contains(","), fv.MSG_COMMA_FROM),
        rule(~one_table, fv.MSG_ONE_TABLE),
        rule(
            one_table & other_table,
            F.format_string(fv.MSG_UNEXPECTED_TABLE, F.try_element_at(tables, F.lit(1)), wanted),
        ),
    )
    return (
        prepared.withColumn("violations", violations)
        .withColumn("is_valid", F.size("violations") == 0)
        .drop("_plain")
    )


def violation_rows(audited: DataFrame, *keys: str) -> DataFrame:
    """One row per violation, numbered from 0 in rule order."""
    return audited.select(*keys, F.posexplode("violations").alias("position", "violation"))


def sanity_problem(sql: Column, table_name: Column) -> Column:
    """Why generated SQL cannot be right for its table, or null."""
    text = F.lower(strip(sql))
    return F.when(~text.startswith("select"), fv.MSG_SANITY_SELECT).when(
        ~text.contains(F.lower(table_name)), fv.MSG_SANITY_TABLE
    )


def generated_problem(candidates: Column, chosen_index: Column, table_name: Column, sql: Column) -> Column:
    """First reason to refuse a generated query: index, table, then the text itself.

    ``candidates`` is the question's list of candidate structs; null for a
    question that was asked about a single table.
    """
    chosen = F.try_element_at(F.filter(candidates, lambda c: c["candidate_index"] == chosen_index), F.lit(-1))
    return (
        F.when(
            candidates.isNotNull() & chosen.isNull(),
            F.concat(F.lit(fv.MSG_INDEX), F.coalesce(chosen_index.cast("string"), F.lit("None"))),
        )
        .when(
            candidates.isNotNull() & ~chosen["table_name"].eqNullSafe(table_name),
            F.concat(F.lit(fv.MSG_TABLE), table_name),
        )
        .otherwise(sanity_problem(sql, table_name))
    )


# Double-quoted words are identifiers only in ANSI mode.
IDENTIFIER_SETTINGS = ("spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers")


@contextmanager
def quoted_identifiers(spark: SparkSession) -> Iterator[None]:
    """Read double-quoted words as identifiers while queries are analysed; settings are put back."""
    before = {setting: spark.conf.get(setting) for setting in IDENTIFIER_SETTINGS}
    for setting in IDENTIFIER_SETTINGS:
        spark.conf.set(setting, "true")
    try:
        yield
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)


def analyse(spark: SparkSession, sql: str) -> DataFrame:
    """Let Spark analyse one query; raises if it is not acceptable."""
    with quoted_identifiers(spark):
        return spark.sql(sql)


def check_sql(spark: SparkSession, sql: str, expected_table: str | None = None) -> tuple[dict, DataFrame | None]:
    """Validation record of one query, and its DataFrame if it is acceptable.

    The engine is asked only when no rule is broken.
    """
    one = spark.createDataFrame([(sql, expected_table)], "sql string, expected_table string")
    row = audit(one).first()
    result = {
        "is_valid": row["is_valid"],
        "normalized_sql": row["normalized_sql"],
        "expected_table": expected_table,
        "detected_tables": list(row["detected_tables"]),
        "syntax_ok": False,
        "violations": list(row["violations"]),
        "explain_error": None,
    }
    if not result["is_valid"]:
        return result, None
    try:
        df = analyse(spark, result["normalized_sql"])
    except (AnalysisException, ParseException) as problem:
        result.update(is_valid=False, explain_error=str(problem))
        result["violations"].append(f"Spark rejected the query: {problem}")
        return result, None
    result["syntax_ok"] = True
    return result, df


def guarded_sql(
    spark: SparkSession, sql: str, expected_table: str | None = None, limit: int = fv.DEFAULT_ROW_LIMIT
) -> DataFrame:
    """Rows of an acceptable query, capped; raises ``ValueError`` with the violations otherwise."""
    result, df = check_sql(spark, sql, expected_table)
    if df is None:
        raise ValueError("; ".join(result["violations"]))
    return df.limit(limit)
