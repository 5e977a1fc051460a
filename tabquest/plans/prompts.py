"""Texts handed to a SQL writer, rendered in bulk from contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabquest import fixed_values as fv


def plain_number(value: Column) -> Column:
    """A distance as shortest decimal text, never in exponent form."""
    text = F.regexp_replace(F.round(value, 6).cast("decimal(12,6)").cast("string"), "0+$", "")
    return F.regexp_replace(text, r"\.$", ".0")


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), F.coalesce(value.cast("string"), F.lit("")))


def _column_lines(columns: Column, indent: str) -> Column:
    return F.transform(columns, lambda c: F.concat(F.lit(f"{indent}- "), c["name"], F.lit(" ("), c["type"], F.lit(")")))


def _in_dialect(line: str, dialect: str | None) -> Column:
    """A fixed line; the dialect it names may be replaced by the one that will run the query."""
    return F.lit(line.replace(fv.PROMPT_DIALECT, dialect) if dialect else line)


def _requirements(dialect: str | None) -> Column:
    return F.array(F.lit(""), *[_in_dialect(line, dialect) for line in fv.PROMPT_REQUIREMENTS])


def single_table_prompt(
    question: Column,
    mode: Column,
    table_name: Column,
    column_count: Column,
    columns: Column,
    dialect: str | None = None,
) -> Column:
    opening = F.array(
        _in_dialect(fv.PROMPT_ONE_HEADER, dialect),
        _line("Question: ", question),
        _line("Suggested mode: ", mode),
        _line("Table name: ", table_name),
        _line("Full column count: ", column_count),
        F.lit("Available columns:"),
    )
    return F.array_join(F.concat(opening, _column_lines(columns, ""), _requirements(dialect)), "\n")


def _candidate_lines(candidate: Column) -> Column:
    opening = F.array(
        F.concat(F.lit("Candidate "), candidate["candidate_index"].cast("string"), F.lit(":")),
        _line("- Dataset name: ", candidate["dataset_name"]),
        _line("- Table name: ", candidate["table_name"]),
        _line("- Source: ", candidate["source"]),
        _line("- Retrieval distance: ", plain_number(candidate["distance"])),
        _line("- Description: ", candidate["description"]),
        _line("- Data interpretation notes: ", candidate["data_interpretation_notes"]),
        _line("- Suggested mode: ", candidate["query_mode"]),
        _line("- Full column count: ", candidate["column_count"]),
        F.lit("- Available columns:"),
    )
    return F.concat(opening, _column_lines(candidate["selected_columns"], "  "), F.array(F.lit("")))


def candidates_prompt(question: Column, context: Column, dialect: str | None = None) -> Column:
    opening = F.array(
        _in_dialect(fv.PROMPT_MANY_HEADER, dialect),
        _line("Question: ", question),
        _line("Suggested candidate index: ", context["suggested_candidate_index"]),
        _line("Suggested dataset name: ", context["suggested_dataset_name"]),
        F.lit(""),
        F.lit("Candidates:"),
    )
    blocks = F.flatten(F.transform(context["candidates"], _candidate_lines))
    return F.array_join(F.concat(opening, blocks, _requirements(dialect)), "\n")
