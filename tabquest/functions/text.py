"""Text features of questions, columns and datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions.names import first_non_blank, non_blank, strip


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    A derived array that is used inside another array function would otherwise
    be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column) -> Column:
    """Distinct lower-case ``[a-z0-9]+`` runs longer than one character, without stopwords."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9]+"), F.lit(0))
    return F.array_except(runs, F.array(*[F.lit(w) for w in fv.STOPWORDS]))


def column_name_tokens(name: Column) -> Column:
    """Tokens of a column name; underscores separate words."""
    return tokenize(F.translate(name, "_", " "))


def _mentions_any(question: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any phrase occurs as a substring: one scan of the text for all of them."""
    text = F.lower(F.coalesce(question, F.lit("")))
    return text.rlike("|".join(phrases))


def is_broad(question: Column) -> Column:
    return _mentions_any(question, fv.BROAD_PROFILE_HINTS)


def query_mode(question: Column) -> Column:
    """Mode of a question, by plain substring tests (so ``country`` contains ``count``)."""
    aggregate = _mentions_any(question, fv.AGGREGATE_HINTS)
    return F.when(
        is_broad(question), F.when(aggregate, fv.MODE_BROAD_AGGREGATE).otherwise(fv.MODE_BROAD)
    ).otherwise(F.when(aggregate, fv.MODE_AGGREGATE).otherwise(fv.MODE_FOCUSED))


def dataset_description(dataset_name: Column, description: Column, num_rows: Column, num_columns: Column) -> Column:
    """The manifest's description (or a fallback) followed by the size sentence."""
    structure = F.format_string(fv.STRUCTURE_SENTENCE, F.format_number(num_rows, 0), num_columns.cast("string"))
    opening = F.coalesce(non_blank(description), F.format_string(fv.DESCRIPTION_FALLBACK, dataset_name))
    return F.concat_ws(" ", opening, structure)


def embedding_text(
    dataset_name: Column,
    source: Column,
    domain: Column,
    description: Column,
    notes: Column,
    columns: Column,
    num_rows: Column,
    num_columns: Column,
) -> Column:
    """The text by which a dataset is found; optional parts are left out when blank."""
    preview = F.concat(
        F.array_join(F.slice(columns, 1, fv.PREVIEW_COLUMNS), ", "),
        F.when(F.size(columns) > fv.PREVIEW_COLUMNS, ", ...").otherwise(""),
    )

    def sentence(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value, F.lit("."))

    return F.concat_ws(
        " ",
        sentence("Dataset", dataset_name),
        sentence("Source", F.coalesce(F.nullif(source, F.lit("")), F.lit(fv.DEFAULT_SOURCE))),
        sentence("Domain", F.coalesce(F.nullif(domain, F.lit("")), F.lit(fv.DEFAULT_DOMAIN))),
        sentence("Rows", num_rows.cast("string")),
        sentence("Columns", num_columns.cast("string")),
        F.concat(F.lit("Description: "), non_blank(description)),
        F.concat(F.lit(fv.NOTES_LABEL), non_blank(notes)),
        sentence("Column preview", preview),
        F.lit(fv.RETRIEVAL_SENTENCE),
    )


def search_document(text: Column, metadata_notes: Column, manifest_notes: Column) -> Column:
    """Text to embed: the notes are added unless the text already holds them."""
    base = strip(F.coalesce(text, F.lit("")))
    notes = first_non_blank(metadata_notes, manifest_notes)
    section = F.concat(F.lit(fv.NOTES_LABEL), notes)
    return F.when((notes == "") | base.contains(section), base).otherwise(
        strip(F.concat_ws(" ", base, section))
    )
