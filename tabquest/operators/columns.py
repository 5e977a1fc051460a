"""Which columns of a table matter for a question.

Questions are rows ``(question_id, table_name, question)`` and the catalog has
one row ``(table_name, ordinal, column_name, data_type)`` per column, ordinals
counting from 1.  The catalog is folded to one row per table, as wide as the
table; a question meets exactly the row of its own table.  Scoring, ranking and
merging then happen inside the question's row, so questions are neither
exploded nor shuffled, and many questions about one table make no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions.names import normalize_name
from tabquest.functions.text import column_name_tokens, is_broad, let, query_mode, tokenize


def column_tokens(catalog: DataFrame) -> DataFrame:
    """``(table_name, ordinal, token)``, every token once per column."""
    return catalog.select(
        "table_name", "ordinal", F.explode(column_name_tokens(F.col("column_name"))).alias("token")
    )


def token_frequency(tokens: DataFrame) -> DataFrame:
    """Number of columns of each table that contain a token."""
    return tokens.groupBy("table_name", "token").agg(F.count("*").alias("frequency"))


def merge_columns(primary: Column, secondary: Column, limit: int | None = None) -> Column:
    """Ordered union of two lists of columns, repeats by exact name dropped.

    The limit is tested after a column was added, so a limit of zero still gives one.
    """
    def first_of_each(both: Column) -> Column:
        return let(
            F.transform(both, lambda c: c["name"]),
            lambda names: F.filter(both, lambda c, i: F.array_position(names, c["name"]) == i + 1),
        )

    merged = let(F.concat(primary, secondary), first_of_each)
    return merged if limit is None else F.slice(merged, 1, max(limit, 1))


def shown(columns: Column) -> Column:
    """Name and type of every column of a list."""
    return F.transform(columns, lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type")))


def table_schemas(catalog: DataFrame) -> DataFrame:
    """One row per table: its ordered columns and what ranking needs of them.

    ``columns`` holds ordinal, name, type, tokens and the identifier mark,
    ``frequency`` the number of columns per token, ``identifiers`` the
    identifier columns (the first column where there is none), and
    ``broad_columns`` identifiers followed by the rest.
    """
    column = F.struct(
        "ordinal",
        F.col("column_name").alias("name"),
        F.col("data_type").alias("type"),
        column_name_tokens(F.col("column_name")).alias("tokens"),
        normalize_name(F.col("column_name")).isin(*fv.IDENTIFIER_COLUMN_NAMES).alias("is_identifier"),
    )
    frequency = let(
        F.flatten(F.transform("columns", lambda c: c["tokens"])),
        lambda tokens: F.transform(
            F.array_distinct(tokens),
            lambda t: F.struct(t.alias("token"), F.size(F.filter(tokens, lambda x: x == t)).alias("columns")),
        ),
    )
    marked = F.filter("columns", lambda c: c["is_identifier"])
    return (
        catalog.groupBy("table_name")
        .agg(F.array_sort(F.collect_list(column)).alias("columns"))  # as many as the table is wide
        .withColumn("identifiers", F.when(F.size(marked) > 0, marked).otherwise(F.slice("columns", 1, 1)))
        .select(
            "table_name",
            "columns",
            F.map_from_entries(frequency).alias("frequency"),
            shown(F.col("identifiers")).alias("identifiers"),
            merge_columns(shown(F.col("identifiers")), shown(F.col("columns"))).alias("broad_columns"),
        )
    )


def column_scores(question: Column, columns: Column, frequency: Column) -> Column:
    """Score of every column of the list for a question, in list order.

    A question word that is a column word adds 25 divided by the word's
    frequency in the table; a word that only contains, or is contained in, a
    column word adds 1 divided by it.  Words are first held against the table's
    vocabulary, so columns meet only the words that match anything.
    """
    vocabulary = F.map_keys(frequency)
    words = F.transform(
        tokenize(question),
        lambda w: F.struct(
            w.alias("word"),
            F.coalesce(F.try_element_at(frequency, w), F.lit(1)).cast("double").alias("spread"),
            F.filter(vocabulary, lambda t: t.contains(w) | w.contains(t)).alias("related"),
        ),
    )

    def gain(column: Column, word: Column) -> Column:
        return (
            F.when(F.array_contains(column["tokens"], word["word"]), fv.EXACT_TOKEN_WEIGHT / word["spread"])
            .when(F.arrays_overlap(column["tokens"], word["related"]), fv.PARTIAL_TOKEN_WEIGHT / word["spread"])
            .otherwise(0.0)
        )

    def scores(matching: Column) -> Column:
        return F.transform(
            columns, lambda c: F.rint(F.aggregate(matching, F.lit(0.0), lambda total, w: total + gain(c, w)) * 1e9) / 1e9
        )

    return let(F.filter(words, lambda w: F.size(w["related"]) > 0), scores)


def ranked_columns(question: Column, columns: Column, frequency: Column, top_columns: int) -> Column:
    """The best columns of the list: by score, then in table order."""
    scored = F.zip_with(
        columns,
        column_scores(question, columns, frequency),
        lambda c, score: F.struct(
            (-score).alias("order"), c["ordinal"].alias("ordinal"), c["name"].alias("name"),
            c["type"].alias("type"), score.alias("score"),
        ),
    )
    return F.slice(F.array_sort(scored), 1, top_columns)


def with_schemas(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Questions with the schema row of their table; an unknown table fails the job.

    Spark broadcasts the schemas while they are small; beyond that the join is
    shuffled and AQE splits a table that most questions ask about.
    """
    joined = questions.join(table_schemas(catalog), "table_name", "left")
    problem = F.raise_error(F.concat(F.lit("Table not found: "), F.col("table_name")))
    return joined.withColumn("columns", F.when(F.col("columns").isNull(), problem).otherwise(F.col("columns")))


def score_columns(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scores above zero in long form: ``(question_id, table_name, ordinal, score)``."""
    scores = column_scores(F.col("question"), F.col("columns"), F.col("frequency"))
    return (
        with_schemas(questions, catalog)
        .select("question_id", "table_name", F.posexplode(scores).alias("place", "score"))
        .filter("score > 0")
        .select("question_id", "table_name", (F.col("place") + 1).alias("ordinal"), "score")
    )


def rank_columns(questions: DataFrame, catalog: DataFrame, top_columns: int = fv.DEFAULT_TOP_COLUMNS) -> DataFrame:
    """The best columns per question: ``(question_id, table_name, rank, ordinal, column_name, score)``."""
    ranked = ranked_columns(F.col("question"), F.col("columns"), F.col("frequency"), top_columns)
    return (
        with_schemas(questions, catalog)
        .select("question_id", "table_name", F.posexplode(ranked).alias("place", "c"))
        .select(
            "question_id", "table_name", (F.col("place") + 1).alias("rank"), "c.ordinal",
            F.col("c.name").alias("column_name"), "c.score",
        )
    )


def select_columns(questions: DataFrame, catalog: DataFrame, top_columns: int = fv.DEFAULT_TOP_COLUMNS) -> DataFrame:
    """Add ``query_mode``, ``column_count`` and ``selected_columns`` to every question.

    Broad questions get identifiers and then the whole table, a list that is
    made once per table.  Other questions get identifiers and then ranked
    columns, up to the limit.
    """
    ranked = shown(ranked_columns(F.col("question"), F.col("columns"), F.col("frequency"), top_columns))
    narrow = merge_columns(F.col("identifiers"), ranked, top_columns)
    selected = F.when(is_broad(F.col("question")), F.col("broad_columns")).otherwise(narrow)
    return with_schemas(questions, catalog).select(
        *questions.columns,
        query_mode(F.col("question")).alias("query_mode"),
        F.size("columns").cast("long").alias("column_count"),
        selected.alias("selected_columns"),
    )
