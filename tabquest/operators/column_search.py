"""Search for columns by the words of a question.

An inverted index lists for every term the columns whose name or values hold it and the datasets
whose description holds it.  Weights are final when the index is written: document frequencies are
taken once over the whole catalog.  The index is a Parquet table in folders by hash of the term, so a
search reads only the folders of the terms it asks for.  Column hits and dataset hits are ranked
apart and fused by reciprocal ranks.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabquest.functions.text import column_name_tokens, tokenize

# A term in a name weighs as much as in two columns full of it.
NAME_WEIGHT = 2.0
# Ranks are damped by this much before they are fused.
DAMPING = 60
_NO_TERMS = "array<string>"
_INDEX = "kind string, table_name string, ordinal int, column_name string, term string, weight double, part int"


def term_part(term: Column, parts: int) -> Column:
    """The folder of the index that a term is in."""
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def value_terms(datasets: Mapping[str, DataFrame], columns: Mapping[str, list[str]]) -> DataFrame:
    """``(table_name, column_name, term, n)``: rows of each column whose value holds a term.

    All rows of the named columns count, in one pass per dataset; the term '' counts the values
    that are not null.  Counts are summed before anything is shuffled.  Store the result before
    :func:`postings`, which reads it twice.
    """

    def terms(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        found = F.when(value.isNotNull(), F.concat(F.array(F.lit("")), tokenize(value)))
        return F.transform(
            F.coalesce(found, F.array().cast(_NO_TERMS)), lambda t: F.struct(F.lit(name).alias("column_name"), t.alias("term"))
        )

    passes = [
        datasets[table].select(F.lit(table).alias("table_name"), F.explode(F.flatten(F.array(*map(terms, names)))).alias("found"))
        for table, names in columns.items()
        if names
    ]
    rows = reduce(DataFrame.unionByName, passes).select("table_name", "found.*")
    return rows.groupBy("table_name", "column_name", "term").agg(F.count("*").alias("n"))


def postings(catalog: DataFrame, values: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``(kind, table_name, ordinal, column_name, term, weight)`` of columns and datasets (ordinal 0).

    ``catalog`` has one row per column, ``values`` comes from :func:`value_terms`, ``descriptions`` has
    ``table_name`` and ``description``.  A column's weight of a term is its share (NAME_WEIGHT
    for a name, 0.5 to 1 for values by the share of rows) times the term's inverse frequency among
    all columns; a dataset's is the inverse frequency among all datasets.
    """
    columns = catalog.select("table_name", F.col("ordinal").cast("int").alias("ordinal"), "column_name")
    named = columns.select("*", F.explode(column_name_tokens(F.col("column_name"))).alias("term"), F.lit(NAME_WEIGHT).alias("share"))
    totals = values.where("term = ''").select("table_name", "column_name", F.col("n").alias("total"))
    held = values.where("term <> ''").join(totals, ["table_name", "column_name"]).join(columns, ["table_name", "column_name"])
    held = held.select("table_name", "ordinal", "column_name", "term", (0.5 + 0.5 * F.col("n") / F.col("total")).alias("share"))
    of_columns = named.unionByName(held).groupBy("table_name", "ordinal", "column_name", "term").agg(F.sum("share").alias("share"))
    words = F.explode(tokenize(F.col("description"))).alias("term")
    of_datasets = descriptions.select("table_name", F.lit(0).alias("ordinal"), F.lit("").alias("column_name"), words, F.lit(1.0).alias("share"))
    rows = of_columns.withColumn("kind", F.lit("column")).unionByName(of_datasets.withColumn("kind", F.lit("dataset")))
    sizes = columns.agg(F.count("*").alias("size")).withColumn("kind", F.lit("column")).unionByName(
        descriptions.agg(F.count("*").alias("size")).withColumn("kind", F.lit("dataset"))
    )
    frequency = rows.groupBy("kind", "term").agg(F.count("*").alias("df")).join(sizes, "kind")
    idf = F.log(1 + (F.col("size") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return rows.join(frequency, ["kind", "term"]).select(
        "kind", "table_name", "ordinal", "column_name", "term", (F.col("share") * idf).alias("weight")
    )


def write_index(rows: DataFrame, path: str, parts: int = 64) -> None:
    """Store postings by folders of terms, sorted by term, so that a read skips other terms within a file too."""
    placed = rows.withColumn("part", term_part(F.col("term"), parts))
    placed.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The postings in the folders of ``terms`` (which has ``part``); folder numbers are all the driver sees."""
    wanted = [r["part"] for r in terms.select("part").distinct().collect()]
    return spark.read.schema(_INDEX).parquet(path).where(F.col("part").isin(wanted))


def search(questions: DataFrame, path: str, parts: int = 64, depth: int = 50, k: int = 10) -> DataFrame:
    """The k best columns of every question that has any, best first.

    Returns ``(question_id, table_name, column_name, column_rank, dataset_rank, score, rank)``.  Hits are
    ranked by the sum of their weights, those of columns and those of datasets apart, ``depth`` of each; a column's
    score adds the reciprocal ranks of its own and of its dataset (null if that was not found).  Ties go by
    table name and ordinal.  All hits of a question meet once, as many as the catalog has columns at most.
    """
    asked = questions.select("question_id", F.explode(tokenize(F.col("question"))).alias("term"))
    asked = asked.withColumn("part", term_part(F.col("term"), parts))
    found = asked.join(read_postings(questions.sparkSession, path, asked), ["part", "term"])
    item = ["kind", "table_name", "ordinal", "column_name"]
    hits = found.repartition("question_id").groupBy("question_id", *item).agg(F.round(F.sum("weight"), 6).alias("weight"))
    best = Window.partitionBy("question_id", "kind").orderBy(F.desc("weight"), "table_name", "ordinal")
    ranked = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= depth)
    of_dataset = F.max(F.when(F.col("kind") == "dataset", F.col("place"))).over(Window.partitionBy("question_id", "table_name"))
    columns = ranked.withColumn("dataset_rank", of_dataset).where("kind = 'column'")
    score = 1 / (DAMPING + F.col("place")) + F.coalesce(1 / (DAMPING + F.col("dataset_rank")), F.lit(0.0))
    scored = columns.withColumn("score", F.round(score, 9))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "table_name", "ordinal")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("question_id", "table_name", "column_name", F.col("place").alias("column_rank"), "dataset_rank", "score", "rank")
    )
