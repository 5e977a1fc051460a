"""Profile jobs: size, columns, sample and searchable text of every dataset."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions.names import table_name_of
from tabquest.functions.text import dataset_description, embedding_text
from tabquest.session import small_table
from tabquest.sources import metadata as metadata_source
from tabquest.sources.manifest import require_fields, with_defaults
from tabquest.sources.tables import read_csv, schema_for

# One job profiles this many datasets, so that its plan stays small.
DATASETS_PER_JOB = 50


def table_sizes(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """``(file_path, num_rows, num_columns, columns)``, one row per dataset, in one job."""
    counts = [df.select(F.lit(path).alias("file_path"), F.count("*").alias("num_rows")) for path, df in datasets.items()]
    shapes = [(path, len(df.columns), df.columns) for path, df in datasets.items()]
    spark = next(iter(datasets.values())).sparkSession
    known = small_table(spark, shapes, "file_path string, num_columns long, columns array<string>")
    return reduce(DataFrame.union, counts).join(known, "file_path")


def _text_row(df: DataFrame) -> Column:
    names, values = [], []
    for c in df.columns:
        names.append(F.lit(c))
        values.append(F.col(f"`{c}`").cast("string"))
    return F.map_from_arrays(F.array(*names), F.array(*values)).alias("row")


def head_sample(df: DataFrame, order: list[str] | None = None, n: int = fv.DEFAULT_SAMPLE_ROWS) -> DataFrame:
    """First rows with their position: ``(position, row)``, the row as a map of text.

    Spark tables have no row order of their own, so give ``order`` for a stable sample.  Without
    it the first rows of the first split are taken; no other split is read if it has enough.
    """
    if order:
        return df.orderBy(*order).limit(n).select(F.monotonically_increasing_id().alias("position"), _text_row(df))
    head = [(i, r["row"]) for i, r in enumerate(df.select(_text_row(df)).take(n))]
    return small_table(df.sparkSession, head, "position long, row map<string,string>")


def table_samples(
    datasets: Mapping[str, DataFrame],
    order: Mapping[str, list[str]] | None = None,
    n: int = fv.DEFAULT_SAMPLE_ROWS,
) -> DataFrame:
    """``(file_path, sample_rows)``, at most ``n`` rows per dataset."""
    samples = [
        head_sample(df, (order or {}).get(path), n).withColumn("file_path", F.lit(path))
        for path, df in datasets.items()
    ]
    ordered = F.array_sort(F.collect_list(F.struct("position", F.to_json("row").alias("row"))))
    return reduce(DataFrame.unionByName, samples).groupBy("file_path").agg(
        F.transform(ordered, lambda s: F.from_json(s["row"], "map<string,string>")).alias("sample_rows")
    )


def describe(manifest: DataFrame, sizes: DataFrame) -> DataFrame:
    """Manifest entries joined with their dataset's size, description and search text."""
    return (
        with_defaults(manifest)
        .join(sizes, "file_path")
        .withColumn(
            "search_text",
            embedding_text(
                F.col("dataset_name"),
                F.col("source"),
                F.col("domain"),
                F.col("description"),
                F.col("data_interpretation_notes"),
                F.col("columns"),
                F.col("num_rows"),
                F.col("num_columns"),
            ),
        )
        .withColumn(
            "full_description",
            dataset_description(
                F.col("dataset_name"), F.col("description"), F.col("num_rows"), F.col("num_columns")
            ),
        )
        .withColumn("description", F.col("full_description"))
        .withColumnRenamed("search_text", "embedding_text")
        .drop("full_description")
    )


def build_metadata(
    manifest: DataFrame,
    datasets: Mapping[str, DataFrame],
    sample_rows: int = fv.DEFAULT_SAMPLE_ROWS,
    order: Mapping[str, list[str]] | None = None,
) -> DataFrame:
    """The full metadata record of every manifest dataset."""
    described = describe(manifest, table_sizes(datasets))
    samples = table_samples(datasets, order, sample_rows)
    empty = F.array().cast("array<map<string,string>>")
    return described.join(samples, "file_path", "left").select(
        "metadata_path",
        "dataset_name",
        "source",
        "file_path",
        "num_rows",
        "num_columns",
        "columns",
        F.coalesce("sample_rows", empty).alias("sample_rows"),
        "domain",
        "data_interpretation_notes",
        "description",
        "embedding_text",
    )


def refresh_metadata(
    spark: SparkSession,
    manifest: DataFrame,
    folder: str,
    sample_rows: int = fv.DEFAULT_SAMPLE_ROWS,
    force: bool = False,
    schemas: Mapping[str, str] | None = None,
    multiline: bool = True,
) -> int:
    """Profile every dataset that has no stored metadata yet (all of them when ``force``).

    ``schemas`` gives the columns of a dataset by its table name or its file path.
    """
    wanted = require_fields(manifest, ["file_path", "metadata_path"])
    if not force:
        stored = metadata_source.read_written_metadata(spark, folder).select("metadata_path")
        wanted = wanted.join(stored, "metadata_path", "left_anti")
    # One row per dataset: the files to open must be known to plan the scans.
    table = table_name_of(F.col("table_name"), F.col("dataset_name"), F.col("file_path")).alias("table")
    entries = [(r["file_path"], r["table"]) for r in wanted.select("file_path", table).toLocalIterator()]
    tables = dict(entries)
    for group in batched(tables, DATASETS_PER_JOB):
        datasets = {p: read_csv(spark, p, schema_for(schemas, p, tables[p]), multiline) for p in group}
        described = wanted.filter(F.col("file_path").isin(list(group)))
        metadata_source.write_metadata(build_metadata(described, datasets, sample_rows), folder)
    return len(entries)


def sample_cells(df: DataFrame, order: list[str], n: int = fv.DEFAULT_SAMPLE_ROWS) -> DataFrame:
    """Head sample in long form: ``(position, column_name, value)``."""
    return head_sample(df, order, n).select("position", F.explode("row").alias("column_name", "value"))
