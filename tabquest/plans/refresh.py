"""Refresh everything derived from a manifest: metadata, embeddings, tables.

What has to be refreshed is decided by content: a digest of every dataset's lines is kept beside its
metadata and compared with that of the files as they are now.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabquest import fixed_values as fv
from tabquest.functions.vectors import Encoder
from tabquest.plans.embed import refresh_embeddings
from tabquest.plans.profile import DATASETS_PER_JOB, refresh_metadata
from tabquest.session import batched_by, materialise
from tabquest.sources.manifest import filter_manifest, read_manifest, require_fields
from tabquest.sources.metadata import path_missing, read_written_metadata
from tabquest.sources.tables import import_manifest


def refresh_assets(
    spark: SparkSession,
    manifest_path: str,
    metadata_folder: str,
    store_path: str,
    dataset_names: Iterable[str] | None = None,
    sample_rows: int = fv.DEFAULT_SAMPLE_ROWS,
    skip_metadata: bool = False,
    skip_embeddings: bool = False,
    skip_tables: bool = False,
    force: bool = False,
    table_location: str | None = None,
    schemas: Mapping[str, str] | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
    multiline: bool = True,
) -> list[str]:
    """Run the wanted steps in order; each skips what exists unless ``force``.

    ``schemas`` gives the columns of a dataset by table name or file path, for profile and import alike.
    """
    manifest = filter_manifest(read_manifest(spark, manifest_path), dataset_names)
    if manifest.isEmpty():
        return ["No matching datasets found in the manifest."]
    messages = []
    if not skip_metadata:
        done = refresh_metadata(spark, manifest, metadata_folder, sample_rows, force, schemas, multiline)
        messages.append(f"Generated metadata: {done}")
    if not skip_embeddings:
        metadata = read_written_metadata(spark, metadata_folder)
        refresh_embeddings(spark, metadata, manifest, store_path, force, make_encoder)
        messages.append("Embeddings are up to date")
    if not skip_tables:
        messages += import_manifest(spark, manifest, force, schemas, table_location, multiline)
    return messages


# ---- what has changed ----------------------------------------------------------

DIGEST_SCHEMA = "file_path string, n_lines long, digest string"


def folder_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(file_path, value)``: every line below ``folder`` with the dataset (sub-folder) that holds it."""
    base = folder.rstrip("/")
    raw = spark.read.option("recursiveFileLookup", True).text(base)
    relative = F.substring_index(F.col("_metadata.file_path"), f"{base}/", -1)
    return raw.select(F.regexp_replace(relative, "/?[^/]*$", "").alias("file_path"), "value")


def content_digests(lines: DataFrame) -> DataFrame:
    """``(file_path, n_lines, digest)`` of every dataset with a line.

    The digest is the number of lines and two sums of their hashes: files are split among tasks, however
    large one is, and sums are combined before they are shuffled.  The order of lines, like that of a
    table's rows, does not count; a line more, less or twice does.
    """
    line = F.coalesce("value", F.lit(""))
    sums = [F.sum(F.xxhash64(F.lit(seed), line).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return lines.groupBy("file_path").agg(
        F.count("*").alias("n_lines"), F.concat_ws(":", F.count("*").cast("string"), *sums).alias("digest")
    )


def dataset_digests(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Digests of the given files or folders; one without lines has no lines and an empty digest."""
    parts = []
    for group in batched_by(sorted(set(paths)), DATASETS_PER_JOB):
        lines = [spark.read.text(p).select(F.lit(p).alias("file_path"), "value") for p in group]
        known = spark.createDataFrame([(p,) for p in group], "file_path string")
        found = known.join(content_digests(reduce(DataFrame.unionByName, lines)), "file_path", "left")
        parts.append(materialise(found.na.fill(0, ["n_lines"]).na.fill("", ["digest"]), "digests"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], DIGEST_SCHEMA)


def refresh_plan(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``(file_path, status, lines_before, lines_after, digest)``: new, changed, unchanged or removed.

    Stored rows with a null digest stand for datasets that were removed before.
    """
    before = stored.where("digest IS NOT NULL").alias("b")
    joined = current.alias("a").join(before, F.col("a.file_path") == F.col("b.file_path"), "full_outer")
    status = (
        F.when(F.col("b.digest").isNull(), "new")
        .when(F.col("a.digest").isNull(), "removed")
        .when(F.col("a.digest") == F.col("b.digest"), "unchanged")
        .otherwise("changed")
    )
    return joined.select(
        F.coalesce("a.file_path", "b.file_path").alias("file_path"),
        status.alias("status"),
        F.col("b.n_lines").alias("lines_before"),
        F.col("a.n_lines").alias("lines_after"),
        F.col("a.digest").alias("digest"),
    )


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Stored digests; none where nothing was stored yet."""
    try:
        return spark.read.schema(DIGEST_SCHEMA).parquet(folder).select("file_path", "n_lines", "digest")
    except AnalysisException as problem:
        if not path_missing(problem):
            raise
        return spark.createDataFrame([], DIGEST_SCHEMA)


def write_digests(plan: DataFrame, folder: str) -> None:
    """Replace the digests of all but unchanged datasets, each in a folder of its own; removed ones get a null."""
    rows = plan.where("status <> 'unchanged'").select("file_path", F.col("lines_after").alias("n_lines"), "digest")
    placed = rows.withColumn("record", F.sha1("file_path"))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("record").parquet(folder)


def refresh_changed(
    spark: SparkSession,
    manifest: DataFrame,
    metadata_folder: str,
    digest_folder: str,
    sample_rows: int = fv.DEFAULT_SAMPLE_ROWS,
    schemas: Mapping[str, str] | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Profile the datasets of the manifest that are new or changed, and return the plan.

    Unchanged files are read for their digest only.  Digests are stored last, so a run that is cut off is
    repeated.  Datasets that left the manifest are reported once; their metadata stays.
    """
    entries = require_fields(manifest, ["file_path", "metadata_path"])
    paths = [r["file_path"] for r in entries.select("file_path").distinct().toLocalIterator()]
    plan = materialise(refresh_plan(dataset_digests(spark, paths), read_digests(spark, digest_folder)), "refresh-plan")
    stale = entries.join(plan.where("status IN ('new', 'changed')").select("file_path"), "file_path", "left_semi")
    refresh_metadata(spark, stale, metadata_folder, sample_rows, True, schemas, multiline)
    write_digests(plan, digest_folder)
    return plan
