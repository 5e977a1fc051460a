"""Vector records kept as parquet in numbered versions, spread over buckets of their id.

A record has ``record_id``, ``embedding``, ``document`` and the dataset's scalars.  An upsert
writes its batch as a new version, whatever the size of the store, and then commits it with a
small file of its own; what was never committed is not read.  Of a record that several versions
hold, the newest counts.  :func:`compact` writes the current records as a version that earlier
ones need not be read for.  One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabquest.session import materialise, small_table
from tabquest.sources.metadata import path_missing

DEFAULT_BUCKETS = 64
VERSION, BUCKET = "version", "bucket"
COMMIT_SCHEMA = "number long, is_base boolean, key string, buckets int"


def latest_per_key(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row per key; combined within tasks before the shuffle."""
    row = F.struct(*[F.col(c) for c in batch.columns])
    return batch.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, order).alias("r")).select("r.*")


def new_records(batch: DataFrame, existing: DataFrame | None, key: str, force: bool = False) -> DataFrame:
    """The part of a batch that is not stored yet; all of it when ``force``."""
    if force or existing is None:
        return batch
    return batch.join(existing.select(key), key, "left_anti")


def _missing(problem: AnalysisException) -> bool:
    return path_missing(problem) or problem.getCondition() == "UNABLE_TO_INFER_SCHEMA"


def commits(spark: SparkSession, path: str) -> list[Row]:
    """Committed versions that hold the current records, oldest first; one small row for each upsert."""
    try:
        found = spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits").orderBy("number").collect()
    except AnalysisException as problem:
        if not _missing(problem):
            raise
        return []
    base = max((c["number"] for c in found if c["is_base"]), default=0)
    return [c for c in found if c["number"] >= base]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _raw(spark: SparkSession, path: str, live: list[Row]) -> DataFrame:
    """All rows of the given versions; other folders are not looked at."""
    folders = [f"{path}/records/{VERSION}={c['number']}" for c in live]
    return spark.read.option("basePath", f"{path}/records").parquet(*folders)


def _newest(rows: DataFrame, live: list[Row]) -> DataFrame:
    if len(live) == 1:
        return rows.drop(VERSION)
    row = F.struct(*[F.col(c) for c in rows.columns if c != VERSION])
    return rows.groupBy(F.col(live[0]["key"]).alias("_key")).agg(F.max_by(row, VERSION).alias("r")).select("r.*")


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """Current records of the store, or null if nothing was stored yet."""
    live = commits(spark, path)
    return _newest(_raw(spark, path, live), live).drop(BUCKET) if live else None


def lookup(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame | None:
    """Current records with the given ids; only the buckets they fall into are read."""
    live = commits(spark, path)
    if not live:
        return None
    key, buckets = live[0]["key"], live[0]["buckets"]
    wanted = ids.select(key).distinct().withColumn(BUCKET, _bucket(key, buckets))
    touched = [r[BUCKET] for r in wanted.select(BUCKET).distinct().collect()]  # at most `buckets`
    rows = _raw(spark, path, live).filter(F.col(BUCKET).isin(touched))
    return _newest(rows.join(wanted, [BUCKET, key], "left_semi"), live).drop(BUCKET)


def get_records(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Stored records with the given ids."""
    return store.join(ids.select(key).distinct(), key, "left_semi")


def _write_version(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int, is_base: bool) -> None:
    live = commits(spark, path)
    number = live[-1]["number"] + 1 if live else 1
    (
        rows.withColumn(BUCKET, _bucket(key, buckets))
        .hint("rebalance", BUCKET)  # whole buckets per task, large ones split
        .write.mode("overwrite")  # replaces what a failed attempt has left
        .partitionBy(BUCKET)
        .parquet(f"{path}/records/{VERSION}={number}")
    )
    commit = small_table(spark, [(number, is_base, key, buckets)], COMMIT_SCHEMA)
    commit.write.mode("overwrite").parquet(f"{path}/commits/{VERSION}={number}")


def upsert(
    spark: SparkSession, path: str, batch: DataFrame, key: str, order: Column, buckets: int = DEFAULT_BUCKETS
) -> None:
    """Insert or replace records by key; of repeats in the batch the last one stays.

    Nothing that is stored is read or rewritten.  ``buckets`` is fixed by a store's first version;
    more buckets mean that a lookup reads less.  An empty batch leaves the store as it is.
    """
    latest = materialise(latest_per_key(batch, key, order), "upsert")
    if not latest.isEmpty():
        live = commits(spark, path)
        _write_version(spark, path, latest, key, live[0]["buckets"] if live else buckets, is_base=False)


def compact(spark: SparkSession, path: str) -> None:
    """Write the current records as one version, so that reads no longer merge earlier ones."""
    live = commits(spark, path)
    if len(live) > 1:
        _write_version(spark, path, read_store(spark, path), live[0]["key"], live[0]["buckets"], is_base=True)
