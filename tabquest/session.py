"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every job here relies on.

    Partition counts and memory stay as the cluster sets them; AQE merges small
    shuffle partitions and splits skewed join partitions.
    """
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app_name: str = "tabquest", cores: str = "*") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("TABQUEST_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder on storage that every executor can reach.

    The cluster names the shared folder in ``spark.checkpoint.dir``.  Where that
    is unset, only a local session may fall back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs started within are removed when each ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several later stages need the same derived rows: the result
    survives lost executors and later reads prune columns.  Shuffle files of the
    job go with it: nobody else reads them.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side rows as a table whose size Spark knows, so that it can choose to broadcast it."""
    target = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(target.fields)
    types = to_arrow_schema(target)
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, types)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=types), target)


def batched_by(values: Sequence, n: int) -> Iterator[Sequence]:
    """Slices of at most ``n`` values."""
    return (values[i : i + n] for i in range(0, len(values), n))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before work that is heavy per row.

    Only rows read from fewer files than there are cores are moved, such as one small file; large
    inputs have more and stay where they are.  Looking at the list of files starts no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
