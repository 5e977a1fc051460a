"""Report over the metrics log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabquest.operators.metrics import summary_rows
from tabquest.sources.metrics_log import read_log


def report(spark: SparkSession, log_path: str) -> DataFrame:
    """Summary of the log in long form; a missing log gives zero queries."""
    return summary_rows(read_log(spark, log_path))
