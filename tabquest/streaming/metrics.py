"""Incremental summaries of the metrics log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabquest.operators.metrics import group_records, summary_from_groups

BATCH, ROWS = "batch_id", "batch_rows"
SLOTS = 4


def _write_state(path: str):
    """Sink for a small complete state: each batch replaces one of a few slots.

    Every row tells its batch and how many rows the batch has, so a reader can tell a whole
    slot from one that is being replaced.  A batch that runs again after a failure replaces
    its own slot, and readers meanwhile find the one before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            stamped = rows.withColumns({BATCH: F.lit(batch_id).cast("long"), ROWS: F.lit(rows.count())})
            stamped.write.mode("overwrite").parquet(f"{path}/slot={batch_id % SLOTS}")
        finally:
            rows.unpersist()

    return write


def _newest_state(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest slot that is whole."""
    slots = spark.read.parquet(path)
    whole = slots.groupBy(BATCH).agg(F.count("*").alias("n"), F.max(ROWS).alias("m")).where("n = m")
    newest = whole.select(F.max(BATCH)).first()[0]
    return slots.filter(F.col(BATCH) == newest).drop("slot", BATCH, ROWS)


def start_group_stream(records: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the partial results per status and mode up to date.

    The state holds one row per group, whatever the length of the log.
    """
    return (
        group_records(records)
        .writeStream.outputMode("complete")
        .foreachBatch(_write_state(out_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_summary(spark: SparkSession, out_path: str) -> DataFrame:
    """Current summary; equals the batch summary of the same log."""
    return summary_from_groups(_newest_state(spark, out_path))


def start_daily_stream(records: DataFrame, out_path: str, checkpoint: str, time_col: str = "recorded_at") -> StreamingQuery:
    """Runs, successes and milliseconds per UTC day and status.

    The state is one row per day and status and is kept for good, so no record is too late.
    """
    daily = (
        records.groupBy(F.window(time_col, "1 day").alias("w"), "status")
        .agg(
            F.count("*").alias("query_count"),
            F.count_if(F.col("execution_success")).alias("executed_count"),
            # Whole thousandths, so that the sum does not depend on the order of arrival.
            F.sum(F.round(F.col("ms_total") * 1000).cast("long")).alias("sum_thousandths"),
            F.count("ms_total").alias("timed_count"),
        )
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "status", "query_count",
                "executed_count", "sum_thousandths", "timed_count")
    )
    return (
        daily.writeStream.outputMode("complete")
        .foreachBatch(_write_state(out_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_daily(spark: SparkSession, out_path: str) -> DataFrame:
    mean = F.round(F.col("sum_thousandths") / 1000.0 / F.nullif(F.col("timed_count"), F.lit(0)), 3)
    return _newest_state(spark, out_path).select(
        "day", "status", "query_count", "executed_count", mean.alias("average_total_ms")
    )
