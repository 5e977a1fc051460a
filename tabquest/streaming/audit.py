"""The read-only rules over a stream of SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabquest.operators.audit import audit


def start_audit_stream(queries: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Audit queries as they arrive; stateless, each query is written exactly once."""
    return (
        audit(queries)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
