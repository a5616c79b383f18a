"""The batch scoring transform on a stream of records (R2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortry.session import scratch


def score_stream(records: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Stateless column transforms: straight from source to parquet, exactly once."""
    return (transform(records).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def score_stream_batches(records: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Full scoring with a donor search, per micro-batch; ``score`` gives one table with a ``status`` of each record.

    A micro-batch is one write, into a folder of its own number, so a batch that is run again replaces its rows; scored and rejected
    records lie in folders of their status. What a batch stages is deleted with it; the fitted state is used again.
    """
    def handle(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            score(batch).write.mode("overwrite").partitionBy("status").parquet(f"{out}/batch={number}")

    return (records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
