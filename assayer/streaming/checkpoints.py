"""Scoring that writes its rows while it runs and resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_checkpointed(
    prompts: DataFrame, score: Callable[[DataFrame], DataFrame], table: str, checkpoint: str
) -> StreamingQuery:
    """Apply ``score`` to every micro-batch of ``prompts`` and keep its rows.

    The rows of a batch replace the partition of that batch, so a batch that is run again
    after a failure leaves no duplicates; started anew with the same ``checkpoint``, the
    stream goes on behind the last finished batch.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        # The folder of the batch itself, so that a replay without rows leaves none behind.
        score(batch).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        prompts.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(flush)
        .start()
    )
