"""Streams around the batch operators.

The engine's queries are batch queries; a stream of new documents runs them on
each micro-batch, with the sink's own exactly-once rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def per_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply ``plan`` to each micro-batch and write it under ``target/batch=n``.

    A batch that is run again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sentence_stream(stream: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sentences of a stream of documents: stateless, so it needs no batches."""
    from docloom.operators.segments import sentence_table

    return sentence_table(stream, keys, text)
