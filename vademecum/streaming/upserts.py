"""The load of a vector table as a stream: every micro-batch of chunks is merged without pruning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vademecum.sources.vector_table import VectorTable


def stream_into(chunks: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the stream. A batch that is delivered again is known by its number in the table's log, under the name of
    the stream's checkpoint, and neither read nor compared with the table."""

    def merge(batch: DataFrame, number: int) -> None:
        VectorTable(batch.sparkSession, path).load(batch, embed, prune=False, batch=(checkpoint, number))

    writer = chunks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
