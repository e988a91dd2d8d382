"""Streams of clones matched against a fixed table: stateless, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clonespark.operators.distance import distance_join


def join_stream(stream: DataFrame, references: DataFrame, radius: float, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, available_now: bool = True, **options) -> StreamingQuery:
    """Start a query that gives each micro-batch's distance join with references to sink(matches, batch).

    The stream must carry the index column that the join names rows by. With a checkpoint folder a
    restarted query goes on after the last batch whose sink returned.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(distance_join(batch, references, radius, **options), number)

    writer = stream.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
