"""Query batches that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from postlane.operators.intersect import and_division


def answer(stream: DataFrame, postings: DataFrame, sink: Callable[[DataFrame, int], None], strategy=and_division) -> DataStreamWriter:
    """A writer that answers each micro-batch of (query_id, ord, term_id) rows against a static index.

    A query's rows must arrive in one micro-batch. `sink(results, batch_id)`
    should be idempotent per batch_id: a batch may be repeated after a failure.
    """

    def batch(queries: DataFrame, batch_id: int) -> None:
        sink(strategy(postings, queries), batch_id)

    return stream.writeStream.foreachBatch(batch)
