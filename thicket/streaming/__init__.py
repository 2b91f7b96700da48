"""Nested queries over streams: each micro-batch of a stream is the base of a query on static tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def each_batch(stream: DataFrame, query: Callable[[DataFrame], object], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands ``query(batch)``'s nested frame, and the batch's number, to ``sink``."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(query(batch).nested_df(), number))
