"""A stream of left rows against a table: each micro-batch is one as-of join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from timeweave.operators.asof import asof_join


def enriched(stream: DataFrame, right: Callable[[], DataFrame] | DataFrame, sink: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """A writer that gives ``sink`` every batch joined with ``right``.

    A function in place of a table is called for every batch, so the feed may
    grow between batches.  Left rows are matched with what the feed has when
    their batch runs; ``options`` go to :func:`asof_join`.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(asof_join(batch, right() if callable(right) else right, **options), number)

    return stream.writeStream.foreachBatch(run)
