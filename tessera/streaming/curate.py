"""Selection on a stream: each micro-batch is cut into super-batches and selected on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.curation import batches, select


def curate_stream(samples: DataFrame, sink: Callable[[DataFrame, int], None], size: int, checkpoint: str, mode: str = "fm") -> StreamingQuery:
    """Runs `mode` on whole super-batches of `size` samples (columns idx, classes) of every micro-batch and hands the chosen rows to sink."""

    def one(rows: DataFrame, number: int) -> None:
        grouped = batches(rows, ["idx"], size).withColumnRenamed("batch", "sb")
        sink(select(grouped, mode), number)

    return samples.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).trigger(availableNow=True).start()
