"""Placements as a stream: each micro-batch is one forward plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fluxmesh.subject import Subject


def stream_summaries(subject: Subject, placements: DataFrame, dipoles: DataFrame, rate: float, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "raw", region: str = "all") -> StreamingQuery:
    """Summaries of the placements that arrive, batch by batch, to ``sink(summaries, batch_id)``.

    The mesh tables and the matrix are made once and serve all batches; a batch that is repeated after a failure has
    the same id, so a sink that overwrites by id is exact.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            sink(subject.summarize(subject.simulate(batch, dipoles, rate, mode), region), batch_id)

    return placements.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
