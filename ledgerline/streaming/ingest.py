"""Continuous ingest: every micro-batch of records goes through the batch classifier and is committed as one snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import FIELDS, outcomes, persisted
from ..sources.store import GraphStore


def into(store: GraphStore, report: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Resubmission of what is persisted changes nothing, so a batch that runs again after a failure is harmless."""

    def run(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.select("id", *FIELDS).withColumn("pos", F.monotonically_increasing_id())
        c = outcomes(numbered, store.read("episodes"), store.read("episode_tombstones"))
        c.persist()
        try:
            store.commit(episodes=persisted(c))
            if report:
                report(c.select("pos", "id", "outcome", "reason"), batch_id)
        finally:
            c.unpersist()

    return run


def start(stream: DataFrame, store: GraphStore, checkpoint: str, report=None):
    return stream.writeStream.foreachBatch(into(store, report)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
