"""Ingest: one outcome for every record of a batch, coverage declarations, tombstones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.python import fnv1a, nfc
from ..functions.text import blank

FIELDS = ("text", "locator", "source_type", "data_cutoff", "authority_tier", "tags")


def outcomes(batch: DataFrame, episodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """batch (pos, id, ...) with outcome and reason. A later record of an id in the batch is a duplicate whatever became of the first."""
    b = batch.withColumn("id", nfc("id"))
    b = b.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    held = episodes.select(F.col("id").alias("_id"), F.struct(*FIELDS).alias("_held"))
    b = b.join(tombstones.select(F.col("episode_id").alias("_dead")), F.col("id") == F.col("_dead"), "left").join(held, F.col("id") == F.col("_id"), "left")
    reason = (
        F.when(F.col("_nth") > 1, "duplicate")
        .when(blank(F.col("id")), "missing_id")
        .when(blank(F.col("text")), "missing_text")
        .when(blank(F.col("source_type")), "missing_metadata")
        .when(F.col("_dead").isNotNull(), "deleted_id")
        .when(F.col("_id").isNotNull() & ~F.struct(*FIELDS).eqNullSafe(F.col("_held")), "conflict")
    )
    b = b.withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_id").isNotNull(), "already_persisted").otherwise("persisted")
    return b.withColumn("outcome", outcome).drop("_nth", "_dead", "_id", "_held")


def persisted(classified: DataFrame) -> DataFrame:
    return classified.filter("outcome = 'persisted'").select("id", *FIELDS)


def declared_ids(batch: DataFrame) -> DataFrame:
    """Distinct ids that are not blank, canonical."""
    return batch.select(nfc("id").alias("stable_id")).filter(~blank(F.col("stable_id"))).distinct()


def declaration(batch: DataFrame, today: int, verbatim: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(declaration, ids kept verbatim). The digest is defined as a fold over all ids in order, so one task streams them from a sort that spills; nothing passes through the driver."""
    ids = declared_ids(batch)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0

        def counted() -> Iterator[str]:
            nonlocal count
            for b in batches:
                count += len(b)
                yield from b.column("stable_id").to_pylist()

        run = fnv1a(counted())
        if count:
            yield pa.RecordBatch.from_pydict({"run_id": [run], "declared_count": [count], "created_at_days": [today]})

    d = ids.repartition(1).sortWithinPartitions("stable_id").mapInArrow(folded, "run_id string, declared_count bigint, created_at_days bigint")
    return d, ids.orderBy("stable_id").limit(verbatim).join(F.broadcast(d.select("run_id"))).select("run_id", "stable_id")


def delete_outcomes(wanted: DataFrame, episodes: DataFrame, lineage: DataFrame) -> DataFrame:
    """(id, outcome): episode_not_found, delete_refused where a claim rests on it, else deleted."""
    on = lineage.select(F.col("episode_id").alias("id")).distinct().withColumn("used", F.lit(1))
    w = wanted.select("id").join(episodes.select("id").withColumn("here", F.lit(1)), "id", "left").join(on, "id", "left")
    return w.select("id", F.when(F.col("here").isNull(), "episode_not_found").when(F.col("used").isNotNull(), "delete_refused").otherwise("deleted").alias("outcome"))


def revive_outcomes(wanted: DataFrame, tombstones: DataFrame) -> DataFrame:
    t = tombstones.select(F.col("episode_id").alias("id")).distinct().withColumn("here", F.lit(1))
    return wanted.select("id").join(t, "id", "left").select("id", F.when(F.col("here").isNull(), "revive_refused").otherwise("revived").alias("outcome"))
