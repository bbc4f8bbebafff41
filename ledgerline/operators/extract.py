"""Extraction: pending episodes -> candidates -> filters -> gate -> staged claims; what it supersedes and what it proposes to invalidate."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import units
from ..functions.text import blank, collapse, dropped_hedges, headings, hedges, shape
from ..schema import DENIED_SECTIONS

CANDIDATES = "episode_id string, pos int, text string, span string"


def pending(episodes: DataFrame, extracted: DataFrame, version: str) -> DataFrame:
    """Episodes that the cache has not at this version; the version filter stands below the anti join."""
    have = extracted.filter(F.col("extractor_version") == version).select(F.col("episode_id").alias("id"))
    return episodes.join(have, "id", "left_anti")


def atomic(episodes: DataFrame) -> DataFrame:
    """Candidates of the sentence extractor: (episode_id, pos, text, span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, text = [], [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = units(t or "")
                ids += [i] * len(own)
                pos += range(len(own))
                text += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pos, pa.int32()), pa.array(text, pa.string()), pa.array(text, pa.string())], ["episode_id", "pos", "text", "span"])

    return episodes.select("id", "text").mapInArrow(run, CANDIDATES)


def legacy(episodes: DataFrame) -> DataFrame:
    """One candidate an episode: its whole text, with no evidence span."""
    return episodes.select(F.col("id").alias("episode_id"), F.lit(0).alias("pos"), "text", F.lit(None).cast("string").alias("span"))


def denied_section(tags):
    """The first tag that turns a whole episode away, or null."""
    return F.get(F.filter(tags, lambda t: t.isin(*DENIED_SECTIONS)), F.lit(0))


def judged(candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """Candidates with section, shape, and the gate's verdict on those that survive both."""
    # what concerns the whole episode is worked out once, below the join
    t = F.col("text")
    e = episodes.select(F.col("id").alias("episode_id"), collapse(t).alias("body"), headings(t).alias("heads"), hedges(t).alias("marks"), "tags", "source_type", "data_cutoff", "locator")
    c = candidates.join(e, "episode_id").withColumn("section", denied_section(F.col("tags"))).withColumn("shape", shape(F.col("text"), F.col("heads")))
    contained = F.contains("body", collapse(F.col("span")))
    lost = F.size(dropped_hedges(F.col("body"), F.col("marks"), F.col("span"))) > 0
    gate = F.when(F.col("span").isNull() | contained, None).when(lost, "hedge_marker_dropped").otherwise("evidence_not_contained")
    return c.withColumn("gate", F.when(F.col("section").isNull() & F.col("shape").isNull(), gate)).drop("body", "heads", "marks")


def verdicts(judged: DataFrame) -> DataFrame:
    """(episode_id, outcome, reason, staged): an episode is staged as a whole or not at all; the first refusal by position tells why."""
    g = judged.groupBy("episode_id").agg(
        F.max("section").alias("section"),
        F.count("*").alias("n"),
        F.count("shape").alias("shaped"),
        F.min(F.when(F.col("gate").isNotNull(), F.struct("pos", "gate"))).alias("gate"),
        F.min(F.when(F.col("shape").isNotNull(), F.struct("pos", "shape"))).alias("first_shape"),
    )
    outcome = F.when(F.col("section").isNotNull(), "section_filtered").when(F.col("n") == F.col("shaped"), "shape_filtered").when(F.col("gate").isNotNull(), "gate_rejected").otherwise("succeeded")
    reason = F.when(F.col("outcome") == "section_filtered", F.col("section")).when(F.col("outcome") == "shape_filtered", F.col("first_shape.shape")).when(F.col("outcome") == "gate_rejected", F.col("gate.gate"))
    return g.withColumn("outcome", outcome).select("episode_id", "outcome", reason.alias("reason"), F.when(F.col("outcome") == "succeeded", F.col("n") - F.col("shaped")).otherwise(0).alias("staged"), (F.col("outcome") != "gate_rejected").alias("cached"))


def staged(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claim rows of the episodes that passed; the scope is the first tag."""
    ok = verdicts.filter("outcome = 'succeeded'").select("episode_id")
    kept = judged.filter("section IS NULL AND shape IS NULL").join(ok, "episode_id", "left_semi")
    scope = F.coalesce(F.get("tags", F.lit(0)), F.lit("workspace:unscoped"))
    return kept.select("episode_id", "pos", "text", F.lit("staged").alias("status"), scope.alias("scope"), "source_type", "data_cutoff", F.when(F.col("span").isNull(), "unknown").otherwise("span").alias("evidence_kind"), F.col("span").alias("evidence_text"), F.col("locator.value").alias("evidence_locator"))


def superseded(claims: DataFrame, lineage: DataFrame, pending_ids: DataFrame, version: str) -> DataFrame:
    """(claim_key): staged claims on a pending episode without a lineage edge of the new version."""
    touched = lineage.join(pending_ids.select(F.col("id").alias("episode_id")), "episode_id", "left_semi").select("claim_key").distinct()
    new = lineage.filter(F.col("extractor_version") == version).select("claim_key")
    return claims.filter("status = 'staged'").select("claim_key").join(touched, "claim_key", "left_semi").join(new, "claim_key", "left_anti")


def invalidations(active: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(claim_key, causing_episode_id): an active claim (claim_key, episode_id, locator, text) against any candidate of the same episode and locator with another text."""
    a = active.select("claim_key", "episode_id", "locator", collapse(F.col("text")).alias("own"))
    c = candidates.select("episode_id", "locator", collapse(F.col("text")).alias("new")).groupBy("episode_id", "locator").agg(F.min("new").alias("lo"), F.max("new").alias("hi"))
    hit = a.join(c, ["episode_id", "locator"]).filter("lo <> own OR hi <> own").select("claim_key", F.col("episode_id").alias("causing_episode_id")).distinct()
    return hit.join(known.select("claim_key", "causing_episode_id"), ["claim_key", "causing_episode_id"], "left_anti")


def reflection_flags(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("evidence.kind") == "unknown").select("claim_key", F.lit("unknown_evidence").alias("flag"))


def migrated(v1: DataFrame) -> DataFrame:
    """Claims of the first schema with unknown evidence."""
    return v1.withColumn("evidence", F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("locator")))


def usable(candidates: DataFrame) -> DataFrame:
    return candidates.filter(~blank(F.col("text")))
