"""Bounded, lineage-checked, scoped and ranked search, and what it tells of coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_from_iso, iso_from_days, stale


def walk(claims: DataFrame, budget: int | None) -> DataFrame:
    """The claims that a budget visits: the first by key, matching or not. The limit stands below every filter."""
    return claims if budget is None else claims.orderBy("claim_key").limit(budget)


def supported(claims: DataFrame, lineage: DataFrame, episodes: DataFrame) -> DataFrame:
    """Claims that rest on a persisted episode, with tier, cutoff, tags and episodes in the order of lineage rows."""
    e = episodes.select(F.col("id").alias("episode_id"), "authority_tier", "data_cutoff", "tags")
    on = lineage.select("seq", "claim_key", "episode_id").join(claims.select("claim_key"), "claim_key", "left_semi").join(e, "episode_id")
    days = days_from_iso(F.col("data_cutoff"))
    g = on.groupBy("claim_key").agg(
        F.min("authority_tier").alias("authority_tier"),
        F.max(days).alias("cutoff_days"),
        F.min(F.when(F.col("data_cutoff").isNotNull(), F.struct("seq", "data_cutoff"))).alias("raw"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "episode_id"))), lambda x: x["episode_id"]).alias("episodes"),
        F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"),
    )
    cut = F.coalesce(iso_from_days(F.col("cutoff_days")), F.col("raw.data_cutoff"))
    return claims.join(g.withColumn("cutoff", cut).drop("raw"), "claim_key")


def search(claims: DataFrame, lineage: DataFrame, episodes: DataFrame, pattern: str, *, budget: int | None = 256, scope: list[str] | None = None, as_of: int, window: int = 365) -> DataFrame:
    """Hits by rank: fresh before stale, better tier, later cutoff, smaller key. scope None is unfiltered, an empty one matches nothing."""
    seen = walk(claims, budget).filter(F.contains(F.lower("text"), F.lit(pattern.lower())))
    hits = supported(seen, lineage, episodes)
    if scope is not None:
        hits = hits.filter(F.arrays_overlap("tags", F.array(*map(F.lit, scope)))) if scope else hits.filter(F.lit(False))
    hits = hits.withColumn("stale", stale(F.col("cutoff_days"), as_of, window))
    return hits.select("claim_key", "text", "status", "authority_tier", "cutoff", "cutoff_days", "stale", F.array_join("episodes", ",").alias("episodes"))



def rank_order() -> list:
    return [F.col("stale"), F.col("authority_tier"), F.desc_nulls_last("cutoff_days"), F.col("claim_key")]


def ranked(hits: DataFrame, most: int | None = None) -> DataFrame:
    """Hits in rank order with their rank; the window stands over what a budget has bounded."""
    h = hits if most is None else hits.orderBy(*rank_order()).limit(most)
    return h.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())).cast("bigint"))


def truncated(claims: DataFrame, budget: int) -> DataFrame:
    """One row: claims walked, and whether some were not."""
    n = claims.agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(budget)).cast("bigint").alias("walked"), F.when(F.col("n") > budget, "budget-exhausted").otherwise("complete").alias("status"))


def ingest_coverage(declared: DataFrame, declarations: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row (declared, persisted): distinct declared ids with the tails that were not kept, and those that were persisted."""
    ids = declared.select("stable_id").distinct()
    kept = declared.groupBy("run_id").agg(F.count("*").alias("kept"))
    tail = declarations.join(kept, "run_id", "left").agg(F.coalesce(F.sum(F.greatest(F.col("declared_count") - F.coalesce("kept", F.lit(0)), F.lit(0))), F.lit(0)).alias("tail"))
    flagged = ids.join(episodes.select(F.col("id").alias("stable_id"), F.lit(1).alias("here")), "stable_id", "left").agg(F.count("*").alias("n"), F.count("here").alias("persisted"))
    return flagged.join(F.broadcast(tail)).select((F.col("n") + F.col("tail")).alias("declared"), "persisted")


def dead_extractions(claims: DataFrame, lineage: DataFrame, supersessions: DataFrame) -> DataFrame:
    """(episode_id, extractor_version) whose claims there are all rejected and superseded."""
    gone = claims.join(supersessions.select("claim_key").distinct().withColumn("superseded", F.lit(True)), "claim_key", "left")
    dead = (F.col("status") == "rejected") & F.coalesce("superseded", F.lit(False))
    return lineage.join(gone.select("claim_key", dead.alias("dead")), "claim_key").groupBy("episode_id", "extractor_version").agg(F.min("dead").alias("all_dead")).filter("all_dead").select("episode_id", "extractor_version")


def extraction_coverage(episodes: DataFrame, extracted: DataFrame, dead: DataFrame) -> DataFrame:
    """One row (gaps, total): episodes without a live extraction. Two plain anti joins."""
    live = extracted.join(dead, ["episode_id", "extractor_version"], "left_anti").select("episode_id").distinct()
    both = episodes.select(F.col("id").alias("episode_id")).join(live.withColumn("ok", F.lit(1)), "episode_id", "left")
    return both.agg(F.count(F.when(F.col("ok").isNull(), 1)).alias("gaps"), F.count("*").alias("total"))


def contradictions(edges: DataFrame, invalidations: DataFrame, claims: DataFrame, lineage: DataFrame, episodes: DataFrame, keys: list[int], budget: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, staged invalidations, status) that touch some keys, under one budget: edges first, then proposals."""
    n = edges.agg(F.count("*").alias("n_edges")).join(F.broadcast(invalidations.agg(F.count("*").alias("n_props"))))
    status = n.select(F.when(F.col("n_edges") + F.col("n_props") > budget, "budget-exhausted").otherwise("complete").alias("status"))
    row = edges.limit(budget + 1).count()  # bounded by the budget
    sides = supported(claims, lineage, episodes).select("claim_key", "text", "status", F.array_join("episodes", ",").alias("episodes"))
    touched = edges.orderBy("seq").limit(budget).filter((F.col("label") == "contradicts") & (F.col("from_claim").isin(keys) | F.col("to_claim").isin(keys)))
    side = lambda p: sides.select(*[F.col(c).alias(f"{p}_{c}") for c in sides.columns])
    pairs = touched.join(side("from"), F.col("from_claim") == F.col("from_claim_key")).join(side("to"), F.col("to_claim") == F.col("to_claim_key")).select("from_claim", "to_claim", "from_text", "to_text", "from_status", "to_status", "from_episodes", "to_episodes")
    left = max(0, budget - row) if row <= budget else 0
    props = invalidations.orderBy("seq").limit(left).filter(F.col("claim_key").isin(keys)).join(sides, "claim_key").select("claim_key", "text", "status", "episodes", "causing_episode_id")
    return pairs, props, status
