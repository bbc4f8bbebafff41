"""Human decisions and derived states over append-only events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import queue_age
from ..functions.text import collapse


def adopt(wanted: DataFrame, claims: DataFrame) -> DataFrame:
    """wanted (pos, claim_key) -> outcome: a batch adopts staged claims up to its first refusal; later ones are not tried.

    The first refusal is one aggregate, so no window runs over the batch. A key that comes twice is not staged any more the second time."""
    again = F.row_number().over(Window.partitionBy("claim_key").orderBy("pos")) > 1
    w = wanted.withColumn("again", again).join(claims.select("claim_key", "status"), "claim_key", "left")
    w = w.withColumn("ok", F.coalesce(F.col("status") == "staged", F.lit(False)) & ~F.col("again"))
    stop = w.filter("NOT ok").agg(F.min("pos").alias("stop"))
    return w.join(F.broadcast(stop)).select("pos", "claim_key", F.when(F.col("stop").isNull() | (F.col("pos") < F.col("stop")), "adopted").when(F.col("pos") == F.col("stop"), "refused").otherwise("not_tried").alias("outcome"))


def restage(wanted: DataFrame, claims: DataFrame, supersessions: DataFrame) -> DataFrame:
    """Rejected claims with a supersession come back as staged."""
    s = supersessions.select("claim_key").distinct().withColumn("gone", F.lit(True))
    j = wanted.join(claims.select("claim_key", "status"), "claim_key", "left").join(s, "claim_key", "left")
    return j.select("claim_key", F.when((F.col("status") == "rejected") & F.coalesce("gone", F.lit(False)), "restaged").otherwise("refused").alias("outcome"))


def statuses(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Current status: the last event (seq, claim_key, status), or the initial one."""
    last = events.groupBy("claim_key").agg(F.max_by("status", "seq").alias("now"))
    return claims.join(last, "claim_key", "left").withColumn("status", F.coalesce("now", "status")).drop("now")


def queue(reviews: DataFrame, lineage: DataFrame, as_of: int) -> DataFrame:
    """Open reviews with their age and the number of lineage rows on each side."""
    n = lineage.groupBy("claim_key").agg(F.count("*").alias("n"))
    side = lambda p: n.select(F.col("claim_key").alias(f"{p}_claim"), F.col("n").alias(f"{p}_episodes"))
    j = reviews.filter("status = 'proposed'").join(side("from"), "from_claim", "left").join(side("to"), "to_claim", "left")
    return j.select("seq", "from_claim", "to_claim", "evidence", queue_age(F.col("queued_at"), as_of).alias("age"), F.coalesce("from_episodes", F.lit(0)).alias("from_episodes"), F.coalesce("to_episodes", F.lit(0)).alias("to_episodes"))


def open_proposals(proposals: DataFrame) -> DataFrame:
    return proposals.filter("status = 'proposed'").orderBy("queued_at", "seq")


def merge_lineage(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """Lineage rows that approving (from_claim, to_claim) adds to from: those of to that it has not. The absorbed claim stays."""
    src = pairs.join(lineage, F.col("to_claim") == F.col("claim_key")).select(F.col("from_claim").alias("claim_key"), "episode_id", "extractor_version").distinct()
    return src.join(lineage.select("claim_key", "episode_id", "extractor_version"), ["claim_key", "episode_id", "extractor_version"], "left_anti")


def resolved(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (from_claim, to_claim, decision, actor) against open rows of the unordered pair: outcome and the row that they close."""
    pair = lambda df: df.withColumn("lo", F.least("from_claim", "to_claim")).withColumn("hi", F.greatest("from_claim", "to_claim"))
    o = pair(reviews.filter("status = 'proposed'")).groupBy("lo", "hi").agg(F.min("seq").alias("seq"))
    d = pair(decisions).join(o, ["lo", "hi"], "left")
    return d.select("from_claim", "to_claim", "seq", F.when(F.col("seq").isNull() | (F.trim("actor") == ""), "refused").otherwise(F.concat(F.lit("resolved_"), "decision")).alias("outcome"))


def approved_edges(proposals: DataFrame, actor: str, at: int) -> DataFrame:
    """Edges that approving contradiction proposals makes, in the stored orientation, with provenance."""
    made = F.to_json(F.struct(F.col("producer"), F.lit(actor).alias("approved_by"), F.lit(at).alias("at")))
    return proposals.select("from_claim", F.lit("contradicts").alias("label"), "to_claim", made.alias("provenance"))


def new_edges(wanted: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """wanted (from_claim, label, to_claim) -> outcome: unknown_claim, duplicate_edge or inserted."""
    c = claims.select("claim_key")
    has = lambda p: c.select(F.col("claim_key").alias(f"{p}_claim"), F.lit(1).alias(f"{p}_here"))
    known = edges.select("from_claim", "label", "to_claim").distinct().withColumn("known", F.lit(1))
    j = wanted.distinct().join(has("from"), "from_claim", "left").join(has("to"), "to_claim", "left").join(known, ["from_claim", "label", "to_claim"], "left")
    return j.select("from_claim", "label", "to_claim", F.when(F.col("from_here").isNull() | F.col("to_here").isNull(), "unknown_claim").when(F.col("known").isNotNull(), "duplicate_edge").otherwise("inserted").alias("outcome"))


def evidence_states(claims: DataFrame, lineage: DataFrame, episodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(claim_key, episode_id, state) by the first lineage row's episode: tombstoned, missing, unknown, or contained."""
    first = lineage.groupBy("claim_key").agg(F.min_by("episode_id", "seq").alias("episode_id"))
    t = tombstones.select("episode_id").distinct().withColumn("dead", F.lit(1))
    e = episodes.select(F.col("id").alias("episode_id"), collapse(F.col("text")).alias("body"), "authority_tier")
    j = claims.join(first, "claim_key", "left").join(t, "episode_id", "left").join(e, "episode_id", "left")
    ok = F.coalesce(F.contains("body", collapse(F.col("span"))), F.lit(False))
    state = F.when(F.col("dead").isNotNull(), "tombstoned").when(F.col("body").isNull() | F.col("span").isNull() | ~ok, "unresolvable").otherwise("resolved")
    return j.select("claim_key", "episode_id", state.alias("state"), F.col("authority_tier").alias("observed_tier"))


def identity_report(claims: DataFrame, lineage: DataFrame, supersessions: DataFrame, invalidations: DataFrame) -> DataFrame:
    """One row a claim: lineage in row order, supersessions and invalidations, each aggregated before it is joined."""
    rows = lambda df, v, name: df.groupBy("claim_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(v).alias("v")))), lambda x: x["v"]), ",").alias(name))
    j = claims.select("claim_key", "status").join(rows(lineage, "episode_id", "episodes"), "claim_key", "left")
    j = j.join(supersessions.groupBy("claim_key").agg(F.count("*").alias("supersessions")), "claim_key", "left").join(rows(invalidations, "causing_episode_id", "causes"), "claim_key", "left")
    return j.select("claim_key", "status", F.coalesce("episodes", F.lit("")).alias("episodes"), F.coalesce("supersessions", F.lit(0)).alias("supersessions"), F.coalesce("causes", F.lit("")).alias("causes"))
