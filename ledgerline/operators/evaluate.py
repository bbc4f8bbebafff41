"""Precision, recall and hedge preservation of a run against golden claims."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, content_form, headings, hedges, shape

JUDGED = "candidate bigint, episode_id string, reason string, golden bigint"


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (episode, form), golden ones first, each side by position: golden claims are taken in order by candidates that keep their hedges.

    Only the open golden claims of one form are held at a time."""
    key, free = None, deque()
    for batch in batches:
        out: list[tuple] = []
        for episode, form, golden, pos, hedges, contained in zip(*(batch.column(c).to_pylist() for c in ("episode_id", "form", "golden", "pos", "hedges", "contained")), strict=True):
            if (episode, form) != key:
                key, free = (episode, form), deque()
            if golden:
                free.append((pos, set(hedges)))
            elif not free:
                out.append((pos, episode, "spurious", None))
            elif not contained:
                out.append((pos, episode, "content-miss", None))
            elif free[0][1] <= set(hedges):
                out.append((pos, episode, "matched", free.popleft()[0]))
            else:
                out.append((pos, episode, "hedge-dropped", None))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["candidate", "episode_id", "reason", "golden"])


def judgments(candidates: DataFrame, golden: DataFrame, episodes: DataFrame) -> DataFrame:
    """candidates (pos, episode_id, text, span), golden (pos, episode_id, text, hedges), episodes (id, text).

    A candidate meets the first open golden claim of its content form, so each (episode, form) is settled by itself and no larger group is gathered."""
    known = candidates.join(episodes.select(F.col("id").alias("episode_id"), collapse(F.col("text")).alias("_body")), "episode_id", "left")
    c = known.select("episode_id", content_form(F.col("text")).alias("form"), F.lit(False).alias("golden"), "pos", hedges(F.col("text")).alias("hedges"), F.coalesce(F.contains("_body", collapse(F.col("span"))), F.lit(False)).alias("contained"), F.col("_body").isNotNull().alias("known"))
    g = golden.select("episode_id", content_form(F.col("text")).alias("form"), F.lit(True).alias("golden"), "pos", "hedges", F.lit(True).alias("contained"), F.lit(True).alias("known"))
    rows = c.union(g).filter("known").repartition("episode_id", "form").sortWithinPartitions("episode_id", "form", F.desc("golden"), "pos")
    return rows.mapInArrow(_greedy, JUDGED).union(c.filter("NOT known").select("pos", "episode_id", F.lit("spurious"), F.lit(None).cast("bigint")))


def metrics(judged: DataFrame, golden: DataFrame) -> DataFrame:
    """One row of counts and ratios; a ratio over nothing is null and named in unknown_metrics."""
    g = golden.agg(F.count("*").alias("golden"), F.count(F.when(F.size("hedges") > 0, 1)).alias("hedged"))
    kept = judged.filter("reason = 'matched'").join(golden.filter(F.size("hedges") > 0).select("episode_id", F.col("pos").alias("golden")), ["episode_id", "golden"], "left_semi").agg(F.count("*").alias("preserved"))
    n = judged.agg(*[F.count(F.when(F.col("reason") == r, 1)).alias(r.replace("-", "_")) for r in ("matched", "content-miss", "spurious", "hedge-dropped")], F.count("*").alias("emitted"))
    j = n.join(F.broadcast(g)).join(F.broadcast(kept))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    unknown = F.array_compact(F.array(*[F.when(F.col(c) == 0, name) for c, name in (("emitted", "precision"), ("golden", "recall"), ("hedged", "hedge_preservation"))]))
    return j.select("emitted", "golden", "matched", "content_miss", "spurious", "hedge_dropped", ratio("matched", "emitted").alias("precision"), ratio("matched", "golden").alias("recall"), ratio("preserved", "hedged").alias("hedge_preservation"), F.array_join(unknown, ",").alias("unknown_metrics"))


def post_pass(candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """Candidates without those that a live extraction's shape rules would drop; headings are the episode's, none where it is unknown."""
    e = episodes.select(F.col("id").alias("episode_id"), headings(F.col("text")).alias("_heads"))
    heads = F.coalesce("_heads", F.array().cast("array<string>"))
    return candidates.join(e, "episode_id", "left").filter(shape(F.col("text"), heads).isNull()).select(candidates.columns)


def results_row(corpus: str, version: str, m: dict) -> str:
    """The Markdown row of a results table: ratios with three decimals, `unknown` for those over nothing; the date is for whoever appends it."""
    ratio = " | ".join("unknown" if m[k] is None else f"{m[k]:.3f}" for k in ("precision", "recall", "hedge_preservation"))
    counts = " ".join(f"{k.replace('_', '-')}={m[k]}" for k in ("emitted", "matched", "golden", "content_miss", "spurious", "hedge_dropped"))
    return f"| (date) | {corpus} | {version} | {ratio} | {counts} |"


def live_candidates(claims: DataFrame, lineage: DataFrame, version: str) -> DataFrame:
    """Staged and active claims with a lineage row of a version: what a run's manifest holds."""
    return claims.filter("status IN ('staged', 'active')").join(lineage.filter(F.col("extractor_version") == version).select("claim_key", "episode_id"), "claim_key")
