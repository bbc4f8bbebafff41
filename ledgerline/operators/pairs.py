"""Passes over ranked claims: duplicates (equal, contained, alias) and closed-form contradictions, under one budget of pairs.

Each phase is a blocked equi-join of the ranked hits; the order in which pairs are examined is a sort key, and the budget is an ordered
limit over narrow rows (phase, key, ranks). Only then are texts joined on. Hits are bounded by the walk's budget, and so is what an
equal group can hold. Without a budget the `*_classes` functions do the whole corpus: a row for each member of a group, or pairs between
representatives of distinct texts, so that no group is expanded into all of its pairs and nothing is ranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grams, has_negation, masked, normalize, numeral, stripped, tokens
from . import substrings


def _sides(hits: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    return tuple(hits.select(*[F.col(c).alias(f"{p}_{c}") for c in ("rank", "claim_key", *cols)]) for p in "ab")


def _first(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy(key).agg(F.min("rank").alias("first"), F.count("*").alias("n")).filter("n > 1").select(key, "first")


def _grouped(hits: DataFrame, key: str, *cols: str) -> DataFrame:
    """All pairs a, b within groups of equal key."""
    h = hits.join(_first(hits, key), key)
    a, b = (h.select(F.col(key), F.col("first"), *[F.col(c).alias(f"{p}_{c}") for c in ("rank", "claim_key", *cols)]) for p in "ab")
    return a.join(b.drop("first"), key)


def _row(phase: int, k1: Column, k2: Column, k3: Column, rule: str, hit: Column, frm: Column, to: Column) -> list[Column]:
    return [F.lit(phase).alias("phase"), k1.cast("bigint").alias("k1"), k2.cast("bigint").alias("k2"), k3.cast("bigint").alias("k3"), F.lit(rule).alias("rule"), hit.alias("hit"), frm.alias("from_claim"), to.alias("to_claim")]


def scan_pairs(hits: DataFrame) -> DataFrame:
    """Pairs that the contradiction scan examines, in (phase, k1, k2, k3) order; hit tells which it proposes."""
    h = hits.withColumn("norm", normalize(F.col("text"))).withColumn("neg", has_negation(F.col("norm"))).withColumn("strip", stripped(F.col("norm"))).withColumn("mask", masked(F.col("norm")))
    low, high = F.least("a_claim_key", "b_claim_key"), F.greatest("a_claim_key", "b_claim_key")
    n = _grouped(h.select("rank", "claim_key", "neg", "strip"), "strip", "neg").filter("a_neg AND NOT b_neg").select(*_row(1, F.col("first"), F.col("a_rank"), F.col("b_rank"), "negation-marker", F.lit(True), low, high))
    apart = F.filter(F.arrays_zip(tokens(F.col("a_norm")).alias("x"), tokens(F.col("b_norm")).alias("y")), lambda p: p["x"] != p["y"])
    one = (F.size(apart) == 1) & F.coalesce(numeral(F.get(apart, F.lit(0))["x"]) & numeral(F.get(apart, F.lit(0))["y"]), F.lit(False))
    m = _grouped(h.select("rank", "claim_key", "norm", "mask"), "mask", "norm").filter("a_rank < b_rank").select(*_row(2, F.col("first"), F.col("a_rank"), F.col("b_rank"), "numeric-mismatch", one, low, high))
    return n.union(m)


def equal_pairs(hits: DataFrame) -> DataFrame:
    h = hits.withColumn("norm", normalize(F.col("text"))).select("rank", "claim_key", "norm")
    low, high = F.least("a_claim_key", "b_claim_key"), F.greatest("a_claim_key", "b_claim_key")
    return _grouped(h, "norm").filter("a_rank < b_rank").select(*_row(1, F.col("first"), F.col("a_rank"), F.col("b_rank"), "normalization-equal", F.lit(True), low, high))


def contained_pairs(hits: DataFrame) -> DataFrame:
    """Shorter (a) in strictly longer (b) texts, by bytes; candidates share a's rarest gram. Texts are made distinct first and expanded at the end.

    A text without a gram is compared with every longer one, as the examination order counts those pairs; hits are bounded by the walk."""
    h = hits.withColumn("norm", normalize(F.col("text"))).select("rank", "claim_key", "norm")
    d = h.groupBy("norm").agg(F.count("*").alias("n")).withColumn("size", F.octet_length("norm"))
    own = d.select("norm", "size", "n", F.explode(grams(F.col("norm"))).alias("gram"))
    df = own.groupBy("gram").agg(F.sum("n").alias("df"))
    rare = own.join(df, "gram").groupBy("norm").agg(F.min(F.struct("df", "gram")).alias("r")).select(F.col("norm").alias("a_norm"), F.col("r.gram").alias("gram"))
    cand = rare.withColumn("a_size", F.octet_length("a_norm")).join(own.select(F.col("norm").alias("b_norm"), F.col("size").alias("b_size"), "gram"), "gram").filter("b_size > a_size").select("a_norm", "b_norm")
    bare = d.filter(F.size(grams(F.col("norm"))) == 0).select(F.col("norm").alias("a_norm"), F.col("size").alias("a_size"))
    loose = d.select(F.col("norm").alias("b_norm"), F.col("size").alias("b_size")).join(bare, F.col("b_size") > F.col("a_size")).select("a_norm", "b_norm")
    cand = cand.union(loose).withColumn("hit", F.contains("b_norm", F.col("a_norm")))
    a, b = (h.select(*[F.col(c).alias(f"{p}_{c}") for c in h.columns]) for p in "ab")
    return cand.join(a, "a_norm").join(b, "b_norm").select(*_row(2, F.col("a_rank"), F.col("b_rank"), F.lit(0), "normalization-contains", F.col("hit"), F.col("a_claim_key"), F.col("b_claim_key")))


def alias_pairs(hits: DataFrame, aliases: DataFrame) -> DataFrame:
    """Claims of which one holds a and another b as whole tokens; each unordered pair once, ordered by the keys in ranked order."""
    t = hits.withColumn("norm", normalize(F.col("text"))).select("rank", "claim_key", F.explode(F.array_distinct(tokens(F.col("norm")))).alias("token"))
    a, b = (t.select(F.col("token").alias(p), F.col("rank").alias(f"{p}_rank"), F.col("claim_key").alias(f"{p}_key")) for p in "ab")
    m = aliases.join(a, "a").join(b, "b").filter("a_rank <> b_rank")
    low = F.when(F.col("a_rank") < F.col("b_rank"), F.col("a_key")).otherwise(F.col("b_key"))
    high = F.when(F.col("a_rank") < F.col("b_rank"), F.col("b_key")).otherwise(F.col("a_key"))
    m = m.select(low.alias("i"), high.alias("j")).distinct()
    return m.select(*_row(3, F.col("i"), F.col("j"), F.lit(0), "alias-match", F.lit(True), F.least("i", "j"), F.greatest("i", "j")))


ORDER = ("phase", "k1", "k2", "k3")


def budgeted(pairs: DataFrame, budget: int | None) -> DataFrame:
    """Pairs that are proposed among the first `budget` examined; of one unordered pair the first counts, later ones are refused."""
    seen = pairs if budget is None else pairs.orderBy(*ORDER).limit(budget)
    hit = seen.filter("hit").withColumn("lo", F.least("from_claim", "to_claim")).withColumn("hi", F.greatest("from_claim", "to_claim"))
    return hit.groupBy("lo", "hi").agg(F.min(F.struct(*ORDER, "rule", "from_claim", "to_claim")).alias("p"), (F.count("*") - 1).alias("refused")).select("p.from_claim", "p.to_claim", "p.rule", "refused")


def guarded(proposed: DataFrame, reviews: DataFrame, fingerprint: Column) -> DataFrame:
    """proposed with outcome: already_proposed while a review of the unordered pair is open, rejected_without_new_evidence if the last rejection had this fingerprint, else queued."""
    r = reviews.withColumn("lo", F.least("from_claim", "to_claim")).withColumn("hi", F.greatest("from_claim", "to_claim"))
    state = r.groupBy("lo", "hi").agg(F.max(F.col("status") == "proposed").alias("open"), F.max(F.when(F.col("status") == "resolved_rejected", F.struct("seq", "fingerprint"))).alias("last"))
    p = proposed.withColumn("lo", F.least("from_claim", "to_claim")).withColumn("hi", F.greatest("from_claim", "to_claim")).withColumn("fingerprint", fingerprint)
    j = p.join(state, ["lo", "hi"], "left")
    outcome = F.when(F.coalesce("open", F.lit(False)), "already_proposed").when(F.col("last.fingerprint") == F.col("fingerprint"), "rejected_without_new_evidence").otherwise("queued")
    return j.withColumn("outcome", F.coalesce(outcome, F.lit("queued"))).drop("lo", "hi", "open", "last")


def class_summary(claims: DataFrame) -> DataFrame:
    """Groups of equal normalised text over all claims: (norm, n, first), without listing pairs."""
    return claims.withColumn("norm", normalize(F.col("text"))).groupBy("norm").agg(F.count("*").alias("n"), F.min("claim_key").alias("first")).filter("n > 1")


def equal_classes(hits: DataFrame) -> DataFrame:
    """(claim_key, first, n): every claim whose normalised text another one has too, with the group's least key and its size."""
    return hits.select("claim_key", normalize(F.col("text")).alias("norm")).join(class_summary(hits), "norm").select("claim_key", "first", "n")


def negation_classes(hits: DataFrame) -> DataFrame:
    """(claim_key, negated, first): members of groups of equal text but for negations that hold both; each negated member contradicts each plain one."""
    h = hits.withColumn("norm", normalize(F.col("text"))).select("claim_key", has_negation(F.col("norm")).alias("negated"), stripped(F.col("norm")).alias("strip"))
    both = h.groupBy("strip").agg(F.min("claim_key").alias("first"), F.max("negated").alias("one"), F.min("negated").alias("all_of")).filter("one AND NOT all_of")
    return h.join(both.select("strip", "first"), "strip").select("claim_key", "negated", "first")


def numeric_classes(hits: DataFrame) -> DataFrame:
    """(claim_key, place, first, n): texts that differ in the numeral at one place and nowhere else, by the least key of each distinct text; any two of the n texts of a group mismatch."""
    d = hits.withColumn("norm", normalize(F.col("text"))).groupBy("norm").agg(F.min("claim_key").alias("claim_key")).withColumn("tokens", tokens(F.col("norm")))
    d = d.select("claim_key", "tokens", F.posexplode("tokens").alias("place", "token")).filter(numeral(F.col("token")))
    rest = F.concat(F.slice("tokens", 1, F.col("place")), F.array(F.lit("\u0000#\u0000")), F.slice("tokens", F.col("place") + 2, F.size("tokens")))
    d = d.select("claim_key", "place", F.array_join(rest, " ").alias("rest"))
    g = d.groupBy("rest", "place").agg(F.min("claim_key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return d.join(g, ["rest", "place"]).select("claim_key", "place", "first", "n")


def contained_classes(hits: DataFrame) -> DataFrame:
    """(from_claim, to_claim): the shorter of two distinct normalised texts, by bytes, and one that it lies in, each by its least key."""
    return contained(hits.select(F.col("claim_key").alias("doc_id"), F.lit(0).alias("pos"), "text"), lambda narrow: narrow.withColumn("claim_key", F.col("doc_id")))


def contained(lines: DataFrame, keyed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As contained_classes, of lines (doc_id, pos, text) whose claim_key is added to narrow rows, so that no text moves for it."""
    return substrings.contained(lines.select("doc_id", "pos", normalize(F.col("text")).alias("norm")).filter("norm <> ''"), keyed)
