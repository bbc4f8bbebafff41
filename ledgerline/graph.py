"""The claim graph as one object: every command over a store, each committing its rows at once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, extract, ingest, lifecycle, model, pairs, search
from .schema import TABLES
from .sources import golden
from .sources.adapter import running_before
from .sources.config import KEYS
from .sources.store import GraphStore

VERSION = "det-1"
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"atomic": extract.atomic, "legacy": extract.legacy}


class Refusal(Exception):
    """A command that was refused: (code, message)."""


class ClaimGraph:
    """Times are given by the caller in epoch seconds (milliseconds for supersessions) and days; nothing reads a clock."""

    def __init__(self, spark: SparkSession, root: str, config: dict[str, int] | None = None) -> None:
        self.spark, self.store, self.config = spark, GraphStore(spark, root), config or dict(KEYS)

    def read(self, name: str) -> DataFrame:
        return self.store.read(name)

    def rows(self, name: str, values: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(values, TABLES[name])

    def seq(self) -> int:
        """A number above every one given out before: commits so far, with room for the rows of one."""
        return sum(map(len, self.store.manifest().values())) << 42

    def numbered(self, df: DataFrame) -> DataFrame:
        """df with seq: room for a million partitions of four million rows."""
        i = F.monotonically_increasing_id()
        return df.withColumn("seq", F.lit(self.seq()) + F.shiftright(i, 33) * (1 << 22) + i % (1 << 33))

    def claims(self) -> DataFrame:
        """Claims with their present status: the last of adoption, supersession and restaging."""
        e = [self.read(t).select("seq", "claim_key", F.lit(s).alias("status")) for t, s in (("audits", "active"), ("supersessions", "rejected"), ("restages", "staged"))]
        return lifecycle.statuses(self.read("claims"), e[0].union(e[1]).union(e[2]))

    def checked(self, keys: list[int]) -> None:
        known = {r[0] for r in self.read("claims").filter(F.col("claim_key").isin(keys)).select("claim_key").collect()}
        if missing := [k for k in keys if k not in known]:
            raise Refusal("unknown_claim", f"no such claim: {missing}")

    # ingest --------------------------------------------------------------------------------------------------------

    def ingest(self, batch: DataFrame, today: int) -> list[dict]:
        """batch: episode columns in submission order."""
        b = batch.withColumn("pos", F.monotonically_increasing_id()).persist()
        try:
            made, ids = ingest.declaration(b, today)
            known = self.read("coverage_declarations").select("run_id")
            c = ingest.outcomes(b, self.read("episodes"), self.read("episode_tombstones")).persist()
            new = made.join(known, "run_id", "left_anti")
            self.store.commit(coverage_declarations=new, coverage_declared_ids=ids.join(new.select("run_id"), "run_id", "left_semi"), episodes=ingest.persisted(c))
            return [r.asDict() for r in c.select("pos", "id", "outcome", "reason").orderBy("pos").collect()]
        finally:
            b.unpersist()

    def delete(self, ids: list[str], at: int) -> list[dict]:
        out = ingest.delete_outcomes(self.spark.createDataFrame([(i,) for i in ids], "id string"), self.read("episodes"), self.read("lineage")).collect()
        gone = [r.id for r in out if r.outcome == "deleted"]
        if gone:
            self.store.commit(episode_tombstones=self.rows("episode_tombstones", [(i, at) for i in gone]))
            self.store.replace(episodes=self.read("episodes").filter(~F.col("id").isin(gone)), extracted=self.read("extracted").filter(~F.col("episode_id").isin(gone)))
        return [r.asDict() for r in out]

    def revive(self, ids: list[str]) -> list[dict]:
        t = self.read("episode_tombstones")
        out = ingest.revive_outcomes(self.spark.createDataFrame([(i,) for i in ids], "id string"), t).collect()
        self.store.replace(episode_tombstones=t.filter(~F.col("episode_id").isin([r.id for r in out if r.outcome == "revived"])))
        return [r.asDict() for r in out]

    # extraction ------------------------------------------------------------------------------------------------------

    def extract(self, at_millis: int, extractor: str = "atomic", version: str = VERSION) -> DataFrame:
        """Run the pending episodes; returns (episode_id, outcome, reason, staged)."""
        todo = extract.pending(self.read("episodes"), self.read("extracted"), version).persist()
        old, lin = self.claims(), self.read("lineage")
        gone = extract.superseded(old, lin, todo.select("id"), version)
        c = extract.usable(EXTRACTORS[extractor](todo))
        j = extract.judged(c, todo).persist()
        v = extract.verdicts(j).persist()
        s = extract.staged(j, v)
        counts = s.groupBy("episode_id").agg(F.count("*").alias("n"), F.collect_list("pos").alias("all"))
        first = running_before(counts.select("episode_id", "n"), "episode_id", "n").select("episode_id", "before")
        start = (self.read("claims").agg(F.max("claim_key")).first()[0] or -1) + 1 if self.store.manifest().get("claims") else 0
        place = F.array_position(F.array_sort("all"), F.col("pos")) - 1
        k = s.join(first, "episode_id").join(counts.select("episode_id", "all"), "episode_id").withColumn("claim_key", (F.lit(start) + F.col("before") + place).cast("bigint")).persist()
        none = F.lit(None).cast("string")
        claims = k.select("claim_key", "text", none.alias("valid_at"), none.alias("invalid_at"), "data_cutoff", "status", "scope", "source_type", F.struct(F.col("evidence_kind").alias("kind"), F.col("evidence_text").alias("text"), F.col("evidence_locator").alias("locator")).alias("evidence"))
        base = self.seq()
        lineage = k.select((F.lit(base) + F.col("claim_key")).alias("seq"), "claim_key", "episode_id", F.lit(version).alias("extractor_version"))
        empty = todo.select(F.col("id").alias("episode_id")).join(v.select("episode_id"), "episode_id", "left_anti")
        cache = v.filter("cached").select("episode_id").union(empty).select("episode_id", F.lit(version).alias("extractor_version"))
        active = old.filter("status = 'active'").join(lin.select("claim_key", "episode_id").distinct(), "claim_key").select("claim_key", "episode_id", F.col("evidence.locator").alias("locator"), "text").filter("locator IS NOT NULL")
        new = k.select("episode_id", F.col("evidence_locator").alias("locator"), "text")
        iv = self.numbered(extract.invalidations(active, new, self.read("invalidations")))
        ss = self.numbered(gone.select("claim_key", F.lit('{"code":"superseded_by_reextraction"}').alias("reason"), F.lit(at_millis).cast("bigint").alias("superseded_at")))
        self.store.commit(claims=claims, lineage=lineage, extracted=cache, invalidations=iv, supersessions=ss)
        return v

    # reading -----------------------------------------------------------------------------------------------------------

    def query(self, pattern: str, as_of: int, budget: int | None = None, scope: list[str] | None = None) -> dict:
        b = budget if budget is not None else self.config["default_budget"]
        claims, eps = self.claims(), self.read("episodes")
        hits = [r.asDict() for r in search.search(claims, self.read("lineage"), eps, pattern, budget=b, scope=scope, as_of=as_of, window=self.config["staleness_window_days"]).orderBy(*search.rank_order()).collect()]  # at most the budget
        status = search.truncated(claims, b).first()["status"]
        out: dict = {"hits": hits, "status": status, "warning": "stale" if hits and hits[0]["stale"] else None}
        if not hits and status == "complete":
            c = search.ingest_coverage(self.read("coverage_declared_ids"), self.read("coverage_declarations"), eps).first()
            if c["declared"] > c["persisted"]:
                out["ingest_coverage"] = c.asDict()
        gap = search.extraction_coverage(eps, self.read("extracted"), search.dead_extractions(claims, self.read("lineage"), self.read("supersessions"))).first()
        if gap["gaps"]:
            out["coverage"] = gap.asDict()
        return out

    def contradict(self, keys: list[int], budget: int | None = None) -> dict:
        p, q, s = search.contradictions(self.read("edges"), self.read("invalidations"), self.claims(), self.read("lineage"), self.read("episodes"), keys, budget or self.config["default_budget"])
        return {"pairs": [r.asDict() for r in p.collect()], "proposals": [r.asDict() for r in q.collect()], "status": s.first()["status"]}

    def resolve(self) -> DataFrame:
        return lifecycle.identity_report(self.claims(), self.read("lineage"), self.read("supersessions"), self.read("invalidations"))

    def ranked(self, budget: int, as_of: int) -> DataFrame:
        return search.ranked(search.search(self.claims(), self.read("lineage"), self.read("episodes"), "", budget=budget, as_of=as_of, window=self.config["staleness_window_days"]))

    # passes --------------------------------------------------------------------------------------------------------------

    def _report(self, outcomes: DataFrame, made: str, examined: DataFrame, budget: int) -> dict:
        """A pass's pairs, at most its budget, with what was proposed and refused; exhausted if the walk or the pairs went beyond the budget."""
        rows = [r.asDict() for r in outcomes.select("from_claim", "to_claim", "rule", "outcome", "refused").collect()]
        proposed = sum(r["outcome"] == made for r in rows)
        refused = len(rows) - proposed + sum(r.pop("refused") for r in rows)
        walked = search.truncated(self.claims(), budget).first()["status"]
        return {"pairs": rows, "proposed": proposed, "refused": refused, "status": "budget-exhausted" if examined.limit(budget + 1).count() > budget else walked}

    def er(self, now: int, as_of: int, budget: int | None = None) -> dict:
        b = budget or self.config["default_budget"]
        h = self.ranked(b, as_of).persist()
        every = pairs.equal_pairs(h).union(pairs.contained_pairs(h)).union(pairs.alias_pairs(h, self.read("er_aliases")))
        p = pairs.budgeted(every, b)
        side = lambda x: h.select(F.col("claim_key").alias(f"{x}_claim"), F.col("text").alias(f"{x}_text"), F.col("episodes").alias(f"{x}_eps"))
        eps = F.array_sort(F.array_distinct(F.concat(F.split("from_eps", ","), F.split("to_eps", ","))))
        mark = F.to_json(F.struct(F.array("from_text", "to_text").alias("texts"), eps.alias("episodes"), F.col("rule")))
        g = pairs.guarded(p.join(side("from"), "from_claim").join(side("to"), "to_claim"), self.read("reviews"), mark).persist()
        none = F.lit(None).cast("string")
        new = self.numbered(g.filter("outcome = 'queued'").select("from_claim", "to_claim", F.lit("proposed").alias("status"), F.col("rule").alias("evidence"), "fingerprint", F.lit(now).cast("bigint").alias("queued_at"), F.lit(None).cast("bigint").alias("resolved_at"), none.alias("actor"), none.alias("decision"))).persist()
        self.store.commit(reviews=new, edges=new.select("seq", "from_claim", F.lit("possible_duplicate_of").alias("label"), "to_claim", none.alias("provenance")))
        return self._report(g, "queued", every, b)

    def scan(self, now: int, as_of: int, budget: int | None = None) -> dict:
        b = budget or self.config["default_budget"]
        every = pairs.scan_pairs(self.ranked(b, as_of))
        p = pairs.budgeted(every, b).withColumn("label", F.lit("contradicts"))
        o = p.join(lifecycle.new_edges(p.select("from_claim", "label", "to_claim"), self.read("edges"), self.read("claims")), ["from_claim", "label", "to_claim"]).persist()
        why = F.to_json(F.struct(F.lit("contradiction-scan").alias("pass"), F.lit("1").alias("version"), F.col("rule"), F.lit(now).alias("at")))
        self.store.commit(edges=self.numbered(o.filter("outcome = 'inserted'").select("from_claim", "label", "to_claim", why.alias("provenance"))))
        return self._report(o, "inserted", every, b)

    def propose(self, transport: model.Transport, now: int, as_of: int, producer: str, budget: int | None = None) -> dict:
        hits = [(r.claim_key, r.text) for r in self.ranked(budget or self.config["default_budget"], as_of).orderBy("rank").collect()]
        report = model.propose(hits, transport, model.Spend(), self.config["max_attempts"])
        found = self.spark.createDataFrame([(a, b, r) for a, b, r in report["proposed"]], "from_claim bigint, to_claim bigint, rationale string")
        mark = F.to_json(F.struct("rationale", F.lit(producer).alias("model")))
        none = F.lit(None).cast("string")
        g = pairs.guarded(found, self.read("contradiction_proposals"), mark).filter("outcome = 'queued'")
        self.store.commit(contradiction_proposals=self.numbered(g.select("from_claim", "to_claim", F.lit("proposed").alias("status"), F.lit(producer).alias("producer"), "rationale", "fingerprint", F.lit(now).cast("bigint").alias("queued_at"), F.lit(None).cast("bigint").alias("resolved_at"), none.alias("actor"), none.alias("decision"))))
        return report

    # evaluation ------------------------------------------------------------------------------------------------------

    def eval_claims(self, corpus: str, run: str) -> dict:
        """Scores a run's manifest, less what the shape rules drop, against a golden corpus; both are files."""
        try:
            c, r = golden.read_corpus(self.spark, corpus), golden.read_run(self.spark, run)
        except ValueError as e:
            raise Refusal("eval_error", str(e)) from None
        kept = evaluate.post_pass(r.candidates, c.episodes).persist()
        emitted, unknown = kept.count(), kept.join(c.episodes.select(F.col("id").alias("episode_id")), "episode_id", "left_anti").count()
        if emitted and unknown == emitted:
            raise Refusal("eval_error", f"all {emitted} candidates of run {r.id} name episodes that corpus {c.id} has not")
        judged = evaluate.judgments(kept, c.golden, c.episodes).persist()
        m = evaluate.metrics(judged, c.golden).first().asDict()
        out = {"corpus_id": c.id, "corpus_version": c.version, "run_id": r.id, "extractor_version": r.version, "shape_filtered": r.candidates.count() - emitted, "unknown_episode_ids": unknown}
        rows = [x.asDict() for x in judged.orderBy("candidate").toLocalIterator()]
        return out | m | {"judgments": rows, "results_row": evaluate.results_row(f"{c.id}@v{c.version}", r.version, m)}

    def eval_manifest(self, version: str | None = None, out: str | None = None) -> dict:
        """The live candidates of one extractor version as a run; with out, only written there, as one JSON object in the part file of a folder."""
        have = sorted(r[0] for r in self.read("extracted").select("extractor_version").distinct().collect())  # a row an extractor version
        if version is None and len(have) != 1:
            raise Refusal(*(("eval_manifest_ambiguous", f"several versions: {', '.join(have)}") if have else ("eval_manifest_empty", "nothing has been extracted")))
        v = version or have[0]
        live = evaluate.live_candidates(self.claims(), self.read("lineage"), v).select("claim_key", "episode_id", "text", F.col("evidence.text").alias("evidence_span")).persist()
        told = live.filter("evidence_span IS NOT NULL")
        n = told.count()
        about = {"extractor_version": v, "claim_count": n, "skipped_unknown_evidence": live.count() - n, "out": out}
        order = told.orderBy("claim_key", "episode_id").select("episode_id", "text", "evidence_span")
        if out is None:
            return about | {"run": {"run_id": f"store-export-{v}", "extractor_version": v, "claims": [r.asDict() for r in order.toLocalIterator()]}}
        lead = json.dumps({"run_id": f"store-export-{v}", "extractor_version": v})[:-1] + ', "claims": ['
        lines = told.select(F.lit(1).alias("o"), "claim_key", "episode_id", F.to_json(F.struct("episode_id", "text", "evidence_span")).alias("value"))
        first = lines.agg(F.min(F.struct("claim_key", "episode_id")).alias("f"))
        lines = lines.join(F.broadcast(first)).select("o", "claim_key", "episode_id", F.when(F.struct("claim_key", "episode_id") == F.col("f"), F.col("value")).otherwise(F.concat(F.lit(","), F.col("value"))).alias("value"))
        ends = self.spark.createDataFrame([(0, None, None, lead), (2, None, None, "]}")], lines.schema)
        lines.union(ends).repartition(1).sortWithinPartitions("o", "claim_key", "episode_id").select("value").write.text(out)
        return about

    # people ----------------------------------------------------------------------------------------------------------

    def adopt(self, keys: list[int], actor: str, now: int) -> list[dict]:
        """Adopts up to the first refusal; those before it stand."""
        out = lifecycle.adopt(self.spark.createDataFrame(list(enumerate(keys)), "pos bigint, claim_key bigint"), self.claims()).orderBy("pos").collect()
        good = [r.claim_key for r in out if r.outcome == "adopted"]
        s = self.seq()
        self.store.commit(audits=self.rows("audits", [(s + k, c, actor, now) for k, c in enumerate(good)]))
        return [r.asDict() for r in out]

    def restage(self, key: int, actor: str, now: int) -> str:
        o = lifecycle.restage(self.spark.createDataFrame([(key,)], "claim_key bigint"), self.claims(), self.read("supersessions")).first()["outcome"]
        if o == "restaged":
            self.store.commit(restages=self.rows("restages", [(self.seq(), key, actor, now)]))
        return o

    def _open(self, table: str) -> DataFrame:
        """Rows of a queue with the last state of each: a resolved row is a later row of the same pair and seq parity."""
        r = self.read(table)
        last = r.groupBy("from_claim", "to_claim").agg(F.max_by("status", "seq").alias("now"), F.max("seq").alias("seq"))
        return r.join(last.filter("now = 'proposed'").select("from_claim", "to_claim", "seq"), ["from_claim", "to_claim", "seq"], "left_semi")

    def review_list(self, as_of: int) -> list[dict]:
        return [r.asDict() for r in lifecycle.queue(self._open("reviews"), self.read("lineage"), as_of).orderBy(F.desc("age"), "seq").collect()]

    def proposal_list(self) -> list[dict]:
        return [r.asDict() for r in lifecycle.open_proposals(self._open("contradiction_proposals")).collect()]

    def decide(self, table: str, a: int, b: int, decision: str, actor: str, now: int) -> dict:
        """Approve or reject an open row of reviews or contradiction_proposals."""
        if not actor.strip():
            raise Refusal("review_refused", "an actor is needed")
        pair = (F.least("from_claim", "to_claim") == min(a, b)) & (F.greatest("from_claim", "to_claim") == max(a, b))
        row = self._open(table).filter(pair).first()
        if row is None:
            raise Refusal("review_refused", f"nothing is open between {a} and {b}")
        done = row.asDict() | {"seq": self.seq(), "status": f"resolved_{decision}", "resolved_at": now, "actor": actor, "decision": decision}
        names = [f.name for f in self.read(table).schema]
        made = {table: self.rows(table, [tuple(done[n] for n in names)])}
        if table == "reviews":
            made["review_audits"] = self.rows("review_audits", [(done["seq"], row.from_claim, row.to_claim, decision, actor, now)])
            if decision == "approved":
                add = lifecycle.merge_lineage(self.spark.createDataFrame([(a, b)], "from_claim bigint, to_claim bigint"), self.read("lineage"))
                made["lineage"] = self.numbered(add)
        elif decision == "approved":
            one = self.spark.createDataFrame([(row.from_claim, row.to_claim, row.producer)], "from_claim bigint, to_claim bigint, producer string")
            made["edges"] = self.numbered(lifecycle.approved_edges(one, actor, now))
        self.store.commit(**made)
        if table == "reviews":
            e = self.read("edges")
            self.store.replace(edges=e.filter(~((F.col("label") == "possible_duplicate_of") & (F.col("from_claim") == row.from_claim) & (F.col("to_claim") == row.to_claim))))
        return done

    def alias(self, a: str, b: str) -> None:
        a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
        if not a or not b or a == b:
            raise Refusal("alias_refused", "two different words are needed")
        self.store.commit(er_aliases=self.rows("er_aliases", [(a, b)]).join(self.read("er_aliases"), ["a", "b"], "left_anti"))

    def evidence_check(self, keys: list[int], now: int) -> list[dict]:
        self.checked(keys)
        c = self.claims().filter(F.col("claim_key").isin(keys)).select("claim_key", F.col("evidence.text").alias("span"))
        s = lifecycle.evidence_states(c, self.read("lineage"), self.read("episodes"), self.read("episode_tombstones")).persist()
        refs = s.select("claim_key", "episode_id", F.lit("1").alias("locator_scheme_version"), "observed_tier").join(self.read("evidence_refs").select("claim_key"), "claim_key", "left_anti")
        checks = self.numbered(s).select(F.col("seq").alias("check_id"), "claim_key", F.col("state").alias("resolution_state"), F.lit(now).cast("bigint").alias("checked_at"))
        self.store.commit(evidence_refs=refs, evidence_checks=checks)
        return [r.asDict() for r in s.orderBy("claim_key").collect()]
