"""Operators of the claim graph on small tables with known answers."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import evaluate, extract, ingest, lifecycle, model, pairs, search
from ledgerline.schema import TABLES
from ledgerline.sources import config, convert
from ledgerline.sources.store import GraphStore
from ledgerline.streaming.ingest import into

EP = TABLES["episodes"]


def ep(i, text="t", tier=1, cutoff=None, tags=(), kind="episode"):
    return (i, text, ("span", "l"), kind, cutoff, tier, list(tags))


def test_ingest_outcomes(spark):
    held = spark.createDataFrame([ep("p1", "as persisted")], EP)
    dead = spark.createDataFrame([("dead", 1)], TABLES["episode_tombstones"])
    rows = [("p1", "as persisted"), ("p1", "anything"), ("n1", "ok"), ("  ", "ok"), ("  ", "ok"), ("n2", "\t\n"), ("n2", "ok"), ("n3", "ok"), ("dead", "ok"), ("é", "ok"), ("é", "ok")]
    batch = spark.createDataFrame([(k, *ep(i, t, kind="" if i == "n3" else "episode")) for k, (i, t) in enumerate(rows)], "pos bigint, " + EP)
    got = [(r.outcome, r.reason) for r in ingest.outcomes(batch, held, dead).orderBy("pos").collect()]
    r = lambda x: ("rejected", x)
    assert got == [("already_persisted", None), r("duplicate"), ("persisted", None), r("missing_id"), r("duplicate"), r("missing_text"), r("duplicate"), r("missing_metadata"), r("deleted_id"), ("persisted", None), r("duplicate")]
    again = spark.createDataFrame([(0, *ep("p1", "changed"))], "pos bigint, " + EP)
    assert ingest.outcomes(again, held, dead).first().reason == "conflict"
    d, ids = ingest.declaration(batch, 5)
    assert d.first().declared_count == 6 and ids.count() == 6


def graph(spark):
    eps = spark.createDataFrame([ep("a", tier=0, cutoff="2026-06-01", tags=["s1"]), ep("b", tier=0, cutoff="2025-12-01", tags=["s2"]), ep("c", tier=0, tags=["s1"]), ep("d", tier=3, cutoff="2026-06-01", tags=["s3"]), ep("e", tier=0, cutoff="2020-01-01"), ep("f", tier=2, cutoff="2019-01-01"), ep("g", tier=9, cutoff="May 2026")], EP)
    claims = spark.createDataFrame([(k, f"claim {c}", "active") for k, c in enumerate("fedcbag")] + [(7, "claim dangling", "active")], "claim_key bigint, text string, status string")
    lin = spark.createDataFrame([(k, k, c, "v1") for k, c in enumerate("fedcbag")] + [(8, 7, "nowhere", "v1"), (9, 3, "d", "v1")], TABLES["lineage"])
    return claims, lin, eps


def test_search_ranks_scopes_and_stops(spark):
    claims, lin, eps = graph(spark)
    as_of = 20634  # 2026-06-30
    run = lambda **kw: search.ranked(search.search(claims, lin, eps, kw.pop("pattern", "CLAIM"), as_of=as_of, **kw)).orderBy("rank").collect()
    got = run()
    assert [r.text[-1] for r in got] == ["c", "a", "b", "d", "g", "e", "f"]  # c rests on d's cutoff too
    assert [r.stale for r in got] == [False] * 5 + [True] * 2
    assert {r.text[-1]: r.cutoff for r in got}["g"] == "May 2026" and {r.text[-1]: r.episodes for r in got}["c"] == "c,d"
    assert {r.text[-1] for r in run(scope=["s1"])} == {"a", "c"} and run(scope=[]) == [] and {r.text[-1] for r in run(scope=["s3"])} == {"d", "c"}
    assert [r.claim_key for r in run(budget=2)] == [1, 0] and run(budget=0) == [] and run(pattern="%") == []
    assert search.truncated(claims, 8).first().status == "complete" and search.truncated(claims, 7).first().status == "budget-exhausted"


def test_coverage(spark):
    claims, lin, eps = graph(spark)
    ids = spark.createDataFrame([("r", x) for x in ("a", "b", "x", "y")], TABLES["coverage_declared_ids"])
    made = spark.createDataFrame([("r", 6, 1)], TABLES["coverage_declarations"])
    r = search.ingest_coverage(ids, made, eps).first()
    assert (r.declared, r.persisted) == (6, 2)
    gone = claims.withColumn("status", F.when(F.col("claim_key") == 5, "rejected").otherwise(F.col("status")))
    ss = spark.createDataFrame([(0, 5, "{}", 1)], TABLES["supersessions"])
    ex = spark.createDataFrame([("a", "v1"), ("b", "v1"), ("g", "v1")], TABLES["extracted"])
    dead = search.dead_extractions(gone, lin, ss)
    c = search.extraction_coverage(eps, ex, dead).first()
    assert (c.gaps, c.total) == (5, 7)
    assert search.extraction_coverage(eps, ex.union(spark.createDataFrame([("a", "v2")], TABLES["extracted"])), dead).first().gaps == 4


def test_contradictions_share_one_budget(spark):
    claims, lin, eps = graph(spark)
    edges = spark.createDataFrame([(0, 1, "contradicts", 2, None), (1, 3, "mentions", 4, None)], TABLES["edges"])
    iv = spark.createDataFrame([(0, 2, "z")], TABLES["invalidations"])
    read = lambda b: search.contradictions(edges, iv, claims, lin, eps, [2], b)
    p, q, s = read(2)
    assert (p.count(), q.count(), s.first().status) == (1, 0, "budget-exhausted")
    p, q, s = read(3)
    assert (p.count(), q.count(), s.first().status) == (1, 1, "complete")
    assert read(1)[1].count() == 0


def hits(spark, texts):
    return spark.createDataFrame([(k, t, k + 1) for k, t in enumerate(texts)], "claim_key bigint, text string, rank int")


@pytest.mark.parametrize(
    "a, b, rule",
    [("The service is up.", "The service is not up.", "negation-marker"), ("There are retries left.", "There are no retries left.", "negation-marker"), ("The limit is 30 items", "The limit is 60 items", "numeric-mismatch"), ("The limit is 30.", "The limit is 60.", None), ("It holds 3 of 4", "It holds 5 of 6", None), ("It is not up", "It never is up", None), ("It is not, up", "It is up", None)],
)
def test_scan(spark, a, b, rule):
    got = pairs.budgeted(pairs.scan_pairs(hits(spark, [a, b])), None).collect()
    assert [r.rule for r in got] == ([rule] if rule else [])


def test_examined_pairs_count_even_if_not_proposed(spark):
    h = hits(spark, ["It holds 3 of 4", "It holds 5 of 6", "x 1", "x 2"])
    assert pairs.scan_pairs(h).count() == 2
    assert pairs.budgeted(pairs.scan_pairs(h), 1).count() == 0 and pairs.budgeted(pairs.scan_pairs(h), 2).count() == 1


@pytest.mark.parametrize(
    "a, b, want",
    [("exact  Text 1", " EXACT text 1 ", ("normalization-equal", 0, 1)), ("alpha beta gamma", "alpha beta", ("normalization-contains", 1, 0)), ("audit", "the preaudits ran", ("normalization-contains", 0, 1)), ("a b", "x a b y", ("normalization-contains", 0, 1)), ("Bob invested early.", "Robert invested early.", ("alias-match", 0, 1))],
)
def test_duplicates(spark, a, b, want):
    h = hits(spark, [a, b])
    al = spark.createDataFrame([("bob", "robert")], "a string, b string")
    got = pairs.budgeted(pairs.equal_pairs(h).union(pairs.contained_pairs(h)).union(pairs.alias_pairs(h, al)), None).collect()
    assert [(r.rule, r.from_claim, r.to_claim) for r in got] == [want]


def test_duplicate_pass_at_two_thousand(spark):
    texts = [f"filler {hashlib.md5(str(k).encode()).hexdigest()} text" for k in range(2000)]
    texts += ["same words here", "Same  words here", "twin text", "TWIN text", "one more pair", "one more pair", "zebra crossing", "the zebra crossing ahead"]
    h = hits(spark, texts)
    p = pairs.equal_pairs(h).union(pairs.contained_pairs(h))
    assert p.count() <= 2100 and pairs.budgeted(p, 2100).count() == 4


def test_guards(spark):
    p = spark.createDataFrame([(1, 2), (4, 3), (5, 6), (7, 8)], "from_claim bigint, to_claim bigint")
    rv = spark.createDataFrame([(1, 2, 1, "proposed", "x"), (2, 3, 4, "resolved_rejected", "old"), (3, 3, 4, "resolved_rejected", "f"), (4, 5, 6, "resolved_rejected", "other"), (5, 7, 8, "resolved_approved", "f")], "seq bigint, from_claim bigint, to_claim bigint, status string, fingerprint string")
    got = {(r.from_claim, r.to_claim): r.outcome for r in pairs.guarded(p, rv, F.lit("f")).collect()}
    assert got == {(1, 2): "already_proposed", (4, 3): "rejected_without_new_evidence", (5, 6): "queued", (7, 8): "queued"}


def test_extraction_gate(spark):
    e = spark.createDataFrame([ep("ok", "Profits may vary by run. All is well."), ep("sec", "x", tags=["section-kind:copyright"]), ep("gate", "Profits may vary by run."), ep("miss", "Nothing like it."), ep("shape", "Why?")], EP)
    c = spark.createDataFrame([("ok", 0, "Profits may vary by run.", "Profits  may vary by run."), ("ok", 1, "Is it?", "Is it?"), ("ok", 2, "No evidence.", None), ("sec", 0, "x", "x"), ("gate", 0, "Profits vary by run.", "Profits vary by run."), ("gate", 1, "Profits may vary by run.", "Profits may vary by run."), ("miss", 0, "Other words.", "Other words."), ("shape", 0, "Why?", "Why?")], extract.CANDIDATES)
    j = extract.judged(c, e)
    v = extract.verdicts(j)
    got = {r.episode_id: (r.outcome, r.reason, r.staged, r.cached) for r in v.collect()}
    assert got == {"ok": ("succeeded", None, 2, True), "sec": ("section_filtered", "section-kind:copyright", 0, True), "gate": ("gate_rejected", "hedge_marker_dropped", 0, False), "miss": ("gate_rejected", "evidence_not_contained", 0, False), "shape": ("shape_filtered", "interrogative_final", 0, True)}
    s = extract.staged(j, v).collect()
    assert {r.evidence_kind for r in s} == {"span", "unknown"} and {r.scope for r in s} == {"workspace:unscoped"}
    assert extract.legacy(e).count() == 5 and extract.atomic(e).filter("episode_id = 'ok'").count() == 1
    m = extract.migrated(spark.createDataFrame([(1, "t")], "claim_key bigint, text string"))
    assert extract.reflection_flags(m).count() == 1


def test_supersede_and_invalidate(spark):
    claims = spark.createDataFrame([(0, "staged"), (1, "active"), (2, "staged"), (3, "staged")], "claim_key bigint, status string")
    lin = spark.createDataFrame([(0, 0, "e", "v1"), (1, 1, "e", "v1"), (2, 2, "e", "v1"), (3, 2, "x", "v2"), (4, 3, "x", "v1")], TABLES["lineage"])
    pend = spark.createDataFrame([("e",)], "id string")
    assert [r[0] for r in extract.superseded(claims, lin, pend, "v2").collect()] == [0]
    active = spark.createDataFrame([(1, "e", "l", "a  b"), (2, "e", "m", "q"), (3, "e", None, "q")], "claim_key bigint, episode_id string, locator string, text string")
    cand = spark.createDataFrame([("e", "l", "a b"), ("e", "l", "c")], "episode_id string, locator string, text string")
    none = spark.createDataFrame([], "claim_key bigint, causing_episode_id string")
    got = extract.invalidations(active, cand, none)
    assert [r.claim_key for r in got.collect()] == [1]
    assert extract.invalidations(active, cand.limit(1), none).count() <= 1 and extract.invalidations(active, cand, got).count() == 0


def test_lifecycle(spark):
    claims = spark.createDataFrame([(0, "staged"), (1, "staged"), (2, "active"), (3, "rejected"), (4, "rejected")], "claim_key bigint, status string")
    want = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 0)], "pos bigint, claim_key bigint")
    assert [r.outcome for r in lifecycle.adopt(want, claims).orderBy("pos").collect()] == ["adopted", "adopted", "refused", "not_tried"]
    ss = spark.createDataFrame([(0, 3, "{}", 1)], TABLES["supersessions"])
    got = {r.claim_key: r.outcome for r in lifecycle.restage(claims.select("claim_key"), claims, ss).collect()}
    assert got == {0: "refused", 1: "refused", 2: "refused", 3: "restaged", 4: "refused"}
    edge = spark.createDataFrame([(0, "contradicts", 1), (0, "contradicts", 2), (0, "contradicts", 9)], "from_claim bigint, label string, to_claim bigint")
    out = {r.to_claim: r.outcome for r in lifecycle.new_edges(edge, edge.filter("to_claim = 2"), claims).collect()}
    assert out == {1: "inserted", 2: "duplicate_edge", 9: "unknown_claim"}
    p = spark.createDataFrame([(1, 2, "m")], "from_claim bigint, to_claim bigint, producer string")
    assert lifecycle.approved_edges(p, "ann", 7).first().provenance == '{"producer":"m","approved_by":"ann","at":7}'


def test_evaluation(spark):
    e = spark.createDataFrame([("e", "Profits may vary by run. Profits may vary by run.")], "id string, text string")
    g = spark.createDataFrame([(0, "e", "Profits may vary by run.", ["may"])], "pos bigint, episode_id string, text string, hedges array<string>")
    span = "Profits may vary by run."
    c = spark.createDataFrame([(0, "e", "Profits vary by run.", span), (1, "e", span, "foreign"), (2, "e", span, span), (3, "e", span, span), (4, "zz", span, span)], "pos bigint, episode_id string, text string, span string")
    j = evaluate.judgments(c, g, e)
    assert [r.reason for r in j.orderBy("candidate").collect()] == ["hedge-dropped", "content-miss", "matched", "spurious", "spurious"]
    m = evaluate.metrics(j, g).first()
    assert (m.precision, m.recall, m.hedge_preservation, m.unknown_metrics) == (0.2, 1.0, 1.0, "")
    m = evaluate.metrics(j.limit(0), g.limit(0)).first()
    assert m.precision is None and m.unknown_metrics == "precision,recall,hedge_preservation"


def test_converters():
    md = convert.markdown("lead\n\n# A *b*\npara one\nstill\n\npara two\n\n```\ncode\n```\n---\nafter rule\n\n# A b\n\n# Praise for it\nx")
    assert [(e["id"], e["text"], e["locator"]["kind"]) for e in md] == [("intro", "lead", "absent"), ("a-b", "para one still\n\npara two", "span"), ("a-b-2", "after rule", "span"), ("praise-for-it", "x", "span")]
    assert md[-1]["tags"] == ["section-kind:praise"]
    h = convert.html("<head><title>no</title></head><p>lead</p><h2>One<br>two</h2><div>a<p>b</p>c</div><script>x</script><pre>y</pre><h3></h3><p>last")
    assert [(e["id"], e["text"]) for e in h] == [("intro", "lead"), ("one-two", "a\n\nb\n\nc"), ("untitled", "last")]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("META-INF/container.xml", '<c><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></c>')
        f.writestr("o/b.opf", '<package xmlns:dc="d"><dc:date>2024-02-30</dc:date><dc:date>2024-02-28</dc:date><manifest><item id="n" href="nav.html" properties="nav"/><item id="a" href="a.html"/><item id="b" href="b.html"/><item id="c" href="c.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/></spine></package>')
        f.writestr("o/nav.html", '<a href="a.html#x">First <b>part</b></a>')
        f.writestr("o/a.html", "<p>one</p>")
        f.writestr("o/b.html", "<h1>Two</h1><p>two</p>")
        f.writestr("o/c.html", "<p>three</p>")
    got = convert.epub(z.getvalue())
    assert [(e["id"], e["text"], e["data_cutoff"]) for e in got] == [("first-part", "one", "2024-02-28"), ("two", "two", "2024-02-28"), ("chapter-003", "three", "2024-02-28")]
    assert [e["id"] for e in convert.pdf(b"", lambda d: ["a", " ", "b"])] == ["page-001", "page-003"]
    with pytest.raises(ValueError):
        convert.pdf(b"", lambda d: ["", " "])


def test_json_stream(spark, tmp_path):
    good = '[{"id":"a","text":"t","locator":{"kind":"absent"},"source":{"source_type":"s","authority_tier":2,"tags":[]},"extra":1}]'
    (tmp_path / "g.json").write_text(good)
    assert convert.read_json_stream(spark, str(tmp_path / "g.json")).first().authority_tier == 2
    (tmp_path / "b.json").write_text(good.replace('"authority_tier":2', '"authority_tier":300'))
    with pytest.raises(Exception, match="malformed_stream"):
        convert.read_json_stream(spark, str(tmp_path / "b.json")).collect()


def test_store_and_stream(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "s"))
    assert s.read("episodes").count() == 0
    b = spark.createDataFrame([ep("a"), ep("b"), ep("a", "again")], EP)
    seen = []
    run = into(s, lambda df, n: seen.append({r.outcome for r in df.collect()}))
    run(b, 0)
    run(b, 1)
    assert sorted(r.id for r in s.read("episodes").collect()) == ["a", "b"] and "persisted" not in seen[1]
    s.dump(str(tmp_path / "d"))
    t = GraphStore(spark, str(tmp_path / "t"))
    t.restore(str(tmp_path / "d"), ["episodes"])
    assert t.read("episodes").orderBy("id").collect() == s.read("episodes").orderBy("id").collect()
    s.replace(episodes=s.read("episodes").filter("id = 'a'"))
    assert s.read("episodes").count() == 1


def test_config_and_envelopes():
    assert config.parse("default_budget = 9 # x\n\n") == {"staleness_window_days": 365, "default_budget": 9, "max_attempts": 3}
    for bad in ("nope = 1", "default_budget = -1", "default_budget"):
        with pytest.raises(ValueError, match="config_parse"):
            config.parse(bad)
    assert config.envelope("query", {})["ok"] and not config.refusal("x", "m", "do y")["ok"]
    with pytest.raises(ValueError):
        config.refusal("x", "m", "")


def test_model_loop():
    body = lambda t, cost=0.01: {"choices": [{"message": {"content": t}}], "usage": {"cost": cost}}
    good = '```json\n{"claims":[{"text":"t","evidence":"e"}]}\n```'
    script = iter([body(good), body('{"claims":[{"text":"t"}]}'), body(good), body("no"), body("no"), body("no"), body(good, None)])
    s = model.Spend(cap=1_000_000)
    p = model.extract([(x, x) for x in "abcde"], lambda q: next(script), s)
    assert set(p.claims) == {"a", "b", "d"} and p.parked == {"c": "schema"} and p.pending == ["e"] and s.unaccounted
    assert model.extract([("a", "a")], lambda q: 1 / 0, model.Spend(cap=0)).pending == ["a"]
    r = model.propose([(1, "a"), (2, "b")], lambda q: body('{"pairs":[{"from":1,"to":2,"rationale":"r"},{"from":2,"to":1,"rationale":"r"},{"from":1,"to":1,"rationale":"r"},{"from":1,"to":9,"rationale":"r"}]}'), model.Spend())
    assert (r["proposed"], r["self"], r["duplicate"], r["hallucinated"]) == ([(1, 2, "r")], 1, 1, 1)
    assert model.propose([(1, "a")], lambda q: body("x"), model.Spend())["exhausted"]
