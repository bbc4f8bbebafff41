"""Commands from end to end on a store."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from ledgerline.cli import main
from ledgerline.operators.model import Refused
from ledgerline.schema import TABLES
from ledgerline.sources.store import KEPT, GraphStore
from ledgerline.sources.transport import http


def test_commands(spark, tmp_path):
    db = str(tmp_path / "db")
    run = lambda *a, now=86400 * 20000: main(["--db", db, *a], spark=spark, now=now)
    ep = lambda i, t, tags=(): {"id": i, "text": t, "locator": {"kind": "span", "value": "p:1"}, "source": {"source_type": "s", "authority_tier": 1, "data_cutoff": "2024-09-01", "tags": list(tags)}}
    (tmp_path / "in.json").write_text(json.dumps([ep("a", "The small service is up today. The limit is 30 items here now"), ep("b", "The small service is not up today. The limit is 60 items here now", ["s1"]), ep("c", "The small service is  UP today.")]))
    code, out = run("ingest", str(tmp_path / "in.json"))
    assert code == 0 and [o["outcome"] for o in out["data"]["outcomes"]] == ["persisted"] * 3
    assert run("query", "limit")[1]["data"]["coverage"] == {"gaps": 3, "total": 3}
    out = run("extract")[1]["data"]["episodes"]
    assert {e["outcome"] for e in out} == {"succeeded"} and sum(e["staged"] for e in out) == 5
    q = run("query", "LIMIT")[1]["data"]
    assert len(q["hits"]) == 2 and q["status"] == "complete" and "coverage" not in q
    assert len(run("query", "limit", "--scope", "s1")[1]["data"]["hits"]) == 1
    assert run("query", "limit", "--budget", "1")[1]["data"]["status"] == "budget-exhausted"
    keys = {h["text"].lower(): h["claim_key"] for h in run("query", "")[1]["data"]["hits"]}
    assert sorted(keys.values()) == list(range(5))[: len(keys)] or len(keys) == 4
    assert run("adopt", "0")[0] == 0 and run("adopt", "0")[1]["data"]["code"] == "adopt_refused"
    found = run("scan")[1]["data"]["pairs"]
    assert {p["rule"] for p in found} == {"negation-marker", "numeric-mismatch"} and {p["outcome"] for p in found} == {"inserted"}
    assert {p["outcome"] for p in run("scan")[1]["data"]["pairs"]} == {"duplicate_edge"}
    assert run("contradict", "0", "1", "2", "3", "4")[1]["data"]["pairs"]
    dup = run("er")[1]["data"]["pairs"]
    assert [(p["rule"], p["outcome"]) for p in dup] == [("normalization-equal", "queued")]
    assert run("er")[1]["data"]["pairs"][0]["outcome"] == "already_proposed"
    a, b = dup[0]["from_claim"], dup[0]["to_claim"]
    assert len(run("review", "list")[1]["data"]["open"]) == 1
    assert run("review", "approve", str(a), str(b), "--actor", " ")[0] == 1
    assert run("review", "approve", str(a), str(b), "--actor", "ann")[0] == 0
    assert run("review", "list")[1]["data"]["open"] == [] and run("review", "reject", str(a), str(b), "--actor", "ann")[0] == 1
    claims = {r["claim_key"]: r for r in run("resolve")[1]["data"]["claims"]}
    assert len(claims[a]["episodes"].split(",")) == 2 and claims[0]["status"] == "active"
    assert [c["state"] for c in run("evidence", "0")[1]["data"]["checks"]] == ["resolved"] and run("evidence", "99")[0] == 1
    assert run("delete", "a", "zz")[1]["data"]["outcomes"] and run("resolve", "--restage", "1")[0] == 1
    assert run("ingest", str(tmp_path / "none.json"))[1]["data"]["code"] == "malformed_stream"


def test_evaluation_commands(spark, tmp_path):
    db = str(tmp_path / "db")
    run = lambda *a: main(["--db", db, *a], spark=spark, now=86400 * 20000)
    text = "Profits may vary by run and by season. What is a good profit for a firm? The limit is 30 items here now."
    (tmp_path / "in.json").write_text(json.dumps([{"id": "a", "text": text, "locator": {"kind": "absent"}, "source": {"source_type": "s", "authority_tier": 1, "tags": []}}]))
    assert run("eval", "manifest")[1]["data"]["code"] == "eval_manifest_empty"
    assert run("ingest", str(tmp_path / "in.json"))[0] == 0 and run("extract")[0] == 0
    shown = run("eval", "manifest")[1]["data"]
    assert [c["text"] for c in shown["run"]["claims"]] == ["Profits may vary by run and by season.", "The limit is 30 items here now."] and shown["skipped_unknown_evidence"] == 0
    assert run("eval", "manifest", "--out", str(tmp_path / "run"))[1]["data"]["claim_count"] == 2
    gold = lambda t, h=(): {"text": t, "source_count": 1, "evidence_span": t, "hedges": list(h)}
    corpus = {"id": "own", "version": "1", "episodes": [{"id": "a", "text": text, "golden_claims": [gold("profits MAY vary by run and by season.", ["may"]), gold("Another claim stands here.")]}]}
    score = lambda c, r: (tmp_path / "c.json").write_text(json.dumps(c)) and run("eval", "claims", "--corpus", str(tmp_path / "c.json"), "--run", r)[1]["data"]
    s = score(corpus, str(tmp_path / "run"))
    assert [j["reason"] for j in s["judgments"]] == ["matched", "spurious"] and (s["precision"], s["recall"], s["hedge_preservation"]) == (0.5, 0.5, 1.0)
    assert s["results_row"] == "| (date) | own@v1 | det-1 | 0.500 | 0.500 | 1.000 | emitted=2 matched=1 golden=2 content-miss=0 spurious=1 hedge-dropped=0 |"
    (tmp_path / "r.json").write_text(json.dumps({"run_id": "r", "extractor_version": "x", "claims": [{"episode_id": e, "text": t, "evidence_span": t} for e, t in (("a", "What is a good profit for a firm?"), ("b", "The limit is 30 items here now."))]}))
    assert score(corpus, str(tmp_path / "r.json"))["code"] == "eval_error"  # what is left names an unknown episode
    for broken in (corpus | {"version": " "}, corpus | {"episodes": corpus["episodes"] * 2}, {"id": "own"}, corpus | {"episodes": [{"id": "a", "text": "t", "golden_claims": [gold("x", ["loud"])]}]}):
        assert score(broken, str(tmp_path / "run"))["code"] == "eval_error"
    assert run("propose")[1]["data"]["code"] == "propose_unconfigured"
    scan = run("scan", "--budget", "1")[1]["data"]
    assert (scan["proposed"], scan["refused"], scan["status"]) == (0, 0, "budget-exhausted") and run("er")[1]["data"]["status"] == "complete"
    assert "claims" in run("dump", str(tmp_path / "dump"))[1]["data"]["tables"]
    assert run("restore", str(tmp_path / "dump"))[1]["data"]["code"] == "restore_refused"
    other = lambda *a: main(["--db", str(tmp_path / "db2"), *a], spark=spark, now=0)[1]["data"]
    assert "claims" in other("restore", str(tmp_path / "dump"))["tables"] and other("eval", "manifest")["run"] == shown["run"]


def test_commit_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    s = GraphStore(spark, str(tmp_path / "s"))
    alias = lambda a: spark.createDataFrame([(a, "b")], TABLES["er_aliases"])
    s.commit(er_aliases=alias("x"))
    with monkeypatch.context() as m:
        m.setattr(GraphStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            s.commit(er_aliases=alias("y"))
    (tmp_path / "s" / "_new.dead").write_text("{")  # a manifest that was half written
    assert [r.a for r in s.read("er_aliases").collect()] == ["x"]
    number, now = s.latest()
    s.commit(er_aliases=alias("z"))
    with pytest.raises(OSError):
        s._publish(number, now)
    assert sorted(r.a for r in s.read("er_aliases").collect()) == ["x", "z"]
    for k in range(KEPT + 2):
        s.commit(er_aliases=alias(str(k)))
    assert len(s._numbers()) == KEPT and s.read("er_aliases").count() == KEPT + 4


def test_http_transport():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            ok = seen[-1]["messages"][0]["content"] == "fine"
            self.send_response(200 if ok else 503)
            self.end_headers()
            self.wfile.write(b'{"choices": []}' if ok else b"")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    send = http(f"http://127.0.0.1:{server.server_port}/v1", "m")
    assert send("fine") == {"choices": []} and seen[0]["model"] == "m"
    with pytest.raises(Refused, match="http-503"):
        send("other")
    server.shutdown()
    for bad in (("ftp://x", "m"), ("http://x", " "), ("http://x", "m", "NO_SUCH_VARIABLE_HERE")):
        with pytest.raises(ValueError):
            http(*bad)
