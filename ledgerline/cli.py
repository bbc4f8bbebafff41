"""Commands over a store: python -m ledgerline.cli --db FOLDER COMMAND ... Every answer is one JSON envelope; the exit code says whether it is ok."""

from __future__ import annotations

import argparse
import json
import sys
import time

from . import prepare
from .graph import ClaimGraph, Refusal
from .sources import config as cfg
from .sources.convert import read_json_stream
from .sources.transport import http


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerline")
    p.add_argument("--db", default="./ledgerline-store")
    p.add_argument("--config")
    p.add_argument("--as-of", type=int, help="day since 1970 that staleness is judged at")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("version")
    c.add_parser("ingest").add_argument("stream")
    c.add_parser("extract").add_argument("--extractor", default="atomic")
    q = c.add_parser("query")
    q.add_argument("pattern")
    q.add_argument("--budget", type=int)
    q.add_argument("--scope", type=lambda s: [x for x in s.split(",") if x])
    k = c.add_parser("contradict")
    k.add_argument("keys", type=int, nargs="+")
    k.add_argument("--budget", type=int)
    a = c.add_parser("adopt")
    a.add_argument("keys", type=int, nargs="+")
    a.add_argument("--actor", default="cli")
    for name in ("delete", "revive"):
        c.add_parser(name).add_argument("ids", nargs="+")
    for name in ("er", "scan"):
        c.add_parser(name).add_argument("--budget", type=int)
    for name in ("review", "proposal"):
        s = c.add_parser(name).add_subparsers(dest="action", required=True)
        s.add_parser("list")
        for d in ("approve", "reject"):
            x = s.add_parser(d)
            x.add_argument("a", type=int)
            x.add_argument("b", type=int)
            x.add_argument("--actor", required=True)
    r = c.add_parser("resolve")
    r.add_argument("--restage", type=int)
    r.add_argument("--actor", default="cli")
    c.add_parser("evidence").add_argument("keys", type=int, nargs="+")
    p_ = c.add_parser("propose", help="ask a chat-completions endpoint for contradictions")
    p_.add_argument("--url", default="")
    p_.add_argument("--model", default="")
    p_.add_argument("--key-env", help="variable that holds the endpoint's key")
    p_.add_argument("--budget", type=int)
    e = c.add_parser("eval").add_subparsers(dest="action", required=True)
    m = e.add_parser("claims")
    m.add_argument("--corpus", required=True)
    m.add_argument("--run", required=True)
    m = e.add_parser("manifest")
    m.add_argument("--extractor-version")
    m.add_argument("--out", help="folder that the manifest is written to")
    c.add_parser("dump").add_argument("to")
    c.add_parser("restore").add_argument("source")
    return p


def answer(g: ClaimGraph, o: argparse.Namespace, now: int) -> dict | list:
    day = o.as_of if o.as_of is not None else now // 86400
    match o.command:
        case "version":
            return {"version": "1"}
        case "ingest":
            return {"outcomes": g.ingest(read_json_stream(g.spark, o.stream), day)}
        case "extract":
            return {"episodes": [r.asDict() for r in g.extract(now * 1000, o.extractor).collect()]}
        case "query":
            return g.query(o.pattern, day, o.budget, o.scope)
        case "contradict":
            return g.contradict(o.keys, o.budget)
        case "adopt":
            out = g.adopt(o.keys, o.actor, now)
            if bad := [r["claim_key"] for r in out if r["outcome"] == "refused"]:
                raise Refusal("adopt_refused", f"claim {bad[0]} is not staged; those before it were adopted")
            return {"adopted": out}
        case "delete":
            return {"outcomes": g.delete(o.ids, now)}
        case "revive":
            return {"outcomes": g.revive(o.ids)}
        case "er":
            return g.er(now, day, o.budget)
        case "scan":
            return g.scan(now, day, o.budget)
        case "review" | "proposal":
            if o.action == "list":
                return {"open": g.review_list(now) if o.command == "review" else g.proposal_list()}
            return g.decide("reviews" if o.command == "review" else "contradiction_proposals", o.a, o.b, "approved" if o.action == "approve" else "rejected", o.actor, now)
        case "resolve":
            if o.restage is not None:
                if g.restage(o.restage, o.actor, now) != "restaged":
                    raise Refusal("resolve_failed", f"claim {o.restage} is not a superseded rejected claim")
                return {"restaged": o.restage}
            return {"claims": [r.asDict() for r in g.resolve().orderBy("claim_key").toLocalIterator()]}
        case "evidence":
            return {"checks": g.evidence_check(o.keys, now)}
        case "propose":
            try:
                send = http(o.url, o.model, o.key_env)
            except ValueError as e:
                raise Refusal("propose_unconfigured", str(e)) from None
            return g.propose(send, now, day, o.model, o.budget)
        case "eval":
            return g.eval_claims(o.corpus, o.run) if o.action == "claims" else g.eval_manifest(o.extractor_version, o.out)
        case "dump":
            return {"tables": g.store.dump(o.to)}
        case "restore":
            if g.store.manifest():
                raise Refusal("restore_refused", "the store is not empty")
            return {"tables": g.store.restore(o.source)}


def main(argv: list[str] | None = None, spark=None, now: int | None = None) -> tuple[int, dict]:
    o = parser().parse_args(argv)
    try:
        with open(o.config) if o.config else __import__("io").StringIO() as f:
            conf = cfg.parse(f.read())
    except ValueError as e:
        return 1, cfg.refusal("config_parse", str(e), "write `key = number` lines with known keys")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    prepare(spark)
    try:
        data = answer(ClaimGraph(spark, o.db, conf), o, int(time.time()) if now is None else now)
    except Refusal as e:
        return 1, cfg.refusal(e.args[0], e.args[1], "look at the present state with query, review list or resolve, and try again")
    except Exception as e:
        code = "malformed_stream" if o.command == "ingest" else "store_error"
        return 1, cfg.refusal(code, str(e).splitlines()[0][:300], "check the input and the store's folder")
    return 0, cfg.envelope(o.command, data if isinstance(data, dict) else {"rows": data})


if __name__ == "__main__":
    code, out = main()
    print(json.dumps(out, ensure_ascii=False))
    sys.exit(code)
