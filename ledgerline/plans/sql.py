"""The catalog's queries once more, in DuckDB SQL over the driver's tables."""

from __future__ import annotations

WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
AS_OF, WINDOW, BUDGET, PATTERN, SCOPE = 20088, 365, 5000, "the", "lang:en"
HEDGES = ["may", "might", "could", "possibly", "appears", "seems", "signals", "estimates", "reportedly", "tentative", "uncertain"]
STOPS = ["the", "a", "an", "and", "or", "of", "in", "on", "for", "to", "with", "by", "we", "i", "you", "they", "he", "she", "it", "not", "but", "if", "when", "once", "this", "that", "as", "at", "is", "was", "there", "here", "am"]


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def norm(x: str) -> str:
    return f"lower({collapse(x)})"


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def days(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])') THEN date_diff('day', DATE '1970-01-01', make_date(CAST({x}[1:4] AS INTEGER), CAST({x}[6:7] AS INTEGER), 1)) + CAST({x}[9:10] AS INTEGER) - 1 END"


def iso(n: str) -> str:
    return f"strftime(DATE '1970-01-01' + CAST({n} AS INTEGER), '%Y-%m-%d')"


def hedges(x: str) -> str:
    one = ", ".join(f"CASE WHEN regexp_matches(lower({x}), '(^|[^\\p{{L}}\\p{{N}}]){h}($|[^\\p{{L}}\\p{{N}}])') THEN '{h}' END" for h in HEDGES)
    return f"list_filter([{one}], lambda h: h IS NOT NULL)"


def quoted(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


EP = """ep AS (SELECT doc_id, 'doc-' || doc_id AS id, text, CASE WHEN doc_id % 7 <> 0 THEN 'span' ELSE 'absent' END AS loc_kind, CASE WHEN doc_id % 7 <> 0 THEN 'doc:' || doc_id END AS loc_value,
  source AS source_type, CASE WHEN doc_id % 11 <> 0 THEN strftime(DATE '2023-01-01' + CAST(doc_id % 700 AS INTEGER), '%Y-%m-%d') END AS data_cutoff, CAST(doc_id % 4 AS SMALLINT) AS authority_tier, ['lang:' || lang, 'source:' || source] AS tags FROM documents)"""
CL = f"""ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '{WS}*')) AS l FROM documents)),
cl AS (SELECT CAST(row_number() OVER (ORDER BY doc_id, p) - 1 AS BIGINT) AS claim_key, doc_id, CAST(p - 1 AS INTEGER) AS pos, line AS text FROM ln),
cs AS (SELECT *, CASE WHEN claim_key % 10 = 0 THEN 'rejected' WHEN claim_key % 10 BETWEEN 1 AND 3 THEN 'active' ELSE 'staged' END AS status FROM cl)"""
LI = """li AS (SELECT claim_key * 2 AS seq, claim_key, 'doc-' || doc_id AS episode_id, CASE WHEN claim_key % 3 = 0 THEN 'v1' ELSE 'v2' END AS extractor_version FROM cs
  UNION ALL SELECT claim_key * 2 + 1, claim_key, 'doc-' || (doc_id + 1), CASE WHEN claim_key % 3 = 0 THEN 'v1' ELSE 'v2' END FROM cs WHERE claim_key % 13 = 0)"""
BASE = f"{EP},\n{CL},\n{LI}"


def hits(claims: str = "cs", lineage: str = "li", pattern: str = PATTERN, budget: int | None = BUDGET, scope: list[str] | None = None, as_of: int = AS_OF, window: int = WINDOW) -> str:
    """CTEs that end in `hits`."""
    limit = f"ORDER BY claim_key LIMIT {budget}" if budget is not None else ""
    cond = "" if scope is None else f"WHERE list_has_any(tags, [{quoted(scope)}])" if scope else "WHERE false"
    return f"""wk AS (SELECT * FROM {claims} {limit}),
sp AS (SELECT l.claim_key, min(e.authority_tier) AS authority_tier, max({days('e.data_cutoff')}) AS cutoff_days, arg_min(e.data_cutoff, l.seq) FILTER (e.data_cutoff IS NOT NULL) AS raw,
  string_agg(l.episode_id, ',' ORDER BY l.seq) AS episodes, flatten(list(e.tags)) AS tags
  FROM {lineage} l JOIN ep e ON l.episode_id = e.id GROUP BY l.claim_key),
hits AS (SELECT w.claim_key, w.text, w.status, s.authority_tier, coalesce({iso('s.cutoff_days')}, s.raw) AS cutoff, CAST(s.cutoff_days AS INTEGER) AS cutoff_days, coalesce(s.cutoff_days < {as_of - window}, false) AS stale, s.episodes
  FROM (SELECT * FROM wk WHERE contains(lower(text), '{pattern.lower()}')) w JOIN sp s USING (claim_key) {cond}),
rk AS (SELECT *, row_number() OVER (ORDER BY stale, authority_tier, cutoff_days DESC NULLS LAST, claim_key) AS rank FROM hits)"""


#: Rows that the corpus lacks, the same on both sides.
SEED_CLAIMS = [
    "The service is up.", "The service is not up.", "There are retries left.", "There are no retries left.", "The limit is 30 items", "The limit is 60 items", "The limit is 30.", "The limit is 60.",
    "It holds 3 of 4", "It holds 5 of 6", "It is not up", "It never is up", "It is not, up", "It is up", "exact  Text 1", " EXACT text 1 ", "alpha beta gamma", "alpha beta", "audit", "the preaudits ran",
    "Bob invested early.", "Robert invested early.", "a b", "x a b y",
]
SEED_SHAPES = [
    "Is it up?", 'He asked "why?" and left.', "# Setup", "Setup", "CASH FLOW The firm pays", "Cash Flow", "Home > Docs", "a | b | c", "- next steps", "1. The cache holds entries.", "See chapter 3 for details.", "the following chapter is short",
    "Plain sentence that stays here.", "* item", "2) go", "3.5 litres of fuel", "-next steps", "12) go on with it now or then", "+ One. Two", "7 pears", "•", "NASA ESA. The", "Cash Flow The firm", "Profits may vary", "maybe not", "may_be so", "It COULD seem; estimates vary", "12.5 percent reportedly rose", "",
]
ALIASES = [("bob", "robert"), ("alpha", "audit"), ("the", "service")]


def values(rows: list[str], name: str) -> str:
    body = ", ".join(f"({k}, {quoted([r])})" for k, r in enumerate(rows))
    return f"{name} AS (SELECT CAST(k AS BIGINT) AS k, t FROM (VALUES {body}) v(k, t))"


MIXED = f"""{BASE},
{values(SEED_CLAIMS, 'sd')},
cm AS (SELECT k AS claim_key, CAST(0 AS BIGINT) AS doc_id, t AS text, 'staged' AS status FROM sd UNION ALL SELECT claim_key + 100, doc_id, text, status FROM cs),
lm AS (SELECT k * 2 AS seq, k AS claim_key, 'doc-' || (k % 3) AS episode_id FROM sd UNION ALL SELECT seq + 200, claim_key + 100, episode_id FROM li)"""
#: Pairs and claims that the budgeted passes examine and walk.
PAIR_BUDGET, WALK = 1500, 1200
MARK = "'<#>'"
NORMED = f"""nm AS (SELECT *, {norm('text')} AS norm FROM rk),
nt AS (SELECT *, {toks('norm')} AS tk FROM nm),
nf AS (SELECT *, array_to_string(list_filter(tk, lambda t: t NOT IN ('not', 'no', 'never')), ' ') AS strip, len(list_filter(tk, lambda t: t IN ('not', 'no', 'never'))) > 0 AS neg,
  array_to_string(list_transform(tk, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+([.][0-9]+)?') THEN {MARK} ELSE t END), ' ') AS mask FROM nt)"""


def groups(key: str, name: str) -> str:
    return f"{name} AS (SELECT {key}, min(rank) AS first FROM nf GROUP BY {key} HAVING count(*) > 1)"


NEG = """neg AS (SELECT 1 AS phase, g.first AS k1, a.rank AS k2, b.rank AS k3, 'negation-marker' AS rule, true AS hit, least(a.claim_key, b.claim_key) AS from_claim, greatest(a.claim_key, b.claim_key) AS to_claim
  FROM nf a JOIN nf b ON a.strip = b.strip AND a.neg AND NOT b.neg JOIN gs g ON g.strip = a.strip)"""
NUM = """num AS (SELECT 2 AS phase, g.first AS k1, a.rank AS k2, b.rank AS k3, 'numeric-mismatch' AS rule,
  len(list_filter(list_zip(a.tk, b.tk), lambda z: z[1] <> z[2])) = 1 AND coalesce(len(list_filter(list_zip(a.tk, b.tk), lambda z: z[1] <> z[2] AND regexp_full_match(z[1], '[0-9]+([.][0-9]+)?') AND regexp_full_match(z[2], '[0-9]+([.][0-9]+)?'))) = 1, false) AS hit,
  least(a.claim_key, b.claim_key) AS from_claim, greatest(a.claim_key, b.claim_key) AS to_claim FROM nf a JOIN nf b ON a.mask = b.mask AND a.rank < b.rank JOIN gm g ON g.mask = a.mask)"""
EQ = """eq AS (SELECT 1 AS phase, g.first AS k1, a.rank AS k2, b.rank AS k3, 'normalization-equal' AS rule, true AS hit, least(a.claim_key, b.claim_key) AS from_claim, greatest(a.claim_key, b.claim_key) AS to_claim
  FROM nf a JOIN nf b ON a.norm = b.norm AND a.rank < b.rank JOIN gn g ON g.norm = a.norm)"""
GRAMS = "list_distinct(flatten(list_transform(list_filter(tk, lambda t: length(t) >= 4), lambda t: list_transform(range(1, length(t) - 2), lambda i: t[i:i+3]))))"
CONT = f"""dn AS (SELECT norm, any_value(tk) AS tk, count(*) AS n FROM nf GROUP BY norm),
gr AS (SELECT norm, n, unnest({GRAMS}) AS gram FROM dn),
gd AS (SELECT gram, sum(n) AS df FROM gr GROUP BY gram),
ra AS (SELECT norm, gram FROM (SELECT norm, gram, row_number() OVER (PARTITION BY norm ORDER BY df, gram) AS r FROM gr JOIN gd USING (gram)) WHERE r = 1),
ca AS (SELECT ra.norm AS an, gr.norm AS bn FROM ra JOIN gr USING (gram) WHERE strlen(gr.norm) > strlen(ra.norm)
  UNION ALL SELECT a.norm, b.norm FROM dn a JOIN dn b ON strlen(b.norm) > strlen(a.norm) WHERE a.norm NOT IN (SELECT norm FROM ra)),
co AS (SELECT 2 AS phase, a.rank AS k1, b.rank AS k2, 0 AS k3, 'normalization-contains' AS rule, contains(bn, an) AS hit, a.claim_key AS from_claim, b.claim_key AS to_claim FROM ca JOIN nf a ON a.norm = an JOIN nf b ON b.norm = bn)"""
ALIAS = f"""al AS (SELECT * FROM (VALUES {', '.join(str(a) for a in ALIASES)}) v(a, b)),
tq AS (SELECT DISTINCT rank, claim_key, unnest(tk) AS token FROM nf),
ap AS (SELECT DISTINCT CASE WHEN x.rank < y.rank THEN x.claim_key ELSE y.claim_key END AS i, CASE WHEN x.rank < y.rank THEN y.claim_key ELSE x.claim_key END AS j FROM al JOIN tq x ON x.token = al.a JOIN tq y ON y.token = al.b WHERE x.rank <> y.rank),
aq AS (SELECT 3 AS phase, i AS k1, j AS k2, 0 AS k3, 'alias-match' AS rule, true AS hit, least(i, j) AS from_claim, greatest(i, j) AS to_claim FROM ap)"""


def proposed(parts: list[str], budget: int | None) -> str:
    every = " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
    cut = f"ORDER BY phase, k1, k2, k3 LIMIT {budget}" if budget is not None else ""
    return f"""pr AS (SELECT * FROM ({every}) {cut}),
ph AS (SELECT *, row_number() OVER (PARTITION BY least(from_claim, to_claim), greatest(from_claim, to_claim) ORDER BY phase, k1, k2, k3) AS r, count(*) OVER (PARTITION BY least(from_claim, to_claim), greatest(from_claim, to_claim)) - 1 AS refused FROM pr WHERE hit)
SELECT from_claim, to_claim, rule, refused FROM ph WHERE r = 1"""


def pass_sql(parts: list[str], budget: int | None, walk: int | None = None) -> str:
    need = {"neg": [groups("strip", "gs"), NEG], "num": [groups("mask", "gm"), NUM], "eq": [groups("norm", "gn"), EQ], "co": [CONT], "aq": [ALIAS]}
    made = ",\n".join(x for p in parts for x in need[p])
    return f"WITH {MIXED},\n{hits('cm', 'lm', '', walk)},\n{NORMED},\n{made},\n{proposed(parts, budget)}"


WHOLE = f"WITH {MIXED},\n{hits('cm', 'lm', '', None)},\n{NORMED}"


def shape(text: str, episode: str) -> str:
    c = collapse(text)
    w = toks("c")
    letters = "regexp_replace(x, '[^\\p{L}]', '', 'g')"
    caps = f"list_transform(w, lambda x: length({letters}) >= 2 AND regexp_full_match({letters}, '\\p{{Lu}}+'))"
    title = f"list_transform(w, lambda x: lower(x) NOT IN ({quoted(STOPS)}) AND regexp_full_match({letters}, '\\p{{Lu}}\\p{{Ll}}*'))"
    opens = lambda run: f"coalesce(regexp_matches(w[{run} + 1], '^\\p{{Lu}}') AND regexp_matches(w[{run}], '[\\p{{L}}\\p{{N}}]$'), false)"
    return f"""s1 AS (SELECT *, {c} AS c FROM cand),
s2 AS (SELECT *, {w} AS w FROM s1),
s3 AS (SELECT *, coalesce(list_position({caps}, false) - 1, len(w)) AS cr, {title} AS ti FROM s2),
s4 AS (SELECT *, (cr >= 2 AND (cr = len(w) OR {opens('cr')})) OR (len(w) >= 2 AND ti[1] AND ti[2] AND (len(w) = 2 OR {opens('2')})) AS glued,
  starts_with(c, '#') OR (c <> '' AND len(list_filter(regexp_split_to_array({episode}, '\\r?\\n'), lambda l: starts_with(l, '#') AND {collapse('l[2:]')} = c)) > 0) AS heading,
  CASE WHEN c[1] IN ('-', '*', '+', '•') THEN ltrim(c[2:]) WHEN len(nums) > 0 AND c[len(nums) + 1] IN ('.', ')') THEN ltrim(c[len(nums) + 2:]) END AS rest, rest IS NOT NULL AS listed FROM (SELECT *, left(c, length(c) - length(ltrim(c, '0123456789'))) AS nums FROM s3)),
sh AS (SELECT *, CASE WHEN ends_with(c, '?') THEN 'interrogative_final' WHEN heading OR glued THEN 'heading_fragment'
  WHEN contains(c, ' > ') OR length(c) - length(replace(c, '|', '')) >= 2 OR (listed AND (rest = '' OR (NOT regexp_matches(rest, '[.!?]') AND len({toks('rest')}) <= 6)))
    OR contains(lower(c), 'following chapter') OR contains(lower(c), 'next chapter') OR regexp_matches(lower(c), '(^| )(part|parts|chapter|chapters|section|sections|appendix|appendices) [0-9]') THEN 'nav_boilerplate' END AS shape FROM s4)"""


SEED_EPISODE = "# Setup\nProfits may vary by run.\n## Other"
BATCH = """ba AS (
  SELECT doc_id * 4 AS pos, CASE WHEN doc_id % 29 = 7 THEN '  ' ELSE id END AS id, CASE WHEN doc_id % 31 = 3 THEN ' ' || chr(9) WHEN doc_id % 6 = 0 THEN text || ' changed' ELSE text END AS text, CASE WHEN doc_id % 37 = 4 THEN '' ELSE source_type END AS source_type, loc_kind, loc_value, data_cutoff, authority_tier, tags FROM ep
  UNION ALL SELECT doc_id * 4 + 1, id, text, source_type, loc_kind, loc_value, data_cutoff, authority_tier, tags FROM ep WHERE doc_id % 5 = 0),
st AS (SELECT * FROM ep WHERE doc_id % 3 = 0), tb AS (SELECT id AS episode_id FROM ep WHERE doc_id % 17 = 5)"""
EVENTS = """ss AS (SELECT claim_key AS seq, claim_key FROM cs WHERE status = 'rejected' AND claim_key % 4 <> 2),
iv AS (SELECT claim_key AS seq, claim_key, 'doc-' || (doc_id + 1) AS causing_episode_id FROM cs WHERE claim_key % 14 = 3),
ex AS (SELECT id AS episode_id, CASE WHEN doc_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS extractor_version FROM ep WHERE doc_id % 5 <> 4)"""
REVIEWS = """rv AS (SELECT claim_key AS seq, claim_key AS from_claim, claim_key + 1 AS to_claim, CASE WHEN claim_key % 3 = 0 THEN 'proposed' WHEN claim_key % 3 = 1 THEN 'resolved_rejected' ELSE 'resolved_approved' END AS status,
  'normalization-equal' AS evidence, 'f' || (claim_key % 4) AS fingerprint, 1000 + claim_key % 50 AS queued_at FROM cs WHERE claim_key % 9 < 4)"""
EVAL = f"""go AS (SELECT CAST(claim_key AS BIGINT) AS pos, 'doc-' || doc_id AS episode_id, text, {hedges('text')} AS hedges FROM cs WHERE claim_key % 3 <> 1),
cd AS (SELECT CAST(claim_key AS BIGINT) AS pos, CASE WHEN claim_key % 41 = 0 THEN 'nowhere' ELSE 'doc-' || doc_id END AS episode_id, text, CASE WHEN claim_key % 2 = 0 THEN text ELSE text || ' ' || text || ' x' END AS span FROM cs WHERE claim_key % 5 <> 2)"""

SQL: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, md5({norm('text')}) AS norm_md5, CAST(length({norm('text')}) AS INTEGER) AS n FROM documents",
    "nfc_ids": "SELECT doc_id, nfc_normalize('e' || chr(769) || '-' || doc_id) AS id FROM documents",
    "blank_classify": f"SELECT doc_id, CASE WHEN regexp_full_match(i, '{WS}*') THEN 'missing_id' WHEN regexp_full_match(t, '{WS}*') THEN 'missing_text' WHEN s = '' THEN 'missing_metadata' ELSE 'ok' END AS verdict FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN ' ' || chr(160) ELSE 'x' END AS i, CASE WHEN doc_id % 5 = 1 THEN chr(9) || chr(10) || chr(8195) ELSE text END AS t, CASE WHEN doc_id % 3 = 1 THEN '' ELSE source END AS s FROM documents)",
    "dates": f"SELECT doc_id, CAST({days('d')} AS INTEGER) AS days, {iso(days('d'))} AS iso FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'May 2026' WHEN doc_id % 9 = 1 THEN NULL ELSE CAST(2000 + doc_id % 40 AS VARCHAR) || '-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') END AS d FROM documents)",
    "slugs": f"SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT doc_id, trim(regexp_replace({norm('text')}, '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)",
    "episodes": f"WITH {EP} SELECT id, text, loc_kind, loc_value, source_type, data_cutoff, authority_tier, array_to_string(tags, ',') AS tags FROM ep",
    "claims": f"WITH {CL} SELECT claim_key, doc_id, pos, text, status FROM cs",
    "lineage": f"WITH {CL},\n{LI} SELECT seq, claim_key, episode_id, extractor_version FROM li",
    "conversation_episodes": "SELECT conv_id || '-' || turn AS id, text, role AS source_type FROM conversations",
    "search_unscoped": f"WITH {BASE},\n{hits()} SELECT claim_key, text, status, authority_tier, cutoff, stale, episodes FROM hits",
    "search_scoped": f"WITH {BASE},\n{hits(scope=[SCOPE])} SELECT claim_key, text, status, authority_tier, cutoff, stale, episodes FROM hits",
    "search_empty_scope": f"WITH {BASE},\n{hits(scope=[])} SELECT claim_key, text, status, authority_tier, cutoff, stale, episodes FROM hits",
    "search_whole": f"WITH {BASE},\n{hits(budget=None, scope=[SCOPE])} SELECT claim_key, text, status, authority_tier, cutoff, stale, episodes FROM hits",
    "search_ranked": f"WITH {BASE},\n{hits(budget=256, pattern='', as_of=19800)} SELECT rank, claim_key, stale, authority_tier, cutoff FROM rk",
    "search_status": f"WITH {CL} SELECT least(count(*), {BUDGET}) AS walked, CASE WHEN count(*) > {BUDGET} THEN 'budget-exhausted' ELSE 'complete' END AS status FROM cs",
    "ingest_coverage": f"WITH {EP}, de AS (SELECT DISTINCT 'doc-' || doc_id AS stable_id FROM documents UNION SELECT 'doc-' || (doc_id + 5) FROM documents WHERE doc_id % 2 = 0) SELECT count(*) + 7 AS declared, count(e.id) AS persisted FROM de LEFT JOIN ep e ON e.id = de.stable_id",
    "extraction_coverage": f"WITH {BASE},\n{EVENTS}, dd AS (SELECT l.episode_id, l.extractor_version FROM li l JOIN cs c USING (claim_key) GROUP BY ALL HAVING bool_and(c.status = 'rejected' AND c.claim_key IN (SELECT claim_key FROM ss))), lv AS (SELECT DISTINCT x.episode_id FROM ex x WHERE NOT EXISTS (SELECT 1 FROM dd d WHERE d.episode_id = x.episode_id AND d.extractor_version = x.extractor_version)) SELECT count(*) - count(lv.episode_id) AS gaps, count(*) AS total FROM ep LEFT JOIN lv ON lv.episode_id = ep.id",
    "ingest_outcomes": f"""WITH {EP}, {BATCH}, nb AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth FROM ba),
jo AS (SELECT b.*, t.episode_id IS NOT NULL AS dead, s.id IS NOT NULL AS held, (b.text, b.loc_kind, b.loc_value, b.source_type, b.data_cutoff, b.authority_tier, b.tags) IS NOT DISTINCT FROM (s.text, s.loc_kind, s.loc_value, s.source_type, s.data_cutoff, s.authority_tier, s.tags) AS same FROM nb b LEFT JOIN tb t ON t.episode_id = b.id LEFT JOIN st s ON s.id = b.id),
rs AS (SELECT *, CASE WHEN nth > 1 THEN 'duplicate' WHEN regexp_full_match(id, '{WS}*') THEN 'missing_id' WHEN regexp_full_match(text, '{WS}*') THEN 'missing_text' WHEN source_type = '' THEN 'missing_metadata' WHEN dead THEN 'deleted_id' WHEN held AND NOT same THEN 'conflict' END AS reason FROM jo)
SELECT pos, id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN held THEN 'already_persisted' ELSE 'persisted' END AS outcome, reason FROM rs""",
    "declared_ids": f"WITH {EP}, {BATCH} SELECT DISTINCT id AS stable_id FROM ba WHERE trim(id) <> ''",
    "coverage_digest": f"""WITH {EP}, {BATCH}, di AS (SELECT DISTINCT id FROM ba WHERE trim(id) <> ''), al AS (SELECT count(*) AS n, string_agg(id || chr(10), '' ORDER BY id) AS line FROM di)
SELECT printf('%016x', CAST(list_reduce(list_transform(string_split(line, ''), lambda c: CAST(ascii(c) AS HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT)) AS UBIGINT)) AS run_id, n AS declared_count, CAST(20088 AS BIGINT) AS created_at_days FROM al WHERE n > 0""",
    "delete_guard": f"WITH {BASE}, wa AS (SELECT 'doc-' || (doc_id + 3) AS id FROM documents) SELECT wa.id, CASE WHEN e.id IS NULL THEN 'episode_not_found' WHEN EXISTS (SELECT 1 FROM li WHERE li.episode_id = wa.id AND li.claim_key % 2 = 0) THEN 'delete_refused' ELSE 'deleted' END AS outcome FROM wa LEFT JOIN ep e ON e.id = wa.id",
    "revive": f"WITH {EP}, {BATCH} SELECT id, CASE WHEN id IN (SELECT episode_id FROM tb) THEN 'revived' ELSE 'revive_refused' END AS outcome FROM ep",
    "scan_negation": f"{WHOLE} SELECT claim_key, neg AS negated, first FROM (SELECT *, min(claim_key) OVER w AS first, bool_or(neg) OVER w AS one, bool_and(neg) OVER w AS all_of FROM nf WINDOW w AS (PARTITION BY strip)) WHERE one AND NOT all_of",
    "scan_numeric": f"""{WHOLE}, dt AS (SELECT min(claim_key) AS claim_key, any_value(tk) AS tk FROM nf GROUP BY norm), pl AS (SELECT *, unnest(range(1, len(tk) + 1)) AS i FROM dt),
mk AS (SELECT claim_key, CAST(i - 1 AS INTEGER) AS place, list_transform(tk, lambda t, j: CASE WHEN j = i THEN NULL ELSE t END) AS rest FROM pl WHERE regexp_full_match(tk[i], '[0-9]+([.][0-9]+)?'))
SELECT claim_key, place, min(claim_key) OVER w AS first, count(*) OVER w AS n FROM mk WINDOW w AS (PARTITION BY place, rest) QUALIFY count(*) OVER w > 1""",
    "scan_budget": pass_sql(["neg", "num"], 40, WALK),
    "er_equality": f"{WHOLE} SELECT claim_key, min(claim_key) OVER w AS first, count(*) OVER w AS n FROM nf WINDOW w AS (PARTITION BY norm) QUALIFY count(*) OVER w > 1",
    "er_containment": f"{WHOLE},\n{CONT}, ky AS (SELECT norm, min(claim_key) AS key FROM nf GROUP BY norm) SELECT a.key AS from_claim, b.key AS to_claim FROM (SELECT DISTINCT an, bn FROM ca WHERE contains(bn, an)) JOIN ky a ON a.norm = an JOIN ky b ON b.norm = bn",
    "er_alias": pass_sql(["aq"], None),
    "er_budget": pass_sql(["eq", "co", "aq"], PAIR_BUDGET, WALK),
    "er_classes": f"WITH {CL} SELECT {norm('text')} AS norm, count(*) AS n, min(claim_key) AS first FROM cs GROUP BY 1 HAVING count(*) > 1",
    "contradictions_read": f"WITH {BASE}, ed AS (SELECT claim_key AS seq, claim_key AS from_claim, claim_key + 2 AS to_claim, CASE WHEN claim_key % 3 = 0 THEN 'contradicts' ELSE 'mentions' END AS label FROM cs), qk AS (SELECT unnest([3, 4, 9, 15, 300, 301, 302]) AS k), sd AS (SELECT c.claim_key, c.text, c.status, string_agg(l.episode_id, ',' ORDER BY l.seq) AS episodes FROM cs c JOIN li l USING (claim_key) JOIN ep e ON e.id = l.episode_id GROUP BY ALL), w AS (SELECT * FROM ed ORDER BY seq LIMIT 400) SELECT w.from_claim, w.to_claim, f.text AS from_text, t.text AS to_text, f.status AS from_status, t.status AS to_status, f.episodes AS from_episodes, t.episodes AS to_episodes FROM w JOIN sd f ON f.claim_key = w.from_claim JOIN sd t ON t.claim_key = w.to_claim WHERE label = 'contradicts' AND (from_claim IN (SELECT k FROM qk) OR to_claim IN (SELECT k FROM qk))",
    "contradictions_staged": f"WITH {BASE}, {EVENTS}, sd AS (SELECT c.claim_key, c.text, c.status, string_agg(l.episode_id, ',' ORDER BY l.seq) AS episodes FROM cs c JOIN li l USING (claim_key) JOIN ep e ON e.id = l.episode_id GROUP BY ALL), w AS (SELECT * FROM iv ORDER BY seq LIMIT 390) SELECT claim_key, text, status, episodes, causing_episode_id FROM w JOIN sd USING (claim_key) WHERE claim_key IN (3, 17, 31, 45, 300)",
    "hedge_markers": f"WITH {CL}, {values(SEED_SHAPES, 'sd')}, cand AS (SELECT -k - 1 AS k, t AS text FROM sd UNION ALL SELECT claim_key, text FROM cs) SELECT k, array_to_string({hedges('text')}, ',') AS hedges FROM cand",
    "shape_filter": f"WITH {CL}, {values(SEED_SHAPES, 'sd')}, cand AS (SELECT -k - 1 AS k, t AS text, '# Setup' || chr(10) || 'Profits may vary by run.' || chr(10) || '## Other' AS et FROM sd UNION ALL SELECT claim_key, cs.text, d.text FROM cs JOIN documents d USING (doc_id)), {shape('text', 'et')} SELECT k, shape FROM sh",
    "section_filter": f"WITH {EP} SELECT id, CASE WHEN doc_id % 8 = 2 THEN 'section-kind:praise' WHEN doc_id % 8 = 5 THEN 'section-kind:copyright' END AS section FROM ep",
    "pending": f"WITH {BASE}, {EVENTS} SELECT id FROM ep WHERE id NOT IN (SELECT episode_id FROM ex WHERE extractor_version = 'v2')",
    "superseded": f"WITH {BASE}, {EVENTS}, pe AS (SELECT id FROM ep WHERE id NOT IN (SELECT episode_id FROM ex WHERE extractor_version = 'v2')) SELECT claim_key FROM cs WHERE status = 'staged' AND claim_key IN (SELECT claim_key FROM li WHERE episode_id IN (SELECT id FROM pe)) AND claim_key NOT IN (SELECT claim_key FROM li WHERE extractor_version = 'v2')",
    "invalidations": f"WITH {CL}, ac AS (SELECT claim_key, doc_id, {collapse('text')} AS own FROM cs WHERE status = 'active'), ca AS (SELECT doc_id, {collapse('text')} AS new FROM cs WHERE claim_key % 7 < 2), kn AS (SELECT claim_key FROM cs WHERE claim_key % 21 = 1) SELECT DISTINCT a.claim_key, 'doc-' || a.doc_id AS causing_episode_id FROM ac a JOIN ca c ON a.doc_id = c.doc_id AND a.own <> c.new WHERE a.claim_key NOT IN (SELECT claim_key FROM kn)",
    "identity_report": f"WITH {BASE}, {EVENTS} SELECT c.claim_key, c.status, coalesce(l.e, '') AS episodes, coalesce(s.n, 0) AS supersessions, coalesce(i.e, '') AS causes FROM cs c LEFT JOIN (SELECT claim_key, string_agg(episode_id, ',' ORDER BY seq) AS e FROM li GROUP BY 1) l USING (claim_key) LEFT JOIN (SELECT claim_key, count(*) AS n FROM ss GROUP BY 1) s USING (claim_key) LEFT JOIN (SELECT claim_key, string_agg(causing_episode_id, ',' ORDER BY seq) AS e FROM iv GROUP BY 1) i USING (claim_key)",
    "review_queue": f"WITH {BASE}, {REVIEWS}, n AS (SELECT claim_key, count(*) AS n FROM li GROUP BY 1) SELECT seq, from_claim, to_claim, evidence, greatest(1030 - queued_at, 0) AS age, coalesce(f.n, 0) AS from_episodes, coalesce(t.n, 0) AS to_episodes FROM rv LEFT JOIN n f ON f.claim_key = from_claim LEFT JOIN n t ON t.claim_key = to_claim WHERE status = 'proposed'",
    "review_resolved": f"WITH {BASE}, {REVIEWS}, de AS (SELECT to_claim AS from_claim, from_claim AS to_claim, CASE WHEN seq % 2 = 0 THEN 'approved' ELSE 'rejected' END AS decision, CASE WHEN seq % 5 = 0 THEN ' ' ELSE 'ann' END AS actor FROM rv) SELECT d.from_claim, d.to_claim, o.seq, CASE WHEN o.seq IS NULL OR trim(d.actor) = '' THEN 'refused' ELSE 'resolved_' || d.decision END AS outcome FROM de d LEFT JOIN (SELECT * FROM rv WHERE status = 'proposed') o ON o.from_claim = d.to_claim AND o.to_claim = d.from_claim",
    "merge_lineage": f"WITH {BASE}, {REVIEWS} SELECT DISTINCT r.from_claim AS claim_key, l.episode_id, l.extractor_version FROM rv r JOIN li l ON l.claim_key = r.to_claim WHERE r.status = 'proposed' AND NOT EXISTS (SELECT 1 FROM li o WHERE o.claim_key = r.from_claim AND o.episode_id = l.episode_id AND o.extractor_version = l.extractor_version)",
    "repropose_guard": f"WITH {BASE}, {REVIEWS}, pp AS (SELECT claim_key + 1 AS from_claim, claim_key AS to_claim, 'f' || (claim_key % 3) AS fingerprint FROM cs) SELECT p.from_claim, p.to_claim, CASE WHEN r.status = 'proposed' THEN 'already_proposed' WHEN r.status = 'resolved_rejected' AND r.fingerprint = p.fingerprint THEN 'rejected_without_new_evidence' ELSE 'queued' END AS outcome FROM pp p LEFT JOIN rv r ON r.from_claim = p.to_claim AND r.to_claim = p.from_claim",
    "proposal_queue": f"WITH {BASE}, {REVIEWS} SELECT seq, from_claim, to_claim, queued_at FROM rv WHERE status = 'proposed'",
    "edges_inserted": f"WITH {CL}, ed AS (SELECT claim_key AS from_claim, claim_key + 2 AS to_claim, 'contradicts' AS label FROM cs WHERE claim_key % 2 = 0), wn AS (SELECT claim_key AS from_claim, 'contradicts' AS label, claim_key + 2 AS to_claim FROM cs) SELECT w.from_claim, w.label, w.to_claim, CASE WHEN w.to_claim NOT IN (SELECT claim_key FROM cs) THEN 'unknown_claim' WHEN e.label IS NOT NULL THEN 'duplicate_edge' ELSE 'inserted' END AS outcome FROM wn w LEFT JOIN ed e ON e.from_claim = w.from_claim AND e.to_claim = w.to_claim",
    "evidence_states": f"WITH {BASE}, tb AS (SELECT id AS episode_id FROM ep WHERE doc_id % 17 = 5), fi AS (SELECT claim_key, arg_min(episode_id, seq) AS episode_id FROM li WHERE claim_key % 19 <> 4 GROUP BY 1), cx AS (SELECT claim_key, CASE WHEN claim_key % 6 = 1 THEN NULL WHEN claim_key % 6 = 2 THEN text || '~' ELSE text END AS span FROM cs) SELECT c.claim_key, f.episode_id, CASE WHEN t.episode_id IS NOT NULL THEN 'tombstoned' WHEN e.id IS NULL OR c.span IS NULL OR NOT contains({collapse('e.text')}, {collapse('c.span')}) THEN 'unresolvable' ELSE 'resolved' END AS state, e.authority_tier AS observed_tier FROM cx c LEFT JOIN fi f USING (claim_key) LEFT JOIN tb t ON t.episode_id = f.episode_id LEFT JOIN ep e ON e.id = f.episode_id",
    "adopt_prefix": f"WITH {CL}, wa AS (SELECT claim_key AS pos, claim_key FROM cs WHERE status = 'staged' UNION ALL SELECT 2 * max(claim_key) // 3, 0 FROM cs), s AS (SELECT min(pos) AS stop FROM wa WHERE claim_key NOT IN (SELECT claim_key FROM cs WHERE status = 'staged')) SELECT pos, claim_key, CASE WHEN pos < stop THEN 'adopted' WHEN pos = stop THEN 'refused' ELSE 'not_tried' END AS outcome FROM wa, s WHERE NOT (pos = stop AND claim_key <> 0)",
    "restage": f"WITH {BASE}, {EVENTS} SELECT claim_key, CASE WHEN status = 'rejected' AND claim_key IN (SELECT claim_key FROM ss) THEN 'restaged' ELSE 'refused' END AS outcome FROM cs",
    "statuses": f"WITH {CL} SELECT claim_key, CASE WHEN claim_key % 8 = 1 THEN 'active' WHEN claim_key % 8 = 5 THEN 'rejected' ELSE status END AS status FROM cs",
    "live_candidates": f"WITH {BASE} SELECT c.claim_key, l.episode_id FROM cs c JOIN li l USING (claim_key) WHERE status IN ('staged', 'active') AND l.extractor_version = 'v2'",
    "eval_counts": f"""WITH {BASE}, {EVAL}, gf AS (SELECT *, {norm('text')} AS form FROM go), cf AS (SELECT c.*, {norm('c.text')} AS form, e.id IS NOT NULL AS known, coalesce(contains({collapse('e.text')}, {collapse('c.span')}), false) AS inside FROM cd c LEFT JOIN ep e ON e.id = c.episode_id),
cr AS (SELECT *, sum(CASE WHEN inside THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id, form ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM cf), gn AS (SELECT episode_id, form, count(*) AS n FROM gf GROUP BY ALL),
ju AS (SELECT CASE WHEN NOT known OR coalesce(ahead, 0) >= coalesce(n, 0) THEN 'spurious' WHEN NOT inside THEN 'content-miss' ELSE 'matched' END AS reason FROM cr LEFT JOIN gn USING (episode_id, form))
SELECT count(*) AS emitted, (SELECT count(*) FROM go) AS golden, count(*) FILTER (reason = 'matched') AS matched, count(*) FILTER (reason = 'content-miss') AS content_miss, count(*) FILTER (reason = 'spurious') AS spurious, CAST(0 AS BIGINT) AS hedge_dropped, count(*) FILTER (reason = 'matched') / count(*) AS precision, count(*) FILTER (reason = 'matched') / (SELECT count(*) FROM go) AS recall, CAST(NULL AS DOUBLE) AS hedge_preservation, 'hedge_preservation' AS unknown_metrics FROM ju""",
}
