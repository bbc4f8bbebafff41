"""Queries of the catalog over the whole of their tables."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import pairs, substrings
from ledgerline.plans.catalog import QUERIES, Graph


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, "\n".join(f"Claim {chr(97 + k % 26)}{chr(97 + k // 26)} {w} stands here and says nothing more." for w in ("one", "two", "three"))) for k in range(600)]
    last = "Profits will never fall in that year.\nProfits will fall in that year.\nRates rose to 7 points there.\nRates rose to 9 points there.\nRates rose to 9 points there."
    rows.append((600, last))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_slugs_take_whole_texts(spark, folder):
    d, rows = folder
    got = {r.doc_id: r.slug for r in QUERIES["slugs"](spark, d).collect()}
    assert got[600].endswith("rates-rose-to-9-points-there") and all(got[i].count("-") > 20 for i, _ in rows)


def test_passes_without_a_budget_reach_the_last_claims(spark, folder):
    rules = {q: {(r.claim_key, r.first) for r in QUERIES[q](spark, folder[0]).collect() if r.first >= 1900} for q in ("scan_negation", "scan_numeric", "er_equality")}
    assert rules == {"scan_negation": {(1900, 1900), (1901, 1900)}, "scan_numeric": {(1902, 1902), (1903, 1902)}, "er_equality": {(1903, 1903), (1904, 1903)}}


def test_classes_equal_brute_force(spark):
    rng = random.Random(7)
    pool = ["is", "a", "no", "up", "not", "3", "4.5", "60", "limit", "holds", "preaudits", "audit", "of", "it", "ab"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))) for _ in range(400)] + ["", "a", "ab", "é up", "x é up y", "is no longer a", "s no l"]
    hits = spark.createDataFrame(list(enumerate(texts)), "claim_key bigint, text string")
    least = {}
    for k, t in enumerate(texts):
        least.setdefault(t, k)
    by = lambda f: {x: [k for k, t in enumerate(texts) if f(t) == x] for x in {f(t) for t in texts}}
    assert {tuple(r) for r in pairs.equal_classes(hits).collect()} == {(k, min(m), len(m)) for m in by(lambda t: t).values() if len(m) > 1 for k in m}
    negs, strip = {"not", "no", "never"}, lambda t: " ".join(w for w in t.split() if w not in {"not", "no", "never"})
    neg = lambda k: bool(negs & set(texts[k].split()))
    assert {tuple(r) for r in pairs.negation_classes(hits).collect()} == {(k, neg(k), min(m)) for m in by(strip).values() if len({neg(k) for k in m}) == 2 for k in m}
    apart = lambda a, b: [i for i, (x, y) in enumerate(zip(a.split(), b.split(), strict=True)) if x != y] if len(a.split()) == len(b.split()) else []
    number = lambda w: w.replace(".", "", 1).isdigit()
    rows = pairs.numeric_classes(hits).collect()
    met = {frozenset((a.claim_key, b.claim_key)) for a in rows for b in rows if a.claim_key < b.claim_key and (a.first, a.place) == (b.first, b.place)}
    assert met == {frozenset((least[a], least[b])) for a in least for b in least if a < b and len(d := apart(a, b)) == 1 and number(a.split()[d[0]]) and number(b.split()[d[0]])}
    assert {tuple(r) for r in pairs.contained_classes(hits).collect()} == {(least[a], least[b]) for a in least for b in least if a and a != b and len(a.encode()) < len(b.encode()) and a in b}


def contained(spark, texts):
    hits = spark.createDataFrame(list(enumerate(texts)), "claim_key bigint, text string")
    return sorted(tuple(r) for r in pairs.contained_classes(hits).collect())


def within(texts):
    least = {}
    for k, t in enumerate(texts):
        least.setdefault(t, k)
    return sorted((least[a], least[b]) for a in least for b in least if a and a != b and a in b)


def test_containment_of_all_lengths_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["ab", "tone", "éa", "river", "ß", "stand", "日本", "of", "the", "𝒳y", "or."]
    made = lambda n: " ".join(rng.choice(words) for _ in range(n))
    whole = [made(n) for n in (5, 20, 60, 200, 900) for _ in range(4)]
    parts = []
    for t in whole:
        for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 14, 15, 16, 17, 23, 31, 32, 33, 40, 63, 64, 65, 100, 127, 128, 150, 151, 152, 200, 255, 256, 300, 600):
            k = rng.randrange(max(1, len(t) - n))
            parts += [t[k : k + n].strip(), t[:n].strip(), t[-n:].strip()]
    near = [p[:-1] + "#" for p in parts[::3]] + ["#" + p[1:] for p in parts[1::3]]
    texts = whole + parts + near
    got = contained(spark, texts)
    assert got == within(texts) and len(got) > 10000


def test_containment_of_periodic_texts_and_common_headers(spark):
    header = "this header stands on every page of the site and says where one is " * 6
    texts = ["a" * n for n in (1, 3, 8, 15, 16, 40, 130, 300, 1000, 20000)] + ["ab" * n for n in (4, 10, 100, 5000)] + [header + f"{k} " + "x" * (k % 7) for k in range(60)] + [header.strip(), header[:200].strip(), "no " + header[7:300].strip()]
    texts = [t.strip() for t in texts]
    assert contained(spark, texts) == within(texts)


def test_containment_loses_nothing_in_full_filters(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["river", "stand", "tone", "of", "it"]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += [t[3 : 3 + 4 * k].strip() for k, t in enumerate(texts[:60])]
    one = contained(spark, texts)
    monkeypatch.setattr(substrings, "FEW", 0)  # no broadcast
    monkeypatch.setattr(substrings, "filtered", lambda keys, n: substrings.Filter(0, {0: b"\xff" * (1 << substrings.CHUNK - 3)}))
    assert one == contained(spark, texts) == within(texts)


def written(spark):
    return sum(x.totalShuffleWrite() for x in (lambda s: [s.apply(k) for k in range(s.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def test_containment_moves_less_than_its_texts(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghij    ") for _ in range(3000)).strip() for _ in range(200)]
    before = written(spark)
    assert contained(spark, texts) == []
    assert written(spark) - before < sum(map(len, texts)) / 4


@pytest.mark.parametrize("gone", [[], [1], [0, 1, 2]])
def test_containment_takes_the_lines_of_the_hits(spark, folder, tmp_path, gone):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").filter(~F.col("doc_id").isin(gone) if gone else F.lit(True))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    g = Graph(spark, str(tmp_path))
    assert sorted(map(tuple, g.mixed_keys(g.mixed_lines()).select("claim_key", "text").collect())) == sorted(map(tuple, g.mixed_hits().select("claim_key", "text").collect()))
