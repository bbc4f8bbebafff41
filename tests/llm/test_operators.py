"""Each operator against brute force, its library or a round trip, and on nulls, empty tables, repeats and clashing columns."""

import hashlib
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import chosen_path, huffman, induced, pieces, quality_net, repeats, secrets, templates, tiles, token_files, tool_calls, warc
from ledgerline.llm.queries import vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.selectExpr("*", "1 AS rep", "'x' AS key", "2 AS h1", "3 AS label", "'y' AS component") if extra else df


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


# near-duplicates ----------------------------------------------------------------------------------------------------


def shingles(text, k):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_groups(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(3)
    rows = [(k, words(rng, rng.randrange(20, 200), 5000)) for k in range(60)]
    base = words(rng, 150, 5000)
    rows += [(100 + k, edited(rng, base, rng.randrange(0, 6))) for k in range(150)]  # one large group
    shared = words(rng, 40, 5000)
    rows += [(300 + k, shared + " " + words(rng, 60, 5000)) for k in range(120)]  # a passage in common
    for k in range(40):
        rows.append((500 + k, edited(rng, rows[k][1], rng.randrange(0, 5))))
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "One two"), (604, "one  TWO"), (605, "solo"), (606, rows[0][1].upper()), (607, "x " * 3000)]
    return rows


def test_near_duplicates_equal_brute_force(spark, near_rows):
    got = chosen_path.near_duplicates(frame(spark, near_rows, extra=True), 4, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(near_rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_blocks_equal_brute_force(spark, near_rows, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    got = chosen_path.near_duplicates(frame(spark, near_rows), 4, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(near_rows, 4, 80)


def test_near_duplicates_of_nothing_and_of_repeats(spark):
    assert chosen_path.near_duplicates(frame(spark, [])).count() == 0
    got = chosen_path.near_duplicates(frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (6, 5, False)]
    assert chosen_path.keep_one(frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f")])).count() == 1


def test_exact_groups_skip_nothing():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = [np.unique(rng.integers(0, 400, 60).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(40):
            b = base[rng.integers(4)].copy()
            drop = rng.random(len(b)) > rng.choice([0.02, 0.1, 0.2])
            sets.append(np.unique(np.r_[b[drop], rng.integers(500, 9000, rng.integers(0, 9)).astype(np.uint64)]))
        label = chosen_path.exact_groups(sets, 80)
        link = [[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets]
        want = list(range(40))
        for _ in range(40):
            want = [min(want[j] for j in range(40) if link[i][j]) for i in range(40)]
        assert label.tolist() == want


# secrets -----------------------------------------------------------------------------------------------------------


def test_secret_layers():
    import base64
    import gzip
    from urllib.parse import quote

    inner = "password = hunter22x"
    for wrapped in (
        base64.b64encode(inner.encode()).decode(),
        base64.b64encode(gzip.compress(inner.encode())).decode(),
        quote("x " + inner + " y", safe=""),
        "".join(f"\\u{ord(c):04x}" for c in inner),
        quote(base64.b64encode(base64.b64encode(zlib.compress(inner.encode()))).decode() + "%", safe=""),
    ):
        text = f"some words {wrapped} and more"
        base, every, layers, cut = secrets.scan(text)
        assert base == [] and layers and not cut and [k for *_, k in every] == [0], wrapped
        s, e, _ = every[0]
        assert text[s:e] in wrapped and s >= 11
    text = "a%70assword%3Dabcdef9 end"
    (s, e, k) = secrets.scan(text)[1][0]
    assert (text[s:e], k) == ("%70assword%3Dabcdef9", 0)


def test_equal_layers_are_reported_at_every_place():
    import base64
    import gzip
    from urllib.parse import quote

    inner = "password = hunter22x"
    plain = base64.b64encode(inner.encode()).decode()
    for run in (plain, base64.b64encode(gzip.compress(inner.encode())).decode(), quote(inner, safe=""), "".join(f"\\u{ord(c):04x}" for c in inner), quote(plain + "%", safe="")):
        text = f"a {run} b {run} c {plain} d"
        assert len({s for s, *_ in secrets.scan(text)[1]}) == 3, run
        assert run not in secrets.redacted(text) and plain not in secrets.redacted(text)
    assert len(secrets.scan(f"{inner}; {plain}")[1]) == 2  # a layer equal to a part of the text
    assert len(secrets.scan(" ".join([plain] * 50))[1]) == 50


def test_secret_layers_are_whole(monkeypatch):
    import base64
    import gzip
    import textwrap

    inner = "".join(f"line {k} of words, " for k in range(40)) + "password = hunter22x" + " and more" * 20
    b64 = lambda raw: base64.b64encode(raw).decode()
    noise = random.Random(1).randbytes(3000)
    members = gzip.compress(b"first " + noise.hex(" ").encode()) + gzip.compress(inner.encode())
    for width in (64, 70, 76):
        for raw in (inner.encode(), gzip.compress((noise.hex(" ") + inner).encode()), members, zlib.compress(inner.encode())):
            for end in ("\n", "\r\n", "\n  ", "\\n"):
                body = end.join(textwrap.wrap(b64(raw), width))
                text = f"key word{end}{body} tail"
                assert 0 in {k for *_, k in secrets.scan(text)[1]}, (width, end)
    for run in ("a%E9b&password%3Dabcdefgh", b64(b"\xe9\x00 password=abcdefgh \xff"), b64(gzip.compress(b"\xe9 password=abcdefgh"))):
        assert secrets.redacted(f"x {run} y").count("[assign]") == 1, run
    big = ("some words of text.\n" * 40_000 + "é") * 3 + inner
    monkeypatch.setattr(secrets, "MOST_BYTES", 1 << 20)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 16)
    _, every, _, cut = secrets.scan(b64(gzip.compress(big.encode())))
    assert len(every) == 1 and not cut


def test_secrets_in_random_nestings_are_found_and_redacted():
    """Independent of the scanner: what was wrapped is known, so any span must lie in the wrapped run and cover it for opaque layers."""
    import base64
    import bz2
    import gzip
    import lzma
    from urllib.parse import quote

    import zstandard

    rng = random.Random(21)
    b64 = lambda raw: base64.b64encode(raw).decode()
    wraps = [lambda t: b64(t.encode()), lambda t: b64(gzip.compress(t.encode())), lambda t: b64(zlib.compress(t.encode())), lambda t: b64(bz2.compress(t.encode())), lambda t: b64(lzma.compress(t.encode())), lambda t: b64(zstandard.ZstdCompressor().compress(t.encode())), lambda t: "".join(f"%{b:02X}" for b in t.encode()), lambda t: quote(t, safe=""), lambda t: "".join(f"\\u{ord(c):04x}" for c in t)]
    for _ in range(400):
        secret = f"password={rng.randrange(10**9, 10**10)}xyz"
        run = secret
        for _ in range(rng.randrange(1, 5)):
            run = rng.choice(wraps)(run)
            if len(run) > 20_000:
                break
        text = f"{words(rng, 5)} é {run} {words(rng, 5)} {run} end"
        places = [text.index(run), text.rindex(run)]
        spans = [(s, e) for s, e, k in secrets.scan(text)[1] if k == 0]
        assert all(any(p <= s and e <= p + len(run) for s, e in spans) for p in places), (run[:80], spans)
        clean = secrets.redacted(text)
        assert run not in clean and secret not in clean and not [k for *_, k in secrets.scan(clean)[1] if k == 0]


def test_secret_scans_of_long_texts_without_spaces_are_linear():
    import time

    for text in ("x" * 500_000 + "%" + "y" * 500_000, "é" * 700_000 + "\\u" + "z" * 300_000, "%" * 1_000_000, "a%4" * 300_000, "\\" * 700_000, "QUFB" * 250_000, "ab-cd/" * 170_000 + "\n" + "=" * 1000):
        began = time.perf_counter()
        secrets.scan(text)
        assert time.perf_counter() - began < 10, text[:12]


def test_secret_base_kinds():
    text = 'Password: "abc" token=abcdef api_key : AKIA' + "Q" * 20 + " " + "0a" * 12 + " " + "0a" * 11
    base = secrets.base_spans(text)
    assert secrets.joined(base) == f"assign:16:28,assign:29:63,access:{text.index('AKIA')}:{text.index('AKIA') + 24},hex:64:88"
    assert secrets.redacted("x token=abcdef y") == "x [assign] y"
    assert secrets.scan("")[:2] == ([], [])


def test_secret_queries_take_anything(spark):
    rows = [(1, None), (2, ""), (3, "token=abcdefg"), (3, "token=abcdefg"), (4, "x" * 200_000 + " secret=0123456789")]
    got = {(r.doc_id, r.n_assign) for r in secrets.secret_spans(frame(spark, rows, extra=True)).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (4, 1)}
    assert secrets.secret_spans(frame(spark, [])).count() == 0
    assert {r.text for r in secrets.redact(frame(spark, rows[:3], extra=True)).collect()} == {None, "", "[assign]"}


# embeddings --------------------------------------------------------------------------------------------------------


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 32)
    rng = np.random.default_rng(2)
    rows = []
    centre = rng.normal(size=(6, 16))
    for k in range(220):
        v = centre[k % 6] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4])
        rows.append((k, v.astype(np.float32).tolist(), k % 3))
    rows += [(300, rows[0][1], rows[0][2]), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, rows[1][1], None), (305, [], 1), (306, [None] * 16, 1)]
    got = tiles.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    good = [(i, np.array(v, np.float64), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: {i} for i, *_ in rows}
    for i, v, l in good:
        for j, u, m in good:
            if i != j and l == m and v @ u / np.sqrt(v @ v) / np.sqrt(u @ u) >= 0.93:
                near[i].add(j)
    comp = {i: i for i in near}
    for _ in near:
        comp = {i: min(comp[j] for j in near[i]) for i in near}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((i, len(near[i]) - 1, comp[i]) for i in near)


def test_quantisation_bound_holds():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(300, 64))
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    q, s, length, err = tiles.quantise(u)
    approx = tiles.int8_product(q, q) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - approx) <= length[:, None] * err[None, :] + err[:, None] + 1e-12).all()


# WARC ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "<p>" + "palaver " * 200
    rows = [(k, f"http://x/{k}", f"<html>{k} {long if k % 3 else ''}</html>" if k % 5 else long) for k in range(900)] + [(1000, None, None), (1001, "u\r\nX: y", ""), (1002, "a", "short"), (1003, "a", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS last")
    manifest = warc.write_pages(pages)
    got = {r.page_id: r for r in warc.read_pages(manifest).collect()}
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, 0), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        r = got[i]
        refers = last[h] if h in last and last[h] != i else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers else "response", refers)
    assert warc.read_pages(warc.write_pages(pages.limit(0))).count() == 0


def test_warc_of_few_pages_and_ties(spark):
    rows = [(7, "u", "x" * 2000), (7, "v", "x" * 2000), (5, "w", "x" * 2000), (7, "y", "other " * 300_000)]
    got = warc.read_pages(warc.write_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(5, 2000, "revisit", 7), (7, 2000, "response", None), (7, 2000, "response", None), (7, 1_800_000, "response", None)]
    few = warc.trained([b"WARC/1.1 one record alone"])
    assert few == b"WARC/1.1 one record alone"


# repeats -----------------------------------------------------------------------------------------------------------


def brute_repeats(rows, n=repeats.LENGTH):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for (d, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)  # with 1, every anchor is split by what stands beside it
    rng = random.Random(5)
    passage, other = words(rng, 150, 9000), words(rng, 400, 9000)
    rows = [(k, words(rng, rng.randrange(5, 400), 9000)) for k in range(30)]
    rows += [(40 + k, words(rng, 60, 9000) + " " + passage[k * 3 :] + " é" + words(rng, 50, 9000)) for k in range(12)]
    rows += [(60, other), (61, other), (62, edited(rng, other, 1)), (63, other[100:501]), (64, other[100:499]), (65, "ab" * 700), (66, "z" * 400), (67, "z" * 401), (68, None), (69, ""), (70, passage + passage), (60, other), (71, "the " * 9000)]
    rows += [(100 + k, words(rng, rng.randrange(3), 9000) + other[300:800] + words(rng, 30, 9000)) for k in range(40)]  # one passage beside many different ones
    got = repeats.without_repeats(frame(spark, rows, extra=True)).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats(rows)
    assert repeats.without_repeats(frame(spark, [])).count() == 0


def test_repeats_split_parts_until_they_are_small(spark, monkeypatch, tmp_path):
    def counting(run, folder=str(tmp_path)):
        """run, that notes the most contexts of one anchor that it gets for sorting."""

        def own(batches):
            def noted():
                for b in batches:
                    if "shard" in b.schema.names and b.num_rows:
                        most = max(Counter(b.column("anchor").to_pylist()).values())
                        open(f"{folder}/{most}-{random.random()}", "w").close()
                    yield b

            return run(noted())

        return own

    monkeypatch.setattr(repeats, "HOT", 20)
    monkeypatch.setattr(repeats, "frugal", counting)
    rng = random.Random(21)
    head, other = words(rng, 90, 9000)[:390], words(rng, 90, 9000)[:430]
    rows = [(k, words(rng, k % 3, 9000) + head + words(rng, 60, 9000)) for k in range(150)]  # too short to repeat but for what is planted
    rows += [(200 + k, rows[k][1][:440] + words(rng, 30, 9000)) for k in range(0, 150, 7)]
    rows += [(400 + k, other[k:] + words(rng, 50, 9000)) for k in range(60)]
    got = repeats.without_repeats(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats(rows)
    assert 1 < max(int(x.name.split("-")[0]) for x in tmp_path.iterdir()) <= 20


def test_repeats_of_a_long_run_of_one_byte(spark):
    rows = [(1, "z" * 100_000), (2, "z" * 399 + "y"), (2, "z" * 399 + "y"), (3, "ab" * 30_000 + "c" * 399)]
    began = time.monotonic()
    got = {tuple(r)[:4] for r in repeats.without_repeats(frame(spark, rows)).collect()}
    assert got == {(1, 100_000, 100_000, 1), (2, 400, 400, 1), (3, 60_399, 60_000, 1)}
    assert time.monotonic() - began < 40  # each of 100,000 starts is a run of its own; it took 98 s when all pairs of them were compared


def peak_mb(run, batch):
    """Most that Python and numpy hold at once while run works off a batch."""
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_repeats_take_little_memory_whatever_a_batch_holds():
    rng = np.random.default_rng(8)
    text = rng.integers(97, 123, 6 << 20, dtype=np.uint8).tobytes().decode()
    assert peak_mb(repeats.anchors, pa.RecordBatch.from_pylist([{"doc_id": 1, "h1": 1, "text": text}])) < 120
    runs = [{"lo": at, "hi": at + 100, "at": at + 200, "anchor": at, "hot": False} for at in range(0, 500_000, 500)]
    rows = [{"doc_id": k, "h1": k, "copies": 1, "text": text[k << 17 : (k << 17) + 501_000], "runs": runs} for k in range(40)]
    assert peak_mb(repeats.contexts, pa.RecordBatch.from_pylist(rows)) < 30


def test_runs_in_pieces_are_those_of_the_whole(monkeypatch):
    rng = random.Random(12)
    passage = words(rng, 300, 9000)
    text = words(rng, 1500, 9000) + passage + "ab" * 900 + "z" * 1500 + words(rng, 700, 9000) + passage
    batch = pa.RecordBatch.from_pylist([{"doc_id": k, "h1": k, "text": x} for k, x in enumerate([text, "", "z" * 400, text[::-1]])])
    whole = [pa.Table.from_batches(repeats.anchors(iter([batch]))).to_pylist()]
    for piece in (400, 401, 1024, 5000):
        monkeypatch.setattr(repeats, "PIECE", piece)
        whole.append(pa.Table.from_batches(repeats.anchors(iter([batch]))).to_pylist())
    assert all(x == whole[0] for x in whole) and len(whole[0]) > 50


def test_suffix_order_with_disk():
    rng = np.random.default_rng(4)
    for k in range(120):
        t = rng.integers(0, [2, 3, 257][k % 3], rng.integers(1, 150)).astype(np.uint16)
        t = np.tile(t[: max(1, len(t) // 5)], 5) if k % 4 == 0 else t
        own = t.tolist()
        assert induced.suffix_order(t, 257, 400, held=[3, 40, 10**6][k % 3]).tolist() == sorted(range(len(own)), key=lambda i: own[i:])


# token files --------------------------------------------------------------------------------------------------------


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(6)
    for _ in range(20):
        c = rng.integers(0, 1000, 300)
        n = huffman.code_lengths(c).astype(int)
        heap = [int(x) for x in c if x]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert (n * c).sum() == cost and (n[c > 0] > 0).all()
    deep = huffman.code_lengths(np.array([2**k for k in range(40)]))
    assert deep.max() <= huffman.LONGEST and sum(2.0 ** -int(x) for x in deep) <= 1
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_huffman_file_round_trip():
    rng = np.random.default_rng(8)
    for size in (1, 5, huffman.BLOCK, huffman.BLOCK * 7 + 3):
        ids = (rng.zipf(1.3, size) % 5000).astype(np.uint32)
        n = huffman.code_lengths(np.bincount(ids, minlength=5000))
        data = huffman.written(np.array([4]), np.array([size]), ids, n, huffman.canonical(n))
        docs, sizes, back = huffman.read(data)
        assert docs.tolist() == [4] and sizes.tolist() == [size] and (back == ids).all()


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    rng = random.Random(1)
    rows = [(9, None), (3, ""), (5, " lead"), (6, "trail "), (7, "two  spaces"), (8, "tab\t x y\n z"), (10, "don't <|endoftext|> won't"), (11, "über naïve, 12.5%! x's y"), (12, words(rng, 3000)), (13, "日本 語。 ok"), (2, "a b."), (2, "a b."), (14, "x½ y² a_b c'd, 'e f'"), (15, "é, q́́.")]
    library = Tokenizer.from_file(path)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.read_token_files(token_files.write_token_files(frame(spark, rows, extra=True), path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert token_files.read_token_files(token_files.write_token_files(frame(spark, []), path)).count() == 0


# pieces ------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    own = pieces.Pieces(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(2)
    odd = ["", " ", "  ", "   a", "a  b   ", "日本語 test", "a▁b", "▁", "▁▁ x", "\n\n a\tb", "x" * 70, " " * 61, " 😀 ok", "é", "the and of tion" * 9]
    odd += ["".join(rng.choice("abcdehinorstu ,.▁éß") for _ in range(rng.randrange(1, 60))) for _ in range(800)]
    for t in odd:
        ids = own.library.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t).tolist() == ids, t
    rows = [(k, t) for k, t in enumerate(odd[:30])] + [(99, None)]
    for r in pieces.piece_digests(frame(spark, rows, extra=True), vocabulary("piece_bpe_32k.model")).collect():
        ids = own.library.encode(dict(rows)[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(own.library.decode(ids).encode()).hexdigest()


# quality -----------------------------------------------------------------------------------------------------------


def test_quality_learns_and_takes_anything(spark):
    rng = random.Random(9)
    good = lambda: ". ".join(words(rng, 8, 300).capitalize() for _ in range(rng.randrange(3, 12)))
    bad = lambda: " ".join(w + "%%%" for w in words(rng, rng.randrange(20, 90), 300).split())
    rows = [(k, good() if k % 3 else bad()) for k in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows] + [(5000, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [*rows, (700, None), (701, ""), (702, "Fine words. " * 9000)], extra=True)
    got = {r.doc_id: r for r in quality_net.quality_scores(docs, labels).collect()}
    held = [i for i, _ in rows if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert sum(got[i].predicted == int(i % 3 != 0) for i in held) >= 0.97 * len(held)
    assert 0 <= got[700].score <= 1 and got[700].score == got[701].score
    assert quality_net.keep_good(docs, labels).columns == docs.columns
    assert quality_net.quality_scores(frame(spark, []), labels.limit(0)).count() == 0


def test_quality_network_equals_a_naive_one():
    rng = np.random.default_rng(12)
    texts = [b"", b"short", bytes(rng.integers(0, 256, 500, dtype=np.uint8)), "é words of text. ".encode() * 30]
    net = quality_net.Network()
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    got = net.score(*quality_net.steps_of(raw, off))
    w, n = net.w, quality_net.STEP
    for t, g in zip(texts, got, strict=True):
        steps = max(1, -(-len(t) // n)) + 1
        codes = [*t, *[quality_net.PAD] * (steps * n - len(t))]
        x = [np.concatenate([w["vectors"][c] for c in codes[k * n : (k + 1) * n]]) for k in range(steps)]
        top = np.max([x[k] @ w["left"] + x[k + 1] @ w["right"] for k in range(steps - 1)], axis=0)
        assert abs(1 / (1 + np.exp(-(np.maximum(top + w["shift"], 0) @ w["out"] + w["bias"][0]))) - g) < 1e-4


def test_quality_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(3)
    texts, y = [bytes(rng.integers(32, 127, k, dtype=np.uint8)) for k in (30, 200, 90)], np.array([1, 0, 1], np.float32)
    net = quality_net.Network()
    net.weight = 4.0
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    codes = quality_net.steps_of(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])

    def loss():
        p = net.score(*codes)
        return float(np.mean(np.where(y == 1, -np.log(p), -net.weight * np.log(1 - p))))

    slope = net.gradient(texts, y)
    for name, g in slope.items():
        for at in [np.unravel_index(int(np.abs(g).argmax()), g.shape), *[tuple(rng.integers(0, s) for s in g.shape) for _ in range(3)]]:
            held, e = net.w[name][at], 1e-6
            net.w[name][at] = held + e
            up = loss()
            net.w[name][at] = held - e
            down = loss()
            net.w[name][at] = held
            assert abs((up - down) / (2 * e) - g[at]) < 1e-3 * max(1, abs(g[at])), (name, at)


def test_quality_of_long_texts_in_pieces(monkeypatch):
    raw = np.frombuffer(random.Random(4).randbytes(200_000), np.uint8)
    own = quality_net.steps_of(raw, np.array([0, len(raw)]))
    whole = quality_net.Network().score(*own)
    monkeypatch.setattr(quality_net, "PIECE", 100)
    assert np.allclose(quality_net.Network().score(*own), whole, atol=1e-6)


def test_quality_of_repeated_rows_and_long_labelled_texts(spark):
    rows = [(k, ("Good words here. " if k % 2 else "b@d!! ") * (3000 if k < 20 else 5)) for k in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    got = quality_net.quality_scores(frame(spark, [*rows, rows[3], (4, "Good words here. ")], extra=True), labels).collect()
    assert len(got) == 202 and len({r.score for r in got if r.doc_id == 3}) == 1
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id != 4)


# templates -----------------------------------------------------------------------------------------------------------


def test_templates_find_changed_questions(spark):
    item = "A train leaves Boston with 120 people and after 15 min it meets 120 more people near Boston again"
    rows = [
        (1, "Intro words here. " + item + ". And more."),
        (2, "Intro. " + item.replace("120", "77").replace("15", "9").replace("Boston", "Madrid") + ", indeed"),
        (3, item.replace("120", "77", 1)),  # the two equal numbers now differ
        (4, "nothing of the kind in here at all my friend"),
        (5, None),
        (6, ""),
        (7, "... %% --"),
        (8, item.upper().lower()),
    ]
    bench = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (13, "Only three words")], "item_id bigint, text string")
    got = {r.doc_id: r for r in templates.leaks(frame(spark, rows, extra=True), bench).collect()}
    assert set(got) >= {1, 2} and not set(got) & {3, 4, 5, 6, 7}
    assert not got[1].changed and got[2].changed
    assert {r.doc_id for r in templates.clean(frame(spark, rows), bench).collect()} >= {3, 4, 5, 6, 7}
    assert templates.leaks(frame(spark, []), bench).count() == 0 and templates.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def found(spark, item, *texts):
    """n_found and n_windows by number of the text, with a share of nothing asked for."""
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: (r.n_found, r.n_windows) for r in templates.leaks(frame(spark, list(enumerate(texts))), bench, percent=0).collect()}
    return [got.get(k, (0, 0)) for k in range(len(texts))]


SHOP = "A shop sells Tom 5 kg of rice for 12 usd, 3 kg of beans for 7 usd and 2 kg of salt for 4 usd. How much does Tom pay for 10 kg?"
OTHER_SHOP = SHOP.translate(str.maketrans({"5": "41", "3": "62", "7": "83", "4": "94"})).replace("12", "55").replace("10", "66").replace(" 2 ", " 77 ").replace("Tom", "Eve")


def test_templates_find_dense_questions(spark):
    hens = "On the farm Tom has 3 hens, Ann has 5 hens and Bob has 7 hens"
    others = hens.replace("Tom", "Eve").replace("Ann", "Kim").replace("Bob", "Joe").replace("3", "31").replace("5", "52").replace("7", "73")
    assert all(n * 100 >= of * 80 for n, of in [*found(spark, SHOP, "So. " + OTHER_SHOP), *found(spark, hens, "So. " + others)])
    assert found(spark, "12 5 and 3 8 and 4 9", "so 13 6 and 7 1 and 2 4") == [(0, 0)]  # nothing but placeholders beside one word


def test_templates_find_copies_in_any_case(spark):
    item = "A train leaves Boston with 120 people and after 15 min it meets 120 more people near Boston again"
    assert found(spark, item, item.lower(), item.upper(), item.title()) == [(15, 15)] * 3


def test_templates_drop_only_windows_that_break_the_mapping(spark):
    rest = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(50))
    item = "first 40 pears and " + rest + " last 40 plums end"
    once = item.replace("40", "41", 1)
    assert found(spark, item, once, "so " + item.replace("40", "7")) == [(52, 54), (54, 54)]
    # two values that become equal: one of them stands
    two = "it has 40 pears and " + rest + " and 40 plums with 50 apples here"
    n, of = found(spark, two, "so " + two.replace("40", "9").replace("50", "9"))[0]
    assert 0.8 * of <= n < of


def test_templates_find_short_items_inside_texts(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "What is two?"), (2, "Yes no"), (3, "Where are 4 pears?")], "item_id bigint, text string")
    rows = [(1, "So he asked. What is two? Nobody knew it then."), (2, "what is two"), (3, "She said yes no and went on"), (4, "yes, no!"), (5, "And where are 77 pears? Gone, all of them"), (6, "where are two pears then"), (7, "what is"), (7, "what is two")]
    want = {(1, 1), (2, 1), (4, 2), (5, 3), (7, 1)}
    for most in (templates.BROADCAST_ROWS, 0):  # beyond the bound the join shuffles, with salted windows
        monkeypatch.setattr(templates, "BROADCAST_ROWS", most)
        assert {(r.doc_id, r.item_id) for r in templates.leaks(frame(spark, rows, extra=True), bench).collect()} == want
    clash = frame(spark, rows).selectExpr("*", "1 AS _leaking", "2 AS _kept", "3 AS item_id", "4 AS h")
    assert sorted(r.doc_id for r in templates.clean(clash, bench).collect()) == [3, 6]
    assert chosen_path.keep_one(clash).columns == clash.columns


# tool calls ------------------------------------------------------------------------------------------------------------


def test_tool_calls_are_linked_ordered_and_checked(spark):
    import json

    calls = spark.createDataFrame(
        [("a", 1, 0, "get", {"q": 'x "y"\n\u0001', "n": "3"}, []), ("b", 1, 1, "get", {"n": "03", "z": "1"}, ["a"]), ("c", 1, 2, "get", {"q": "42", "n": "1"}, ["b", "a", "zz"]), ("d", 1, 3, "put", None, ["e"]), ("e", 1, 4, "get", {"q": None}, ["d"]), ("a", 1, 9, "get", {}, []), ("a", 2, 0, "get", {"q": "other"}, ["b"]), ("a", None, 0, "get", {}, [])],
        "call_id string, conv_id bigint, turn bigint, name string, arguments map<string,string>, after array<string>",
    ).selectExpr("*", "1 AS level", "'x' AS content", "2 AS fields")
    results = spark.createDataFrame([(1, "a", 5, "ok"), (1, "a", 6, "later"), (1, "q", 1, "nobody"), (2, "a", 3, "two")], "conv_id bigint, call_id string, turn bigint, content string")
    schemas = spark.sql("SELECT 'get' AS name, array(named_struct('name','q','kind','string','required',true), named_struct('name','n','kind','integer','required',false)) AS fields")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.linked(calls, results, schemas).collect()}
    assert {k: r.level for k, r in got.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): None, (1, "e"): None, (2, "a"): 0}
    assert {k: r.faults for k, r in got.items()} == {(1, "a"): "", (1, "b"): "missing:q,type:n,unknown:z", (1, "c"): "", (1, "d"): "schema:put", (1, "e"): "missing:q", (2, "a"): ""}
    assert got[1, "a"].result_turn == 5 and got[1, "b"].result_turn is None and got[2, "a"].result_turn == 3
    want = {"arguments": {"n": 3, "q": 'x "y"\n\u0001'}, "id": "a", "name": "get", "result": "ok"}
    assert got[1, "a"].json == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, "c"].json)["arguments"] == {"n": 1, "q": "42"}  # a string that spells a number stays a string
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "hi"), (1, 1, "assistant", "hi"), (None, 1, "user", "x"), (2, 3, "system", "s" * 100_000)], "conv_id bigint, turn bigint, role string, text string")
    assert sorted((r.call_id, r.valid) for r in tool_calls.linked(*tool_calls.from_turns(turns)).collect()) == [("1-0", False), ("2-3", False)]
    assert tool_calls.linked(*tool_calls.from_turns(turns.limit(0))).count() == 0


def test_tool_call_kinds_equal_brute_force(spark):
    """Against Python's json: every value with every kind."""
    import json

    values = ["1", "-5", "01", "1.50", "-0.25", "1e5", "true", "True", "", "a", 'a"b', "{}", '{"b": 1, "a": [true, null, {"z": "é", "y": 2.50}]}', "[1, 2]", "[", "null", '"x"']
    kinds = ["string", "integer", "number", "boolean", "object", "array", "enum:a|b|true"]

    def brute(v, kind):
        """(valid, value)"""
        if kind == "string":
            return True, v
        if kind.startswith("enum:"):
            return v in kind[5:].split("|"), v
        try:
            x = json.loads(v)
        except ValueError:
            return False, v
        ok = {"integer": type(x) is int, "number": type(x) in (int, float) and "e" not in v, "boolean": type(x) is bool, "object": type(x) is dict, "array": type(x) is list}[kind]
        return (True, x) if ok else (False, v)

    rows = [(f"{i}-{j}", 1, 0, k, {"v": v}, []) for i, v in enumerate(values) for j, k in enumerate(kinds)]
    calls = spark.createDataFrame(rows, "call_id string, conv_id bigint, turn bigint, name string, arguments map<string,string>, after array<string>")
    schemas = spark.createDataFrame([(k, [("v", k, True)]) for k in kinds], "name string, fields array<struct<name:string,kind:string,required:boolean>>")
    results = spark.createDataFrame([], "conv_id bigint, call_id string, turn bigint, content string")
    for r in tool_calls.linked(calls, results, schemas).collect():
        i, j = map(int, r.call_id.split("-"))
        ok, value = brute(values[i], kinds[j])
        assert r.valid == ok, (values[i], kinds[j], r.json)
        want = {"arguments": {"v": value}, "id": r.call_id, "name": kinds[j], "result": None}
        assert r.json == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False), (values[i], kinds[j])
