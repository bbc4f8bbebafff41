"""Removal of bytes that lie in a string of LENGTH bytes which starts more than once in the corpus.

Every window of LENGTH bytes holds one chosen anchor, its K-gram of least hash; equal windows choose equal anchors. So windows are dealt
by their anchors: starts with one anchor are a run, and a run's context is the text that its windows span. Anchors that occur once in the corpus cannot repeat and go no further. The
contexts of the others meet in shards, equal contexts counted beforehand, and a shard's suffixes are sorted by induction; starts whose first LENGTH bytes
equal a neighbour's are repeated. Texts that are equal as a whole are one text with a count.

An anchor that starts very many runs is split further: equal windows have their anchor at the same place, so its windows are dealt by that
place, in ranges that double, and each range by the bytes beside the anchor that all of its windows hold. A part that still has very many
contexts has its range halved until it has few; at one place all of its windows are equal, so there it is one context.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, frugal, keyed_runs, mix, prefix_hash, slices, stored, text_buffers, texts_of
from .induced import suffix_order

#: Bytes of a repeated string and of an anchor; bytes of contexts in a shard.
LENGTH, K, SHARD = 400, 160, 3 << 20
#: Runs of one anchor, or contexts of a part, beyond which they are split, and the tasks that the rows of one anchor are dealt to.
HOT, SALTS = 5000, 8
#: Bytes that are hashed at once, and those of the rows that a worker gathers before it passes them on.
PIECE, PASSED = 1 << 19, 4 << 20
W = LENGTH - K + 1
VALUES = byte_values(23)


def windowed_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: the end of one block's minima from the left and the start of the next one's from the right."""
    n = len(x) - w + 1
    short = -len(x) % w
    block = np.concatenate([x, np.full(short, x.max(), x.dtype)]).reshape(-1, w)
    right = np.minimum.accumulate(block, axis=1).reshape(-1)
    left = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def runs_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(row, first start, last start, place of the anchor, anchor) of every run in rows of PIECE bytes at most; places are relative to the row."""
    data, rel = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    if len(data) < LENGTH:
        return None
    p, q = prefix_hash(data, VALUES)
    h = mix((p[K:] - p[:-K]) * q[: len(p) - K])
    n = len(h)
    bits = np.uint64(PIECE.bit_length())  # the same everywhere, so equal windows choose by equal keys
    key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    at = (windowed_least(key, W) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(rel, np.arange(len(at)), side="right") - 1
    fine = np.arange(len(at)) + LENGTH <= rel[row + 1]
    start = np.flatnonzero(fine)
    if not len(start):
        return None
    a, r = at[start], row[start]
    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (start[1:] != start[:-1] + 1)])
    tail = np.r_[head[1:], len(start)] - 1
    r = r[head]
    return r, start[head] - rel[r], start[tail] - rel[r], a[head] - rel[r], h[a[head]].view(np.int64)


def runs_in_pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Runs of some rows, or of one row of any length: its windows are taken in pieces, and a run that two pieces share is one."""
    begin, end = int(offsets[0]), int(offsets[-1])
    if end - begin <= PIECE:
        return runs_of(raw, offsets)
    found = []
    for at in range(begin, end - LENGTH + 1, PIECE - LENGTH + 1):
        r, *places, anchor = runs_of(raw, np.array([at, min(end, at + PIECE)]))
        found.append((r, *(x + (at - begin) for x in places), anchor))
    r, lo, hi, place, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.r_[True, place[1:] != place[:-1]]
    return r[new], lo[new], hi[np.r_[new[1:], True]], place[new], anchor[new]


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "h1", "lo", "hi", "at", "anchor", "twice"]
    for batch in batches:
        ids, h1 = batch.column("doc_id").to_numpy(), batch.column("h1").to_numpy()
        raw, offsets = text_buffers(batch.column("text"))
        for s, e in slices(offsets, PIECE):
            found = runs_in_pieces(raw, offsets[s : e + 1])
            if found is None:
                continue
            r, lo, hi, place, anchor = found
            by = np.lexsort((anchor, r))
            same = (r[by][1:] == r[by][:-1]) & (anchor[by][1:] == anchor[by][:-1])
            twice = np.zeros(len(r), bool)
            twice[by[1:][same]], twice[by[:-1][same]] = True, True
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[s + r], h1[s + r], lo, hi, place, anchor, twice)], names)


def part(anchor: int, at: int, lo: int, hi: int, low: int, high: int, text: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(first start, last start, anchor of the part, low, high) of a run's windows with low..high bytes before the anchor, if it has any.

    A window has `j` bytes before its anchor and W - 1 - j behind it. Those with j in low..high all hold the low bytes before and the W - 1 - high
    bytes behind, so equal windows agree there and meet in the same part."""
    first, last = max(lo, at - high), min(hi, at - low)
    if first <= last:
        beside = b"%d:%d:" % (anchor, low) + text[at - low : at] + b":" + text[at + K : at + K + W - 1 - high]
        yield first, last, xxhash.xxh3_64_intdigest(beside) - (1 << 63), low, high


def split(lo: int, hi: int, at: int, anchor: int, hot: bool, text: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """A run, or the parts of a hot one, as part gives them; a whole run has all places."""
    if not hot:
        yield lo, hi, anchor, 0, W - 1
        return
    low, high = 0, 0
    while low < W:
        yield from part(anchor, at, lo, hi, low, high, text)
        low, high = high + 1, min(2 * high + 1, W - 1)


def listed(runs: pa.Array) -> Iterator[Iterator[tuple]]:
    """For each row its runs (lo, hi, at, anchor, hot), one of each: a doc_id that comes twice with one text has its runs twice."""
    bounds = runs.offsets.to_numpy()
    fields = [runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "at", "anchor", "hot")]

    def of(a: int, b: int) -> Iterator[tuple]:
        own = a + np.unique(fields[0][a:b], return_index=True)[1]
        for s in range(0, len(own), 1 << 14):
            yield from zip(*(x[own[s : s + (1 << 14)]].tolist() for x in fields), strict=True)

    return (of(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, h1, copies, text, runs) -> a row a run: the digest of its context, and the context where this batch has it first."""
    names = ["c1", "c2", "anchor", "doc_id", "h1", "lo", "starts", "copies", "place", "low", "high", "context"]
    for batch in batches:
        raw, offsets = text_buffers(batch.column("text"))
        cols: list[list] = [[] for _ in names]
        seen: set[bytes] = set()
        size = 0
        kinds = [pa.int64()] * 11 + [pa.binary()]
        for k, (doc, h1, copies, runs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h1", "copies")), listed(batch.column("runs")), strict=True)):
            text = raw[offsets[k] : offsets[k + 1]].tobytes()
            for (first, last, anchor, low, high), at in ((p, run[2]) for run in runs for p in split(*run, text)):
                own = text[first : last + LENGTH]
                d = xxhash.xxh3_128_digest(own)
                c1, c2 = np.frombuffer(d, np.int64).tolist()
                new = d not in seen
                seen.add(d)
                size += 400 + len(own) * new  # a row's numbers are objects here
                for col, v in zip(cols, (c1, c2, anchor, doc, h1, first, last - first + 1, copies, at - first, low, high, own if new else None), strict=True):
                    col.append(v)
                if size > PASSED:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
                    cols, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of parts that have too many -> those of the parts with half the places, with the context (o1, o2) that holds them and where."""
    names = ["o1", "o2", "off", "c1", "c2", "anchor", "starts", "copies", "place", "low", "high", "context"]
    kinds = [pa.int64()] * 11 + [pa.binary()]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        size = 0
        for k in range(batch.num_rows):
            o1, o2, anchor, starts, copies, place, low, high, text = (batch.column(c)[k].as_py() for c in ("c1", "c2", "anchor", "starts", "copies", "place", "low", "high", "context"))
            middle = (low + high) // 2
            for first, last, new, a, b in (p for ends in ((low, middle), (middle + 1, high)) for p in part(anchor, place, 0, starts - 1, *ends, text)):
                own = text[first : last + LENGTH]
                c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(own), np.int64).tolist()
                size += 400 + len(own)
                for col, v in zip(cols, (o1, o2, first, c1, c2, new, last - first + 1, copies, place - first, a, b, own), strict=True):
                    col.append(v)
            if size > PASSED:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
                cols, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def repeated_starts(parts: list[bytes], starts: np.ndarray, copies: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each context the ranges (first, last) of its starts whose LENGTH bytes start at another counted place too."""
    begin = np.r_[0, np.cumsum([len(p) + 1 for p in parts])]
    text = np.zeros(int(begin[-1]), np.uint16)
    for p, b in zip(parts, begin[:-1], strict=True):
        text[b : b + len(p)] = np.frombuffer(p, np.uint8)
        text[b : b + len(p)] += 1
    step = np.zeros(len(text) + 1, np.int8)
    step[begin[:-1]], step[begin[:-1] + starts] = 1, -1
    counted = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    order = suffix_order(text, 257, LENGTH)
    order = order[counted[order]]
    at = np.flatnonzero(counted)
    whole = np.empty(len(at), np.uint64)  # hashes of the counted places, in pieces of whole contexts
    for s, e in slices(begin, PIECE):
        p, q = prefix_hash((text[begin[s] : begin[e]] - 1).astype(np.uint8), VALUES)
        here = slice(*np.searchsorted(at, begin[[s, e]]))
        x = at[here] - begin[s]
        whole[here] = (p[x + LENGTH] - p[x]) * q[x]
    whole = whole[(np.cumsum(counted, dtype=np.int32) - 1)[order]]
    del text, at
    owner = np.searchsorted(begin, order, side="right") - 1
    inside = order - begin[owner]
    new = np.r_[True, whole[1:] != whole[:-1]]
    group = np.cumsum(new) - 1
    weight = np.bincount(group, copies[owner])
    flag = weight[group] > 1
    owner, inside = owner[flag], inside[flag]
    by = np.lexsort((inside, owner))
    owner, inside = owner[by], inside[by]
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    if len(owner):
        head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)])
        tail = np.r_[head[1:], len(owner)] - 1
        for o, a, b in zip(owner[head].tolist(), inside[head].tolist(), inside[tail].tolist(), strict=True):
            out[o].append((a, b))
    return out


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in keyed_runs(batches, "shard"):
        anchor, copies = t.column("anchor").to_numpy(), t.column("copies").to_numpy()
        _, of, n = np.unique(anchor, return_inverse=True, return_counts=True)
        t = t.filter(pa.array((n[of] > 1) | (copies > 1)))  # one context that comes once repeats nothing
        if not t.num_rows:
            continue
        key, c1, c2, starts, copies = (t.column(c).to_numpy() for c in ("shard", "c1", "c2", "starts", "copies"))
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for s, e in zip(cut, np.r_[cut[1:], len(key)], strict=True):
            found = repeated_starts(t.column("context").slice(s, e - s).to_pylist(), starts[s:e], copies[s:e])
            rows = [(a, b, f, g) for a, b, r in zip(c1[s:e].tolist(), c2[s:e].tolist(), found, strict=True) for f, g in r]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["c1", "c2", "f", "g"])


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, text, ranges of repeated starts) -> what stays."""
    for batch in batches:
        raw, offsets = text_buffers(batch.column("text"))
        n, spans, sha = [], [], []
        for k, ranges in enumerate(batch.column("ranges")):
            s, e = int(offsets[k]), int(offsets[k + 1])
            both = np.array([(x["s"], x["e"]) for x in ranges.as_py()], np.int64)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            reach = np.maximum.accumulate(both[:, 1]) + LENGTH
            head = np.r_[True, both[1:, 0] > reach[:-1]]
            first, last = both[head, 0], reach[np.r_[np.flatnonzero(head)[1:] - 1, len(both) - 1]]
            keep = hashlib.sha256()
            at = s
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                keep.update(raw[at : s + a])
                at = s + b
            keep.update(raw[at:e])
            n.append(int((last - first).sum())), spans.append(len(first)), sha.append(keep.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["h1", "h2", "n_removed", "n_spans", "kept_sha256"])


def flagged(held: DataFrame) -> DataFrame:
    """(c1, c2, f, g) of contexts: the ranges of their starts that are repeated. Parts of more than HOT contexts are split until they have fewer."""
    distinct = held.groupBy("c1", "c2", "anchor", "starts").agg(F.sum("copies").alias("copies"), F.first("context", ignorenulls=True).alias("context"), *(F.first(c).alias(c) for c in ("place", "low", "high")))
    split_so_far = held.filter(f"high > low AND high - low < {W - 1}").select("anchor", "c1", "c2").distinct()
    hot = stored(split_so_far.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor"), "hot")
    more = not hot.isEmpty()
    few = distinct.join(F.broadcast(hot), "anchor", "left_anti") if more else distinct
    total = held.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    dealt = few.select("c1", "c2", "anchor", "starts", "copies", "context").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(-(-total // SHARD) or 1)))
    flags = stored(dealt.repartition("shard").sortWithinPartitions("shard", "c1", "c2").mapInArrow(frugal(shards), "c1 bigint, c2 bigint, f bigint, g bigint"), "flags")
    if not more:
        return flags
    kind = "o1 bigint, o2 bigint, off bigint, c1 bigint, c2 bigint, anchor bigint, starts bigint, copies bigint, place bigint, low bigint, high bigint, context binary"
    halves = stored(distinct.join(F.broadcast(hot), "anchor").mapInArrow(frugal(finer), kind), "halves")
    below = flagged(halves).join(halves.select("c1", "c2", "o1", "o2", "off"), ["c1", "c2"])
    return flags.union(below.select("o1", "o2", F.col("off") + F.col("f"), F.col("off") + F.col("g")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay).

    Null texts are empty; texts of fewer than LENGTH bytes keep all. Rows without doc_id are dropped. Rows that repeat a text, with the same doc_id or another,
    lose all of it if it has LENGTH bytes. Extra columns are ignored and an empty table gives no rows."""
    d = texts_of(docs).withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(97), "text"))
    every = d.select("doc_id", "h1", "h2", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    texts = stored(every.filter(F.col("n_bytes") >= LENGTH).groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "texts")
    long = d.filter(F.octet_length("text") >= LENGTH)
    found = stored(long.select("doc_id", "h1", "text").mapInArrow(frugal(anchors), "doc_id bigint, h1 bigint, lo bigint, hi bigint, at bigint, anchor bigint, twice boolean"), "anchors")
    again = found.groupBy("anchor").agg((F.min("h1") != F.max("h1")).alias("many"), F.max("twice").alias("twice"), (F.count("*") > HOT).alias("hot")).filter("many OR twice")
    # the rows of one anchor are dealt to several tasks; each of them gets the anchor
    again = again.select("anchor", "hot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "lo"), F.lit(SALTS)).cast("int")).join(again, ["anchor", "salt"])
    meet = met.groupBy("doc_id", "h1").agg(F.collect_list(F.struct("lo", "hi", "at", "anchor", "hot")).alias("runs"))
    meet = meet.join(texts.select(F.col("rep").alias("doc_id"), "h1", "h2", "copies"), ["doc_id", "h1"])
    held = stored(long.select("doc_id", "h1", "h2", "text").join(meet, ["doc_id", "h1", "h2"]), "texts-with-runs")
    member = stored(held.select("doc_id", "h1", "copies", "text", "runs").mapInArrow(frugal(contexts), "c1 bigint, c2 bigint, anchor bigint, doc_id bigint, h1 bigint, lo bigint, starts bigint, copies bigint, place bigint, low bigint, high bigint, context binary"), "contexts")
    ranges = member.select("c1", "c2", "doc_id", "h1", "lo").join(flagged(member), ["c1", "c2"]).groupBy("doc_id", "h1").agg(F.collect_list(F.struct((F.col("lo") + F.col("f")).alias("s"), (F.col("lo") + F.col("g")).alias("e"))).alias("ranges"))
    result = held.filter("copies = 1").select("doc_id", "h1", "h2", "text").join(ranges, ["doc_id", "h1"]).select("h1", "h2", "text", "ranges").mapInArrow(frugal(removed), "h1 bigint, h2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    joined = every.join(texts.select("h1", "h2", "copies"), ["h1", "h2"], "left").join(result, ["h1", "h2"], "left")
    gone = F.coalesce(F.col("copies") > 1, F.lit(False))
    return joined.select("doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"), F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"), F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))
