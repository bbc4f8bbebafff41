"""Near-duplicate embeddings: int8 tile products with error bounds, then full precision where it matters.

Equal vectors of a label are one representative with a count. Representatives of a label are dealt into tiles, and
each pair of tiles is one task's work: the vectors, scaled to length one, are quantised to int8 with a step of
their own, so u = s*q + e with the error's length |e| known. The int8 product is exact, and
|u.v - s*t*(q.r)| <= |s*q|*|f| + |e| for the other vector's error f. Only pairs whose upper bound reaches the threshold are
multiplied again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, keyed_runs, stored

#: Vectors of a tile; rounding slack that keeps the bound above double-precision error.
TILE, SLACK = 1024, 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, step, length of the coded vector, length of its error) of each row of unit vectors."""
    step = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / step[:, None]).astype(np.int8)
    coded = code * step[:, None]
    return code, step, np.sqrt((coded**2).sum(axis=1)), np.sqrt(((unit - coded) ** 2).sum(axis=1))


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: float32 holds every partial sum of up to 1000 terms of 127*127 exactly."""
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1000):
        total += a[:, k : k + 1000].astype(np.float32) @ b[:, k : k + 1000].astype(np.float32).T
    return total


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all rows of x and y whose cosine in double precision is at least the threshold."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    (a, s, la, ea), (b, t, _, eb) = quantise(x / nx[:, None]), quantise(y / ny[:, None])
    upper = int8_product(a, b) * s[:, None] * t[None, :] + la[:, None] * eb[None, :] + ea[:, None] + SLACK
    i, j = np.nonzero(upper >= threshold)
    hit = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        hit[k : k + (1 << 16)] = (x[p] * y[q]).sum(axis=1) / (nx[p] * ny[q]) >= threshold
    return i[hit], j[hit]


def tile_links(threshold: float):
    """Rows (key, side, rep, copies, embedding), sorted by key -> (rep, links, least): partial counts and a least partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in keyed_runs(batches, "key"):
            t = t.combine_chunks()
            key, side, rep, copies = (t.column(c).to_numpy() for c in ("key", "side", "rep", "copies"))
            lists = t.column("embedding")
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                x = flat[off[s] : off[e]].reshape(e - s, -1).astype(np.float64)
                left, right = np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
                if side[s] == 2:  # a tile with itself
                    i, j = linked_pairs(x, x, threshold)
                    i, j = i[i < j], j[i < j]
                elif len(left) and len(right):
                    i, j = linked_pairs(x[left], x[right], threshold)
                    i, j = left[i], right[j]
                else:
                    continue
                n, ids, c = e - s, rep[s:e], copies[s:e]
                links = np.bincount(i, c[j], n) + np.bincount(j, c[i], n)
                least = ids.copy()
                np.minimum.at(least, i, ids[j]), np.minimum.at(least, j, ids[i])
                # one edge a vector is not enough: joined groups need a forest over this tile's links
                label = np.arange(n)
                while len(i):
                    low = label.copy()
                    np.minimum.at(low, i, label[j]), np.minimum.at(low, j, label[i])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                some = np.flatnonzero(links > 0)
                out.append((ids[some], links[some].astype(np.int64), ids[label[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["rep", "links", "leader"])

    return run


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors with equal labels, not null, and with equal dimensions are compared. Null, empty and zero vectors and those with null,
    NaN or infinite components link with nothing, as do rows with a null label. Rows without vec_id are dropped; equal vectors link with each other.
    Extra columns are ignored and an empty table gives no rows."""
    v = vectors.select(column(vectors, "vec_id", "bigint").alias("vec_id"), column(vectors, "label", "bigint").alias("label"), column(vectors, "embedding", "array<double>").alias("embedding")).filter("vec_id IS NOT NULL")
    fine = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = v.filter("fine").withColumn("h", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    reps = stored(good.groupBy("label", "h", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vectors")
    count = reps.groupBy("label", F.size("embedding").alias("d")).agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = reps.withColumn("d", F.size("embedding")).join(F.broadcast(count) if count.count() <= 10_000 else count, ["label", "d"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("other")
    pairs = dealt.select("label", "d", "rep", "copies", "embedding", "tile", other).select(F.xxhash64("label", "d", F.least("tile", "other"), F.greatest("tile", "other")).alias("key"), F.when(F.col("tile") == F.col("other"), 2).otherwise((F.col("tile") > F.col("other")).cast("int")).alias("side"), "rep", "copies", "embedding")
    found = stored(pairs.repartition("key").sortWithinPartitions("key").mapInArrow(tile_links(threshold), "rep bigint, links bigint, leader bigint"), "tile-links")
    groups = components(found.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.join(links, "rep", "left").join(groups, reps.rep == groups.id, "left").select("label", "h", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    full = good.select("vec_id", "label", "h", "h2").join(named, ["label", "h", "h2"]).select("vec_id", "n_links", "component_id")
    alone = v.filter("NOT fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
