"""Near-duplicate documents by a chosen-path set similarity join.

Documents with one set of word shingles are one representative. Each representative carries minwise
tokens. Independent trees branch the representatives by the token at a chosen position (two positions
with the chance that keeps a pair at the threshold from dying out), so a node holds those that agree along
its path. Small nodes are compared exhaustively by their tokens; large ones branch on. A node that is
still large at the last level is linked to its least member as a whole. What is plausible joins candidate
groups, and inside each the full sets are compared exactly, with rows skipped only where the triangle
inequality of the Jaccard distance, or a link already known, rules a new link out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, frugal, keyed_runs, stored, text_buffers, texts_of
from .shingles import multipliers, set_digest, shingle_sets, signature

#: Minwise tokens of a document; independent trees; a tree's greatest depth; members of a small node;
#: texts compared in one task; tokens that must agree for a pair to be plausible (a pair at 0.8 agrees on
#: 51.2 of 64 with deviation 3.2, and falls below 35 with a chance of about one in a million).
TOKENS, TREES, DEPTH, SMALL, BLOCK, AGREE = 64, 12, 5, 64, 1024, 35


def signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = multipliers(TOKENS)
        for batch in batches:
            ids, n, h1, h2, sig = batch.column("doc_id"), [], [], [], []
            for own in shingle_sets(*text_buffers(batch.column("text")), width):
                d = set_digest(own)
                n.append(len(own)), h1.append(d[0]), h2.append(d[1])
                sig.append(signature(own, scale) if len(own) else np.zeros(TOKENS, np.int32))
            flat = np.concatenate(sig) if sig else np.zeros(0, np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, TOKENS), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), tokens], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return run


def _positions(level: int, which: int) -> list[int]:
    """The token position that each tree branches on at a level."""
    out = []
    for tree in range(TREES):
        order = np.random.default_rng(1000 + tree).permutation(TOKENS)
        first = [(tree + which * TREES * 2) % TOKENS] if level == 0 else None
        out.append(int(first[0]) if first else int(order[(2 * level + which) % TOKENS]))
    return out


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """Rows (tree, key, rep, sig) of the children: one position, and a second one with chance 1/0.8 - 1."""
    at = [F.element_at(F.array(*map(F.lit, _positions(level, w))), F.col("tree") + 1) for w in (0, 1)]
    child = [F.xxhash64("key", F.lit(level * 2 + w), F.get("sig", at[w])) for w in (0, 1)]
    two = F.pmod(F.xxhash64("key", F.lit("second"), F.lit(level)), F.lit(4)) == 0
    return rows.select("tree", "rep", F.explode(F.when(two, F.array(*child)).otherwise(F.array(child[0]))).alias("key"))


def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each small node, a star for each group that plausible pairs connect."""
    for t in keyed_runs(batches, "key"):
        key, rep, n = (t.column(c).to_numpy() for c in ("key", "rep", "n_shingles"))
        sig = np.concatenate([c.flatten().to_numpy() for c in t.column("sig").chunks]).reshape(len(t), TOKENS)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, len(key)])
        a, b = [], []
        pair = starts[counts == 2]
        if len(pair):
            ok = ((sig[pair] == sig[pair + 1]).sum(axis=1) >= AGREE) & (5 * np.minimum(n[pair], n[pair + 1]) >= 4 * np.maximum(n[pair], n[pair + 1]))
            a.append(rep[pair[ok]]), b.append(rep[pair[ok] + 1])
        for s, c in zip(starts[counts > 2], counts[counts > 2], strict=True):
            own, m = sig[s : s + c], n[s : s + c]
            near = np.zeros((c, c), np.int16)
            for k in range(TOKENS):
                near += own[:, k, None] == own[None, :, k]
            near = (near >= AGREE) & (5 * np.minimum.outer(m, m) >= 4 * np.maximum.outer(m, m))
            label = np.arange(c)
            while True:
                low = np.where(near, label[None, :], c).min(axis=1)
                low = np.minimum(low, label)
                if (low == label).all():
                    break
                label = low
            other = np.flatnonzero(label != np.arange(c))
            a.append(rep[s + label[other]]), b.append(rep[s + other])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])


def exact_groups(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """Component of each set under Jaccard >= percent/100, as the least index; `known` holds components that are given.

    Row by row all sets are compared; a row is passed over only if each set of another component is too far from it
    by the triangle inequality over rows compared before, or by the sizes."""
    m = len(sets)
    label = np.arange(m) if known is None else np.array([np.flatnonzero(known == k)[0] for k in known])
    size = np.array([len(s) for s in sets])
    if m == 2:
        if label[0] != label[1]:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            if 100 * both >= percent * (size.sum() - both):
                label[1] = label[0]
        return label
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner, ends = np.repeat(np.arange(m), size), np.r_[0, np.cumsum(size)]
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    far, covered, done, reach = [], np.zeros(m, bool), np.zeros(m, bool), 1 - percent / 100 + 1e-9

    def compare(p: int) -> None:
        own = ids[ends[p] : ends[p + 1]]
        mark[own] = True
        both = np.bincount(owner, weights=mark[ids], minlength=m).astype(np.int64)
        mark[own] = False
        union = size + size[p] - both
        hit = 100 * both >= percent * union
        hit[size == 0] = False
        if len(far) < 24:
            far.append(1 - both / np.maximum(union, 1))
        done[p] = True
        covered[hit], covered[p] = True, True
        for k in np.unique(label[hit]):
            if k != label[p]:
                low, high = min(k, label[p]), max(k, label[p])
                label[label == high] = low

    while not covered.all():
        compare(int(np.flatnonzero(~covered)[0]))
        if (label == label[0]).all():
            return label
    for p in np.flatnonzero(~done):
        open_ = (label != label[p]) & ~done & (100 * np.minimum(size, size[p]) >= percent * np.maximum(size, size[p]))
        for d in far:
            if not open_.any():
                break
            open_ &= np.abs(d - d[p]) <= reach
        if open_.any():
            compare(int(p))
            if (label == label[0]).all():
                break
    return label


def verify(width: int, percent: int):
    """Rows (key, rep, h1, known, text) sorted by key -> (a, b): each text with the least one of its exact component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in keyed_runs(batches, "key"):
            t = t.combine_chunks()
            key, rep, h1, known = (t.column(c).to_numpy() for c in ("key", "rep", "h1", "known"))
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            raw, offsets = text_buffers(t.column("text"))
            found_a, found_b = [], []
            for s, e in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                sets = list(shingle_sets(raw, offsets[s : e + 1], width))
                own = [k for k, x in enumerate(sets) if set_digest(x)[0] == h1[s + k]]
                ids = rep[s:e][own]
                if len(own) > 1:
                    label = exact_groups([sets[k] for k in own], percent, known[s:e][own])
                    found_a.append(ids[label]), found_b.append(ids)
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64())], ["a", "b"])

    return run


def candidate_edges(reps: DataFrame) -> DataFrame:
    """Star edges (a, b) of all that is plausible; every pair at the threshold meets with the trees' recall."""
    root = reps.select("rep", "sig", F.explode(F.array(*map(F.lit, range(TREES)))).alias("tree")).withColumn("key", F.xxhash64(F.lit("root"), "tree"))
    rows, leaves, edges = _branch(root, 0), [], None
    for level in range(DEPTH):
        nodes = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
        rows = stored(rows.join(nodes, "key"), "nodes")
        leaves.append(rows.filter(F.col("c") <= SMALL).select("key", "rep"))
        large = rows.filter(F.col("c") > SMALL)
        if large.isEmpty():
            break
        if level == DEPTH - 1:
            least = large.groupBy("key").agg(F.min("rep").alias("a"))
            edges = large.join(least, "key").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()
            break
        rows = _branch(large.select("tree", "key", "rep").join(reps.select("rep", "sig"), "rep"), level + 1)
    small = leaves[0]
    for x in leaves[1:]:
        small = small.union(x)
    small = small.join(reps.select("rep", "n_shingles", "sig"), "rep").repartition("key").sortWithinPartitions("key", "rep")
    found = small.mapInArrow(frugal(plausible), "a bigint, b bigint").distinct()
    return found if edges is None else found.union(edges)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts of white space, have no shingles and link with nothing (component_id is their own
    doc_id). Texts of fewer words are one shingle. Rows without doc_id are dropped; a repeated doc_id gives a row for
    each of its rows, each linked by its own text. Extra columns are ignored. An empty table gives no rows."""
    docs = texts_of(docs)
    sig = stored(docs.mapInArrow(frugal(signatures(width)), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig array<int>"), "sig")
    some = sig.filter("n_shingles > 0")
    reps = stored(some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "reps")
    groups = components(candidate_edges(reps))
    sizes = groups.groupBy("component").agg(F.count("*").alias("c"))
    members = groups.join(sizes, "component").select("component", F.col("id").alias("rep"), F.ceil(F.col("c") / BLOCK).alias("chunks"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks"))).join(reps.select("rep", "h1"), "rep")
    members = stored(members, "members")
    check = frugal(verify(width, percent))

    def compared(rows: DataFrame) -> DataFrame:
        """rows: key, rep, h1, known."""
        held = docs.join(rows.hint("merge"), docs.doc_id == rows.rep).select("key", "rep", "h1", "known", "text")
        return stored(held.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(check, "a bigint, b bigint"), "links")

    links = compared(members.select(F.xxhash64("component", "chunk").alias("key"), "rep", "h1", F.col("rep").alias("known")))
    wide = members.filter("chunks > 1")
    if not wide.isEmpty():
        links = _across(links, wide, compared)
    final = components(links)
    named = reps.join(final, reps.rep == final.id, "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    empty = sig.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = some.join(named, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    return full.union(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _across(links: DataFrame, wide: DataFrame, compared) -> DataFrame:
    """Candidate groups of several chunks: join the chunks' components by their leaders, then compare what still differs."""

    def labelled(edges: DataFrame) -> DataFrame:
        c = components(edges).select(F.col("id").alias("rep"), F.col("component").alias("found"))
        return stored(wide.join(c, "rep", "left").withColumn("known", F.coalesce("found", "rep")).drop("found"), "labels")

    now = labelled(links)
    leaders = now.filter("rep = known")
    count = leaders.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    leaders = leaders.join(count, "component").select(F.xxhash64("component", F.lit("leaders"), F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("key"), "rep", "h1", "known")
    links = links.union(compared(leaders))
    now = labelled(links)
    # members outside a group's largest component, in blocks, meet every chunk; members inside it stay in their own chunk, as they need not meet each other
    parts = now.groupBy("component", "known").agg(F.count("*").alias("c"))
    main = parts.groupBy("component").agg(F.max(F.struct("c", "known")).alias("m"), F.sum("c").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    main = main.select("component", F.col("m.known").alias("main"), F.ceil((F.col("n") - F.col("m.c")) / BLOCK).alias("blocks"))
    rest = stored(now.join(main, "component"), "rest")
    if rest.isEmpty():
        return links
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).alias(name)
    here = rest.select("component", "rep", "h1", "known", "chunk", every("blocks", "block"))
    other = rest.filter("known <> main").withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")))
    there = other.select("component", "rep", "h1", "known", F.col("chunk").alias("own"), every("chunks", "chunk"), "block").filter("own <> chunk").drop("own")
    met = here.unionByName(there).select(F.xxhash64("component", "chunk", "block").alias("key"), "rep", "h1", "known")
    return links.union(compared(met))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their group of near-duplicates, with all of their columns; of rows with one doc_id one stays."""
    kept = stored(near_duplicates(docs, width, percent).filter("kept").groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_rows")), "kept")
    out = docs.join(kept, docs["doc_id"].cast("bigint") == kept["_kept"], "left_semi")
    return out if kept.filter("_rows > 1").isEmpty() else out.dropDuplicates(["doc_id"])
