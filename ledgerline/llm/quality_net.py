"""Quality classifier: a convolutional network over bytes, in numpy.

A document's bytes are cut into steps of STEP bytes; a chunk is two steps, so chunks overlap by half and cover the
whole document. Every byte has a learned vector, every filter sees a whole chunk, a document keeps each filter's
largest value over all of its chunks, and a logistic layer makes one probability of them. Training follows the chunks that won.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, frugal, slices, text_buffers, texts_of

#: Bytes of half a chunk; size of a byte's vector; filters; passes over the sample, and training steps at least; documents of a step; what all rejected
#: documents of the sample weigh against all good ones, however few they are.
STEP, VECTOR, FILTERS, PASSES, LEAST_STEPS, GROUP, WEIGHT = 24, 6, 32, 14, 1200, 32, 2.3
#: The bound of the labelled sample that the driver trains on: its rows, and the bytes of a row; of a longer text a stretch of so many bytes is taken, at a place that its doc_id gives.
SAMPLE_ROWS, SAMPLE_TEXT = 5000, 32_768
#: Steps that are pooled at once, so that a very long text needs no more memory than its bytes.
PIECE = 1 << 15
#: Scores of at least this are predicted 1.
CUT = 0.3
PAD = 256


def steps_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes in steps, each document padded and followed by an empty step, and each document's first step."""
    sizes = np.diff(offsets)
    count = np.maximum(-(-sizes // STEP), 1) + 1
    first = np.r_[0, np.cumsum(count)]
    codes = np.full(int(first[-1]) * STEP, PAD, np.int16)
    for k, (s, e) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        at = int(first[k]) * STEP
        codes[at : at + e - s] = raw[s:e]
    return codes.reshape(-1, STEP), first


class Network:
    def __init__(self, seed: int = 5) -> None:
        rng, self.weight = np.random.default_rng(seed), 1.0
        self.w = {
            "vectors": rng.normal(0, 0.3, (257, VECTOR)).astype(np.float32),
            "left": rng.normal(0, 0.08, (STEP * VECTOR, FILTERS)).astype(np.float32),
            "right": rng.normal(0, 0.08, (STEP * VECTOR, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.3, FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.w["vectors"][PAD] = 0

    def pooled(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps as vectors, value of every filter at every chunk, largest value by document)."""
        w = self.w
        x = np.take(w["vectors"], codes, axis=0).reshape(len(codes), -1)
        both = x @ np.concatenate([w["left"], w["right"]], axis=1)
        chunk = both[:-1, :FILTERS] + both[1:, FILTERS:]
        chunk = np.concatenate([chunk, np.full((1, FILTERS), -np.inf, np.float32)])
        chunk[first[1:] - 1] = -np.inf  # a document's last step starts no chunk
        return x, chunk, np.maximum.reduceat(chunk, first[:-1], axis=0)

    def score(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        w = self.w
        if len(first) == 2 and len(codes) > PIECE + 1:  # a long document: the largest of its pieces' values; pieces share a step, as chunks do
            tops = [self.pooled(part, np.array([0, len(part)]))[2] for part in (codes[k : k + PIECE + 1] for k in range(0, len(codes) - 1, PIECE))]
            most = np.max(tops, axis=0)
        else:
            most = self.pooled(codes, first)[2]
        top = np.maximum(most + w["shift"], 0)
        return 1 / (1 + np.exp(-np.clip((top @ w["out"] + w["bias"]).astype(np.float64), -60, 60)))

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 7) -> None:
        """Adam on the logistic loss; the gradient passes through the chunk that each filter chose."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        order, t = np.arange(len(texts)), 0
        each = -(-len(texts) // GROUP)
        passes = max(PASSES, -(-LEAST_STEPS // each))
        total = passes * each
        for _ in range(passes):
            rng.shuffle(order)
            for k in range(0, len(order), GROUP):
                own = order[k : k + GROUP]
                t += 1
                rate = 0.006 * (1 - t / (total + 1)) + 1e-4
                shift = rng.integers(STEP, size=len(own))  # filters must not depend on where a step starts
                for name, g in self.gradient([texts[i][s:] for i, s in zip(own, shift, strict=True)], labels[own]).items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.001 * (g * g - v[name])
                    self.w[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        codes, first = steps_of(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts])])
        x, chunk, top = self.pooled(codes, first)
        live = top + w["shift"]
        act = np.maximum(live, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ w["out"] + w["bias"], -60, 60)))
        d = ((p - labels) * np.where(labels == 0, self.weight, 1) / len(labels)).astype(np.float32)
        back = d[:, None] * w["out"][None, :] * (live > 0)
        won = np.stack([first[i] + np.argmax(chunk[first[i] : first[i + 1]], axis=0) for i in range(len(texts))])
        here, after = x[won], x[won + 1]  # documents x filters x (STEP * VECTOR)
        out = {"out": act.T @ d, "bias": np.array([d.sum()], np.float32), "shift": back.sum(axis=0)}
        out["left"], out["right"] = np.einsum("dfk,df->kf", here, back), np.einsum("dfk,df->kf", after, back)
        by = np.zeros((257, VECTOR))
        for at, side in ((won, "left"), (won + 1, "right")):
            g = (back[:, :, None] * w[side].T[None]).reshape(-1, VECTOR)
            ids = codes[at].reshape(-1)
            for c in range(VECTOR):
                by[:, c] += np.bincount(ids, g[:, c], 257)
        by[PAD] = 0
        out["vectors"] = by.astype(np.float32)
        return out


def train(texts: list[bytes], labels: list[int]) -> Network:
    """A network fitted to the sample; with one class or no rows at all it scores what that class says, or 0.5."""
    net = Network()
    y = np.array(labels, np.float32)
    if len(y) and 0 < y.sum() < len(y):
        rate = float(y.mean())
        net.w["bias"][:] = np.log(rate / (1 - rate))
        net.weight = WEIGHT * rate / (1 - rate)
        net.fit(texts, y)
    else:
        net.w["out"][:] = 0
        net.w["bias"][:] = 0 if not len(y) else (10 if y[0] else -10)
    return net


def scorer(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        net.w = weights
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            parts = [net.score(*steps_of(raw, offsets[a : b + 1])) for a, b in slices(offsets, 1 << 19)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return run


def held_out(doc_id):
    """The rows that no label is learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def learned(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit to a bounded sample of the labelled rows that are not held out, the same rows for the same tables; of a doc_id that comes with several texts the least counts."""
    known = labels.select(column(labels, "doc_id", "bigint").alias("doc_id"), column(labels, "quality", "int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    over = F.greatest(F.octet_length("text") - SAMPLE_TEXT, F.lit(0))
    raw = F.substring(F.col("text").cast("binary"), (F.pmod(F.xxhash64("doc_id"), over + 1) + 1).cast("int"), F.lit(SAMPLE_TEXT))
    texts = texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", raw.alias("raw"))
    rows = texts.groupBy("doc_id", "quality").agg(F.min("raw").alias("raw")).orderBy("doc_id").limit(SAMPLE_ROWS).collect()  # no more rows than were chosen
    return train([bytes(r["raw"]) for r in rows], [r["quality"] for r in rows])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts are one empty chunk and get its score. Rows without doc_id are dropped, repeated rows stay, extra columns are
    ignored. Labels that are null or neither 0 nor 1 are passed over, and of several labels of a document the largest counts; without
    labels every score is 0.5."""
    net = learned(docs, labels)
    scored = texts_of(docs).mapInArrow(frugal(scorer(net.w)), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 1, with all of their columns; nothing is shuffled but the training sample.

    A null text counts as empty, and rows without doc_id are judged by their text like all others; repeated rows stay or go together."""
    weights = learned(docs, labels).w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        net.w = weights
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text").fill_null(""))
            for a, b in slices(offsets, 1 << 19):
                yield batch.slice(a, b - a).filter(pa.array(net.score(*steps_of(raw, offsets[a : b + 1])) >= CUT))

    return docs.mapInArrow(frugal(run), docs.schema)
