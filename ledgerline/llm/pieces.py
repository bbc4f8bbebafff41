"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A piece sequence is what merging would give if and only if every two adjacent pieces merge back to themselves. So the text is
covered left to right with the longest piece that an Aho-Corasick automaton finds at each position, a piece is kept only
if re-merging it with its left neighbour returns the two, shorter pieces come next, and a position from which nothing
fits is marked in a bitfield and never entered again.

No piece holds a word mark after another character, so the text falls into units (word marks, then other
characters) that never merge with each other; the coded units are remembered for a worker's life.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, texts_of

#: The word mark, fixed by the format; the units a worker remembers before it starts afresh; pairs likewise.
MARK, UNITS, PAIRS = "▁", 600_000, 1_000_000
UNIT = re.compile(f"{MARK}*[^{MARK}]*")


class Pieces:
    """Encoder and decoder for one model file."""

    def __init__(self, model: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with an identity normaliser, a dummy prefix and escaped spaces")
        normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(MARK in p.piece.lstrip(MARK) for _, p in normal) or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("only models whose pieces have word marks in front alone, and no user-defined pieces")
        self.id = {p.piece: i for i, p in normal}
        self.text = {i: p.piece for i, p in normal}
        self.score = {p.piece: p.score for _, p in normal}
        self.wide = np.uint16 if len(proto.pieces) <= 1 << 16 else np.uint32
        self.kind = np.dtype(self.wide).char
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown, self.bos, self.eos = self.library.unk_id(), self.library.bos_id(), self.library.eos_id()
        # runs of marks merge only with each other, and last
        runs = [p for p in self.score if p.strip(MARK) == "" and len(p) > 1]
        least = min((s for p, s in self.score.items() if p.strip(MARK)), default=0)
        if any(self.score[p] >= least for p in runs):
            raise ValueError("runs of word marks must merge last")
        self.runs = {p: self.score[p] for p in runs}
        self.automaton = ahocorasick.Automaton()
        for i, p in normal:
            if p.piece.strip(MARK) or p.piece == MARK:
                self.automaton.add_word(p.piece, (len(p.piece), i))
        self.automaton.make_automaton()
        self.known = re.compile("[" + "".join(re.escape(p) for p in self.id if len(p) == 1) + "]+")
        self.pair: dict[tuple[int, int], bool] = {}
        self.unit: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merging itself: again and again the adjacent pair with the best score, the leftmost of equals."""
        if len(text) > 64:
            return self._merged_long(text)
        part, score = list(text), self.score
        while len(part) > 1:
            best, at = None, -1
            for k in range(len(part) - 1):
                s = score.get(part[k] + part[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            part[at : at + 2] = [part[at] + part[at + 1]]
        return part

    def _merged_long(self, text: str) -> list[str]:
        """The same with a queue of pairs."""
        part: list[str | None] = list(text)
        n, score = len(part), self.score
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, str, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (s := score.get(part[k] + part[after[k]])) is not None:
                heapq.heappush(queue, (-s, k, part[k], part[after[k]]))

        for k in range(n - 1):
            offer(k)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            if part[k] != a or after[k] < 0 or part[after[k]] != b:
                continue
            gone = after[k]
            part[k], part[gone], after[k] = a + b, None, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k]), offer(k)
        return [x for x in part if x is not None]

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        ok = self.pair.get(key)
        if ok is None:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            a, b = self.text[left], self.text[right]
            ok = self.pair[key] = self.merged(a + b) == [a, b]
        return ok

    def covered(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces, by backtracking."""
        n, found = len(text), {}
        for end, (size, i) in self.automaton.iter(text):
            at = end - size + 1
            if at in found:
                found[at].append((size, i))
            else:
                found[at] = [(size, i)]
        pair, fits = self.pair, self.fits
        out: list[int] = []
        stack: list[tuple[int, int]] = []  # where each piece starts, and which of the pieces there it is
        failed, at, last, here = 0, 0, -1, found[0]
        take = len(here) - 1
        while True:
            while take >= 0:
                size, i = here[take]
                if not failed >> (at + size) & 1:
                    if last < 0:
                        break
                    ok = pair.get((last, i))
                    if ok or ok is None and fits(last, i):
                        break
                take -= 1
            if take >= 0:
                out.append(i)
                stack.append((at, take))
                at += size
                if at == n:
                    return out
                last, here = i, found[at]
                take = len(here) - 1
            elif not out:
                return [self.id[p] for p in self.merged(text)]  # no cover fits pair by pair; merging decides
            else:
                failed |= 1 << at
                out.pop()
                at, take = stack.pop()
                take -= 1
                here, last = found[at], out[-1] if out else -1

    def spread(self, text: str) -> list[int]:
        """Ids of a text without runs of marks; characters outside the vocabulary become byte pieces."""
        if self.known.fullmatch(text):
            return self.covered(text)
        out: list[int] = []
        k, known = 0, self.id
        while k < len(text):
            e = k
            while e < len(text) and text[e] in known:
                e += 1
            if e > k:
                out += self.covered(text[k:e])
            if e < len(text):
                out += [self.byte[b] for b in text[e].encode()] if self.byte else [self.unknown]
            k = e + 1
        return out

    def coded(self, unit: str) -> bytes:
        """The packed ids of one unit."""
        got = self.unit.get(unit)
        if got is None:
            if len(self.unit) >= UNITS:
                self.unit.clear()
            marks = len(unit) - len(unit.lstrip(MARK))
            ids = self.spread(unit[marks - 1 :] if marks else unit)
            if marks > 1:
                alone = len(unit) == marks or self.text.get(ids[0]) == MARK
                front = [self.id[x] for x in self.merged(MARK * (marks - (not alone)))]
                ids = front + (ids[1:] if alone else ids)
            got = self.unit[unit] = array(self.kind, ids).tobytes()
        return got

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text with begin and end ids, as the library gives them."""
        if not text:
            body = b""
        else:
            words = text.split(" ")
            get, coded = self.unit.get, self.coded
            if MARK not in text and "" not in words:
                body = b"".join([get(u) or coded(u) for u in [MARK + w for w in words]])
            else:
                body = b"".join([get(u) or coded(u) for u in UNIT.findall(MARK + text.replace(" ", MARK)) if u])
        ids = np.frombuffer(body, self.wide)
        return np.concatenate([[self.bos], ids, [self.eos]]).astype(np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_loaded: dict[str, Pieces] = {}


def loaded(model: str) -> Pieces:
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def encode_batches(model: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for batch in batches:
            for k in range(0, len(batch), 500):
                part, n, a, b, every = batch.slice(k, 500), [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = own.encode(text)
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        every.append(ids.astype(np.int32))
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(every, pa.list_(pa.int32()))] if with_ids else []), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return run


def piece_digests(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Per document its number of ids (begin and end included), their digest, the digest of the text decoded from them, and the ids if asked for.

    A null or empty text has the begin and end ids alone and decodes to the empty string. Rows without doc_id are dropped, repeated
    rows stay, extra columns are ignored, and an empty table gives no rows."""
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return texts_of(docs).mapInArrow(frugal(encode_batches(model, with_ids)), kind)
