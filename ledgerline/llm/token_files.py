"""Token ids of documents in Huffman-coded files, in ascending doc_id order, and reading them back."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, shared_dir, slices, stored, text_buffers, texts_of
from .files import Saved, content
from .huffman import canonical, code_lengths, read, written

#: Ids of one file at most (a longer document stands alone); distinct words a worker remembers; text bytes coded at once; the end id.
FILE_IDS, WORDS, BYTES, END = 4_000_000, 600_000, 12 << 20, 0
#: Words that go to the library in one string, and the code points whose class is known; a text with one beyond goes to the library as a whole.
TOGETHER, POINTS = 2048, 0x20000
#: Fixed values of the vocabulary's pattern: classes of characters, and what an apostrophe that begins a word takes with it.
LETTER, NUMBER, OTHER, WHITE = range(4)
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


class Coder:
    """Ids of a byte-level tokenizers file.

    Texts are cut into the pattern's words in numpy; the distinct words go to the library, already in the vocabulary's
    byte alphabet and many in one string, and their ids are dealt back to the places of the words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.inner = Tokenizer.from_file(path), Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        own = spec["pre_tokenizer"] or {}
        if (own.get("type"), own.get("add_prefix_space"), own.get("use_regex")) != ("ByteLevel", False, True) or spec["normalizer"] or spec["post_processor"]:
            raise ValueError("only byte-level vocabularies with the usual pattern, no normaliser and no post-processor")
        self.inner.pre_tokenizer, self.inner.encode_special_tokens = pre_tokenizers.CharDelimiterSplit(" "), True
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocabulary = self.library.get_vocab()
        self.kind = id_kind(path)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.classes = self._classes()
        # printable bytes stand for themselves in the byte alphabet, the others for the code points from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in plain]
        self.letters = np.arange(256, dtype="<u4")
        self.letters[rest] = np.arange(256, 256 + len(rest))
        self.known, self.lists = pa.array([], pa.binary()), pa.array([], pa.large_list(pa.from_numpy_dtype(self.kind)))

    def _classes(self) -> np.ndarray:
        """The class of every code point below POINTS, asked of the library: what it leaves in one word with a letter, a digit or a mark."""
        points = np.array([c for c in range(POINTS) if not 0xD800 <= c < 0xE000])
        out = np.full(POINTS, WHITE, np.uint8)
        for kind, beside in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            words = self.library.pre_tokenizer.pre_tokenize_str("".join(f"\n{beside}{chr(c)}" for c in points.tolist()))
            cut = np.zeros(3 * len(points) + 1, bool)
            cut[np.fromiter((span[0] for _, span in words), np.int64, len(words))] = True
            alone = cut[2 : 3 * len(points) : 3]
            out[points[~alone]] = kind
            points = points[alone]
        return out

    def cuts(self, data: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where a word of the pattern starts, rows with a code point beyond the classes) of rows of UTF-8 that begin at rel."""
        n = len(data)
        kind = self.classes[data]
        high = np.flatnonzero(data >= 0xC0)
        odd = np.zeros(0, np.int64)
        if len(high):
            lead = data[high].astype(np.int64)
            more = 1 + (lead >= 0xE0) + (lead >= 0xF0)
            point = lead & (0x7F >> (more + 1))
            for k in (1, 2, 3):
                some = more >= k
                point[some] = point[some] << 6 | (data[high[some] + k] & 0x3F)
            odd = np.unique(np.searchsorted(rel, high[point >= POINTS], side="right") - 1)
            own = self.classes[np.minimum(point, POINTS - 1)]
            kind[high] = own
            for k in (1, 2, 3):
                some = more >= k
                kind[high[some] + k] = own[some]
        head = np.zeros(n + 1, bool)
        head[rel] = True
        new = head[:-1].copy()
        new[1:] |= kind[1:] != kind[:-1]
        # a run of white space before a word leaves its last character to stand alone, or a space to lead the word
        first = np.flatnonzero(new)
        run = first[kind[first] == WHITE]
        stop = np.r_[first, n][np.searchsorted(first, run, side="right")]
        inside = ~head[stop]
        run, stop = run[inside], stop[inside]
        last = stop - 1
        while len(back := np.flatnonzero((data[last] & 0xC0) == 0x80)):
            last[back] -= 1
        new[last] = True
        new[stop[data[last] == 0x20]] = False
        # an apostrophe that begins a word takes an ending with it
        for at in np.flatnonzero(new & (data == 0x27)).tolist():
            end = next((at + 1 + len(e) for e in ENDINGS if data[at + 1 : at + 1 + len(e)].tobytes() == e and not head[at + 1 : at + 1 + len(e)].any()), 0)
            if end:
                new[at + 1 : end] = False
                if end < n:
                    new[end] = True
        return np.flatnonzero(new), odd

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word) of distinct words."""
        if not len(words):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        raw, offsets = text_buffers(words)
        ends = offsets[1:] - offsets[0] + np.arange(1, len(words) + 1)  # a space stands behind each word
        letters = np.full(int(ends[-1]), 0x20, "<u4")
        letters[np.arange(int(offsets[-1] - offsets[0])) + np.repeat(np.arange(len(words)), np.diff(offsets))] = self.letters[raw[offsets[0] : offsets[-1]]]
        cut = [0, *ends[TOGETHER - 1 : -1 : TOGETHER].tolist(), int(ends[-1])]
        strings = [letters[s : e - 1].tobytes().decode("utf-32-le") for s, e in zip(cut[:-1], cut[1:], strict=True)]
        ids = np.concatenate([np.array(e.ids, self.kind) for e in self.inner.encode_batch_fast(strings, add_special_tokens=False)])
        place, want = np.cumsum(self.bytes_of[ids]), offsets[1:] - offsets[0]
        last = np.searchsorted(place, want)
        if last[-1] != len(ids) - 1 or (place[last] != want).any():
            raise ValueError("the library did not keep a word's bytes")
        return ids, np.diff(last, prepend=-1)

    def ids_of(self, words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word) of words in order; words that come twice here are remembered."""
        distinct, index = words.dictionary, words.indices.to_numpy()
        at = pc.index_in(distinct, value_set=self.known).to_numpy(zero_copy_only=False)
        missing = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        new = distinct.filter(pa.array(missing))
        ids, sizes = self.learn(new)
        old = at[~missing].astype(np.int64)
        every = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)]), pa.array(ids))
        place = np.empty(len(distinct), np.int64)
        place[missing], place[~missing] = np.arange(len(new)), len(new) + np.arange(len(old))
        lists = pa.concat_arrays([every, self.lists.take(pa.array(old))])
        often = (np.bincount(index, minlength=len(distinct)) > 1)[missing]
        if len(self.known) + int(often.sum()) > WORDS:
            self.known, self.lists = self.known[:0], self.lists[:0]
        self.known = pa.concat_arrays([self.known, new.filter(pa.array(often))])
        self.lists = pa.concat_arrays([self.lists, every.filter(pa.array(often))])
        place = place[index]
        return lists.take(pa.array(place)).flatten().to_numpy(), lists.value_lengths().to_numpy()[place]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each row), equal to the library's for each whole row."""
        rel, data = offsets - offsets[0], raw[offsets[0] : offsets[-1]]
        rows = len(rel) - 1
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(rows, np.int64)
        starts, odd = self.cuts(data, rel[:-1][np.diff(rel) > 0])
        where = np.flatnonzero(np.diff(rel) > 0)
        whole = set(where[odd].tolist())
        text = data.tobytes()
        for t in self.special:
            at = text.find(t.encode())
            while at >= 0:
                whole.add(int(np.searchsorted(rel, at, side="right")) - 1)
                at = text.find(t.encode(), at + 1)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int32)), pa.py_buffer(text)]).dictionary_encode()
        ids, count = self.ids_of(words)
        ends = np.cumsum(count)
        bounds = np.r_[0, ends][np.searchsorted(starts, rel)]
        sizes = np.diff(bounds)
        if whole:
            parts = [ids[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            for k in whole:
                parts[k] = np.array(self.library.encode(text[rel[k] : rel[k + 1]].decode(), add_special_tokens=False).ids, self.kind)
            ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, sizes


_loaded: dict[str, Coder] = {}


def loaded(path: str) -> Coder:
    """The coder of this worker. Tasks call it by its name; a dictionary named in a task's own function would travel, empty, with each task."""
    if path not in _loaded:
        _loaded[path] = Coder(path)
    return _loaded[path]


def id_kind(path: str) -> type:
    """The narrowest type that holds every id of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return np.uint16 if most < 1 << 16 else np.uint32


def tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path)
        width = np.dtype(own.kind).itemsize
        for batch in batches:
            raw, offsets = text_buffers(batch.column("text"))
            for s, e in slices(offsets, BYTES):
                ids, sizes = own.encode(raw, offsets[s : e + 1])
                packed = pa.Array.from_buffers(pa.large_binary(), e - s, [None, pa.py_buffer(np.r_[0, np.cumsum(sizes) * width].astype(np.int64)), pa.py_buffer(ids.tobytes())])
                part = batch.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([part.column("part"), part.column("doc_id"), packed.cast(pa.binary())], ["part", "doc_id", "ids"])

    return run


def counted(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            raw, offsets = text_buffers(batch.column("ids"))
            own = np.bincount(raw[offsets[0] : offsets[-1]].view(kind)) if len(batch) else np.zeros(1, np.int64)
            own = np.pad(own, (0, max(0, len(total) - len(own))))
            own[: len(total)] += total
            total = own
            total[END] += len(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    return run


def write_files(folder: str, kind: type, table: bytes):
    """Rows (part, doc_id, ids) in order -> one row a file: its place, first document, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(zlib.decompress(table), np.uint8)
        codes = canonical(lengths)
        docs, held, total, last = [], [], 0, None

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind)
            file = Saved(folder, ".huf")
            file.write(written(np.array(docs, np.int64), np.array([len(h) // np.dtype(kind).itemsize for h in held], np.int64), ids, lengths, codes))
            return pa.RecordBatch.from_pylist([{"path": file.close(), "first": docs[0], "n_docs": len(docs), "n_ids": len(ids)}], schema=pa.schema([("path", pa.string()), ("first", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        end = np.array([END], kind).tobytes()
        for batch in batches:
            for part, doc, ids in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                size = len(ids) // np.dtype(kind).itemsize + 1
                if docs and (part != last or doc < docs[-1] or total + size > FILE_IDS):
                    yield flush()
                    docs, held, total = [], [], 0
                docs.append(doc), held.append(ids + end)
                total, last = total + size, part
        if docs:
            yield flush()

    return run


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict = {}
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
            docs, sizes, ids = read(content(path), tables)
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, start + ends - sizes, sizes, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, path: str) -> DataFrame:
    """Write the files; returns their manifest (path, first, n_docs, n_ids), itself stored.

    Null and empty texts are the end id alone; rows without doc_id are dropped; rows with one doc_id follow each other; extra columns are ignored."""
    spark = docs.sparkSession
    kind = id_kind(path)
    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    ids = stored(ordered.mapInArrow(tokenize(path), "part int, doc_id bigint, ids binary"), "ids")
    counts = ids.select("ids").mapInArrow(counted(kind), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most a row for each id of the vocabulary
    total = np.zeros(max([r["id"] for r in counts], default=0) + 1, np.int64)
    for r in counts:
        total[r["id"]] = r["n"]
    table = zlib.compress(code_lengths(total).tobytes())
    return stored(ids.mapInArrow(write_files(shared_dir(spark, "tokens"), kind, table), "path string, first bigint, n_docs bigint, n_ids bigint"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of a manifest (a row for each file)."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("first", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    return dealt(manifest.select("path", before)).mapInArrow(read_files, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
