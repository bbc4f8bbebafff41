"""Canonical length-limited Huffman coding of token ids in independent blocks.

A file is: magic, little-endian lengths, a zlib-compressed table of code lengths, the documents (doc_id, ids with the
end id), the bit offset at which each block starts, and the code bits. A block holds BLOCK ids and is decoded by itself, so
readers can start at any checkpoint; all blocks of a file are decoded side by side from one table.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed by the format: magic, the longest code in bits, ids of a block.
MAGIC, LONGEST, BLOCK = b"LLHUFF01", 20, 512


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits by package-merge; 0 for ids that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    some = np.flatnonzero(counts)
    if len(some) == 0:
        return lengths
    if len(some) == 1:
        lengths[some] = 1
        return lengths
    if len(some) > 1 << longest:
        raise ValueError("more ids than codes")
    order = some[np.argsort(counts[some], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, prior = [], np.zeros(0)
    for _ in range(longest):
        whole = np.concatenate([weight, prior])
        by = np.argsort(whole, kind="stable")
        levels.append(by < len(weight))
        ranked = whole[by]
        ranked = ranked[: len(ranked) // 2 * 2]
        prior = ranked[0::2] + ranked[1::2]
    take = 2 * (len(weight) - 1)
    for own in reversed(levels):
        singles = int(own[:take].sum())
        lengths[order[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length and then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    held = lengths[order].astype(np.int64)
    for n in range(1, LONGEST + 1):
        own = order[held == n]
        code <<= n - last
        last = n
        codes[own] = code + np.arange(len(own), dtype=np.uint32)
        code += len(own)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every LONGEST bits: the id they start with, and its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order]
    span = 1 << (LONGEST - own.astype(np.int64))
    ids, bits = np.repeat(order.astype(np.uint32), span), np.repeat(own, span)
    short = (1 << LONGEST) - len(ids)
    return np.concatenate([ids, np.zeros(short, np.uint32)]), np.concatenate([bits, np.ones(short, np.uint8)])


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(code bits, bit offset of each block's start)."""
    n = lengths[ids].astype(np.int64)
    if len(n) and not n.min():
        raise ValueError("an id has no code")
    end = np.cumsum(n)
    start = end - n
    word, shift = start >> 5, 64 - (start & 31) - n
    value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    total = int(end[-1] >> 5) + 2 if len(end) else 1
    out = np.zeros(total, np.uint64)
    if len(n):  # codes that start in one word have bits of their own in it and the next
        head = np.flatnonzero(np.diff(word, prepend=-1))
        both = np.add.reduceat(value, head)
        out[word[head]] = both >> np.uint64(32)
        out[word[head] + 1] |= both & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes(), start[::BLOCK]


def unpack(bits: bytes, checkpoints: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids of a file: every block by itself, one id of each at a time."""
    words = np.concatenate([np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    symbol, length = table
    at, out = checkpoints.astype(np.int64).copy(), np.zeros((len(checkpoints), BLOCK), np.uint32)
    last = count - (len(checkpoints) - 1) * BLOCK if len(checkpoints) else 0
    mask = np.uint64((1 << LONGEST) - 1)
    for k in range(BLOCK):
        live = len(at) if k < last else len(at) - 1
        if live <= 0:
            break
        p = at[:live]
        w = p >> 5
        v = ((words[w] << np.uint64(32)) | words[w + 1]) >> (np.uint64(64 - LONGEST) - (p & 31).astype(np.uint64)) & mask
        v = v.astype(np.int64)
        out[:live, k] = symbol[v]
        at[:live] = p + length[v]
    return out.reshape(-1)[:count]


def written(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """The bytes of one file."""
    bits, points = pack(ids, codes, lengths)
    parts = [zlib.compress(lengths.tobytes(), 6), zlib.compress(np.stack([docs, sizes]).astype("<i8").tobytes(), 6), zlib.compress(points.astype("<i8").tobytes(), 6), bits]
    return MAGIC + struct.pack("<7Q", len(docs), len(ids), len(points), *map(len, parts)) + b"".join(parts)


def read(data: bytes, tables: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, sizes, ids) of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, count, points, *sizes = struct.unpack_from("<7Q", data, 8)
    at, part = 8 + 56, []
    for n in sizes:
        part.append(data[at : at + n])
        at += n
    tables = {} if tables is None else tables
    if part[0] not in tables:
        tables.clear()
        tables[part[0]] = decode_table(np.frombuffer(zlib.decompress(part[0]), np.uint8))
    both = np.frombuffer(zlib.decompress(part[1]), "<i8").reshape(2, docs)
    check = np.frombuffer(zlib.decompress(part[2]), "<i8")
    if len(check) != points:
        raise ValueError("checkpoints are missing")
    return both[0], both[1], unpack(part[3], check, count, tables[part[0]])
