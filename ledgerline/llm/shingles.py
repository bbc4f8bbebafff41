"""Hashed word shingles of whole texts, batch by batch in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .common import GOLD, byte_values, mix, prefix_hash, slices

#: The white space bytes that end a word, and A-Z lowered.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = byte_values(11)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lowered word, and each row's range of words."""
    base, rel = offsets[0], offsets - offsets[0]
    data = LOWER[raw[base : offsets[-1]]]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[rel] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    starts, ends = np.flatnonzero(word & (before | cut[:-1])), np.flatnonzero(word & (after | cut[1:])) + 1
    p, q = prefix_hash(data, VALUES)
    return mix((p[ends] - p[starts]) * q[starts]), np.searchsorted(starts, rel)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """For each row its sorted distinct shingle hashes: `width` words, or all words if there are fewer; none without words."""
    scale = [mix(np.array([k + 1], np.uint64) * GOLD)[0] | np.uint64(1) for k in range(width)]
    for a, b in slices(offsets, most):
        words, bounds = word_hashes(raw, offsets[a : b + 1])
        n = len(words) - width + 1
        if n > 0:
            rolled = words[:n] * scale[0]
            for k in range(1, width):
                rolled += words[k : k + n] * scale[k]
            rolled = mix(rolled)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s >= width:
                yield np.unique(rolled[s : e - width + 1])
            elif e > s:
                part = words[s:e]
                yield mix(np.array([sum(int(w) * int(k) for w, k in zip(part, scale, strict=False)) + int(e - s) & (1 << 64) - 1], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_digest(own: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit hash of the whole set."""
    d = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def signature(own: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Minwise tokens: for each multiplier the least 31-bit hash over the set."""
    low = None
    for k in range(0, len(own), 4096):
        part = ((own[k : k + 4096, None] * scale) >> np.uint64(33)).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low.astype(np.int32)


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLD + np.uint64(77)) | np.uint64(1)
