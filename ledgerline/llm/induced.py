"""Suffix sorting of one shard by induction, with queues that go to disk.

Suffixes are smaller (S) or larger (L) than their right neighbour. The leftmost S suffixes are sorted by recursion over their names: names of
substrings, then of pairs of names, and so on, until `depth` symbols are settled. From them the L suffixes are induced in ascending and
the S suffixes in descending order: a suffix that leaves the queue's lowest (highest) symbol puts its predecessor
into the queue of that one's first symbol. A queue is keyed by the symbol and first-in-first-out within it, which is the priority
order of induction, so whole runs leave at once. Runs beyond a memory bound are appended to an unlinked
scratch file of the task, which no other task reads and which vanishes with it.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Kind of a position; a shard is far below 2 GB.
PLACE = np.int32
#: Entries that a queue set holds in memory before it writes runs to its scratch file.
HELD = 1 << 23


class Queues:
    """First-in-first-out queues by symbol; the set as a whole keeps at most `held` entries in memory."""

    def __init__(self, symbols: int, held: int = HELD) -> None:
        self.runs: list[list] = [[] for _ in range(symbols)]
        self.most, self.now, self.file = held, 0, None

    def push(self, symbol: int, run: np.ndarray) -> None:
        if self.now + len(run) > self.most:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.runs[symbol].append((self.file.tell(), len(run)))
            self.file.write(run.astype(PLACE).tobytes())
        else:
            self.now += len(run)
            self.runs[symbol].append(run)

    def deal(self, symbol: np.ndarray, run: np.ndarray) -> None:
        """Push each entry to its symbol's queue, in order."""
        if not len(run):
            return
        by = np.argsort(symbol, kind="stable")
        run, symbol = run[by], symbol[by]
        cut = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        for s, e in zip(cut, np.r_[cut[1:], len(run)], strict=True):
            self.push(int(symbol[s]), run[s:e])

    def pop(self, symbol: int) -> np.ndarray:
        """All entries of a symbol, in order; its queue is empty afterwards."""
        out = []
        for r in self.runs[symbol]:
            if isinstance(r, tuple):
                self.file.seek(r[0])
                out.append(np.frombuffer(self.file.read(PLACE().itemsize * r[1]), PLACE))
            else:
                self.now -= len(r)
                out.append(r)
        self.runs[symbol] = []
        return np.concatenate(out) if out else np.zeros(0, PLACE)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (the last is not)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = text[1:] > text[:-1]
    step[:-1] -= text[1:] < text[:-1]
    step[-1] = -1
    at = np.arange(n, dtype=PLACE)
    at[step == 0] = n
    np.minimum.accumulate(at[::-1], out=at[::-1])
    return step[at] > 0


def named(text: np.ndarray, small: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each leftmost-S suffix by its first `depth` symbols at least; equal ranks are equal that far.

    Symbols are compared with their types, so no substring is the beginning of another."""
    n, m = len(text), len(starts)
    # names of substrings of six symbols or more, then doubling over the reduced string
    padded = np.concatenate([text.astype(np.uint16) * np.uint16(2) + small + np.uint16(1), np.ones(8, np.uint16)])
    ends = np.r_[starts[1:], n] + 1 - starts
    key = np.zeros(m, np.uint64)
    for k in range(6):
        key = (key << np.uint64(10)) | np.where(k < ends, padded[np.minimum(starts + k, n)], np.uint16(0))
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    k = 6
    longest = int(ends.max()) if m else 0
    while k < longest:  # substrings that are longer than six symbols
        key = np.zeros(m, np.uint64)
        for j in range(k, k + 5):
            key = (key << np.uint64(10)) | np.where(j < ends, padded[np.minimum(starts + j, n)], np.uint16(0))
        live = np.flatnonzero(ends > k)
        tail = np.zeros(m, np.int64)
        tail[live] = np.unique(key[live], return_inverse=True)[1] + 1
        rank = np.unique(rank * (int(tail.max(initial=0)) + 1) + tail, return_inverse=True)[1].astype(np.int64)
        k += 5
        if k > depth:
            break
    step = 1
    while step * 2 <= depth:  # a name stands for two symbols at least
        top = int(rank.max()) + 2 if m else 1
        if top > m:
            break
        follow = np.zeros(m, np.int64)
        if step < m:
            follow[:-step] = rank[step:] + 1
        new = np.unique(rank * top + follow, return_inverse=True)[1].astype(np.int64)
        if int(new.max()) == int(rank.max()):
            rank = new
            break
        rank, step = new, step * 2
    return rank


def suffix_order(text: np.ndarray, symbols: int, depth: int, held: int = HELD) -> np.ndarray:
    """Positions of text in the order of their suffixes by the first `depth` symbols at least."""
    n = len(text)
    if n == 0:
        return np.zeros(0, PLACE)
    small = smaller(text)
    starts = np.flatnonzero(small & np.r_[False, ~small[:-1]]).astype(PLACE)
    first = Queues(symbols, held)
    if len(starts):
        rank = named(text, small, starts, depth)
        lms = starts[np.argsort(rank, kind="stable")]
        first.deal(text[lms], lms)
    larger, done = Queues(symbols, held), Queues(symbols, held)
    last = np.array([n - 1], PLACE)
    larger.deal(text[last], last)  # the empty suffix comes first and induces the last one

    def before(run: np.ndarray, want: bool) -> np.ndarray:
        run = run[run > 0] - 1
        return run[small[run] == want]

    for c in range(symbols):
        while len(run := larger.pop(c)):
            done.push(c, run)
            p = before(run, False)
            larger.deal(text[p], p)
        run = first.pop(c)
        if len(run):
            p = before(run, False)
            larger.deal(text[p], p)
    falling, result = Queues(symbols, held), []
    for c in range(symbols - 1, -1, -1):
        while len(run := falling.pop(c)):
            result.append(run)
            p = before(run, True)
            falling.deal(text[p], p)
        run = done.pop(c)[::-1]
        if len(run):
            result.append(run)
            p = before(run, True)
            falling.deal(text[p], p)
    for q in (first, larger, done, falling):
        q.close()
    return np.concatenate(result)[::-1]
