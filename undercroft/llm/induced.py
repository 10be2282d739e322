"""Induced suffix sorting of one shard, with common-prefix values, over bucket queues that spill to disk.

Suffixes are induced in the order of their first symbol, so the priority queue of the induction is a row of first-in
first-out queues, one per symbol: what is put in comes in the right order. Every step takes a whole queue at a time.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Common prefixes are counted up to this length.
DEPTH = 200


class Spool:
    """Chunks of positions and prefix values, the oldest on disk once they outgrow `memory` bytes together."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file, self.waiting = memory, 0, None, []

    def put(self, *arrays: np.ndarray) -> list:
        entry = [arrays, None]
        self.held += sum(a.nbytes for a in arrays)
        self.waiting.append(entry)
        while self.held > self.memory and self.waiting:
            self._spill(self.waiting.pop(0))
        return entry

    def _spill(self, entry: list) -> None:
        if self.file is None:
            # The task's own scratch file, unlinked at once: it goes with the task, whatever ends it.
            self.file = tempfile.TemporaryFile()
        entry[1] = []
        for a in entry[0]:
            entry[1].append((self.file.seek(0, os.SEEK_END), a.dtype, len(a)))
            self.file.write(a.tobytes())
            self.held -= a.nbytes
        entry[0] = None

    def get(self, entry: list) -> tuple[np.ndarray, ...]:
        if entry[0] is not None:
            return entry[0]
        out = []
        for at, dtype, n in entry[1]:
            self.file.seek(at)
            out.append(np.frombuffer(self.file.read(n * dtype.itemsize), dtype))
        return tuple(out)

    def join(self, entries: list) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.get(e) for e in entries]
        return (np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])) if len(parts) > 1 else parts[0]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol must be the only smallest."""
    step = np.sign(np.diff(text.astype(np.int32)))
    n = len(text)
    # A run of one symbol has the type of its end.
    known = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    out = np.ones(n, dtype=bool)
    out[:-1] = np.where(nearest < n - 1, step[np.minimum(nearest, n - 2)] > 0, False)
    return out


def _common(text: np.ndarray, a: int, b: int) -> int:
    x, y = text[a:a + DEPTH], text[b:b + DEPTH]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


class _Queues:
    """One side of the induction: queues by symbol, and for each the smallest prefix value scanned since its last entry."""

    def __init__(self, text: np.ndarray, symbols: int, spool: Spool):
        self.text, self.spool = text, spool
        self.queues: list[list] = [[] for _ in range(symbols)]
        self.lowest = np.full(symbols, DEPTH, dtype=np.int16)

    def push(self, pos: np.ndarray, wanted: np.ndarray, prefix: np.ndarray) -> None:
        """Scans suffixes `pos`, whose common prefix with the one scanned before is `prefix`, and queues the suffixes
        one symbol longer where `wanted`."""
        at = np.flatnonzero(wanted)
        targets = self.text[pos[at] - 1]
        order = np.argsort(targets, kind="stable")
        kinds, starts = np.unique(targets[order], return_index=True)
        floor = prefix.min() if len(prefix) else DEPTH
        before = self.lowest[kinds].copy()
        np.minimum(self.lowest, floor, out=self.lowest)
        for kind, low, group in zip(kinds, before, np.split(at[order], starts[1:])):
            cuts = np.concatenate(([0], group + 1))
            inside = cuts[cuts < len(prefix)]
            least = np.minimum.reduceat(prefix, inside)
            fresh = np.minimum(least[:len(group)] + 1, DEPTH).astype(np.int16)
            fresh[0] = min(int(fresh[0]), int(low) + 1) if self.queues[kind] else 0
            self.lowest[kind] = least[-1] if len(inside) > len(group) else DEPTH
            self.queues[kind].append(self.spool.put(pos[group] - 1, fresh))


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, seed_prefix: np.ndarray, symbols: int, memory: int):
    """All suffixes in order and their common prefix with the one before, from the leftmost smaller-type ones in order."""
    spool = Spool(memory)
    last = len(text) - 1
    seed_symbol = text[seeds]
    bounds = np.searchsorted(seed_symbol, np.arange(symbols + 1))
    larger = _Queues(text, symbols, spool)
    for c in range(symbols):
        end, i = None, 0
        while i < len(larger.queues[c]):  # grows while runs of the symbol are scanned
            waiting = larger.queues[c][i:]
            pos, prefix = spool.join(waiting)
            before = np.maximum(pos - 1, 0)
            larger.push(pos, (pos > 0) & ~small[before], prefix)
            end, i = int(pos[-1]), i + len(waiting)
        pos = seeds[bounds[c]:bounds[c + 1]]
        if len(pos):
            prefix = seed_prefix[bounds[c]:bounds[c + 1]].copy()
            prefix[0] = _common(text, end, int(pos[0])) if end is not None else 0
            before = np.maximum(pos - 1, 0)
            larger.push(pos, (pos > 0) & ~small[before], prefix)
    smaller = _Queues(text, symbols, spool)
    smaller.queues[0].append(spool.put(np.array([last]), np.zeros(1, np.int16)))
    for c in range(symbols - 1, -1, -1):
        end, i = None, 0
        while i < len(smaller.queues[c]):
            waiting = smaller.queues[c][i:]
            pos, prefix = spool.join(waiting)
            before = np.maximum(pos - 1, 0)
            smaller.push(pos, (pos > 0) & small[before], prefix)
            end, i = int(pos[-1]), i + len(waiting)
        if larger.queues[c]:
            pos, prefix = spool.join(larger.queues[c])
            back, down = pos[::-1], np.empty(len(pos), np.int16)
            down[1:] = prefix[:0:-1]
            down[0] = _common(text, end, int(back[0])) if end is not None else 0
            before = np.maximum(back - 1, 0)
            smaller.push(back, (back > 0) & small[before], down)
    order, common = [], []
    for c in range(symbols):
        tail = None
        for entry in larger.queues[c]:
            pos, prefix = spool.get(entry)
            order.append(pos)
            common.append(prefix)
            tail = int(pos[-1])
        if smaller.queues[c]:
            parts = [spool.get(e) for e in smaller.queues[c]]
            down = np.concatenate([p for p, _ in parts])
            value = np.concatenate([v for _, v in parts])
            order.append(down[::-1])
            up = np.empty(len(down), np.int16)
            up[1:] = value[:0:-1]
            up[0] = _common(text, tail, int(down[-1])) if tail is not None else 0
            common.append(up)
    spool.close()
    return np.concatenate(order), np.concatenate(common)


def _prefix_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers and hashes of the text's prefixes modulo 2^64, in blocks as there is no running multiply-add."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(text)
    powers = np.empty(n + 1, np.uint64)
    powers[0] = 1
    powers[1:] = np.multiply.accumulate(np.full(n, base, np.uint64))
    inverse = pow(int(base), -1, 1 << 64)
    back = np.multiply.accumulate(np.full(n, np.uint64(inverse), np.uint64))
    mixed = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed * back, dtype=np.uint64)))
    return powers, sums


def _piece(powers: np.ndarray, sums: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (sums[start + length] - sums[start]) * powers[start]


def suffix_order(text: np.ndarray, symbols: int, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the suffixes in order, common prefix of each with the one before, up to DEPTH).

    `text` holds symbols from 1 to symbols - 1 and ends with the only 0. The leftmost smaller-type suffixes are ordered
    by naming their pieces, which one induction sorts, and ordering the string of names; a second induction carries
    their order and common prefixes over to all suffixes. Suffixes that agree in more than DEPTH symbols stand next to
    each other in any order.
    """
    n = len(text)
    present = np.zeros(symbols, dtype=bool)
    present[text] = True
    text, symbols = (np.cumsum(present) - 1).astype(np.uint16)[text], int(present.sum())
    small = _smaller_types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms) or lms[-1] != n - 1:
        lms = np.append(lms, n - 1)
    bucket = np.argsort(text[lms], kind="stable")
    order, _ = _induce(text, small, lms[bucket], np.zeros(len(lms), np.int16), symbols, memory)
    mark = np.zeros(n, dtype=bool)
    mark[lms] = True
    pieces = order[mark[order]]
    del order, mark
    index = np.full(n, -1, np.int64)
    index[lms] = np.arange(len(lms))
    ends = np.append(lms[1:] + 1, n)
    powers, sums = _prefix_hashes(text)
    which = index[pieces]
    length = ends[which] - pieces
    code = _piece(powers, sums, pieces, length)
    new = np.ones(len(pieces), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (length[1:] != length[:-1])
    rank = np.empty(len(lms), np.int64)
    rank[which] = np.cumsum(new)
    # The string of names, ordered by doubling: names span two symbols at least, so few rounds reach DEPTH.
    step = 1
    while rank.max(initial=0) < len(lms) and step <= DEPTH:
        after = np.zeros(len(lms), np.int64)
        after[:-step] = rank[step:]
        pair = rank * (len(lms) + 1) + after
        _, rank = np.unique(pair, return_inverse=True)
        rank = rank + 1
        step *= 2
    seeds = lms[np.argsort(rank, kind="stable")]
    prefix = np.zeros(len(seeds), np.int16)
    if len(seeds) > 1:
        a, b = seeds[:-1], seeds[1:]
        low = np.zeros(len(a), np.int64)
        high = np.minimum(DEPTH, n - np.maximum(a, b))
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = _piece(powers, sums, a, mid) == _piece(powers, sums, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        prefix[1:] = low
    del powers, sums, index, ends, which, length, code, new, rank, pieces
    return _induce(text, small, seeds, prefix, symbols, memory)
