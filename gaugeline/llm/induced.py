"""External induced sorting of the suffixes of many strings, with common-prefix lengths.

The text is ``0 s1 0 s2 0 ...``: every string is closed by a terminator 0 that is smaller than all symbols and
differs from every other terminator. Suffixes are split into L type (larger than the suffix after them), S type
(smaller) and S* (S type after an L type). S* substrings are named and the string of names is sorted by recursion;
from the sorted S* suffixes the L types are induced in ascending order, and from those the S types in descending
order. Tuples (position, common prefix with the tuple before) wait in a priority queue whose buckets spill to disk,
and are taken out and processed a block at a time.

Common prefixes are carried up to ``cap``; suffixes equal that far may stand in any order.

Every array that grows with the text (bytes, symbols, types, names, seeds, flags) comes from ``Files``: beyond its
budget it is a memory-mapped file, and such arrays are made and read a block at a time. In memory are the queues' budget,
a few blocks, one number for each string, and the base case of at most ``base_case`` names.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples taken out of the queue at a time.
BLOCK = 1 << 17


class Files:
    """Hands out arrays: in memory up to ``budget`` bytes each, beyond it in nameless files in ``folder``."""

    def __init__(self, folder: str | None, budget: int):
        self.folder, self.budget = folder, budget
        #: bytes that went to files
        self.mapped = 0

    def new(self, n: int, dtype) -> np.ndarray:
        """An array of n zeros."""
        size = n * np.dtype(dtype).itemsize
        if size <= self.budget:
            return np.zeros(n, dtype)
        self.mapped += size
        with tempfile.TemporaryFile(dir=self.folder) as file:
            return np.memmap(file, dtype, "w+", shape=(n,))

    def where(self, flags: np.ndarray) -> np.ndarray:
        """Places of the true values."""
        out = self.new(sum(int(np.count_nonzero(flags[i : i + BLOCK])) for i in range(0, len(flags), BLOCK)), np.int64)
        at = 0
        for i in range(0, len(flags), BLOCK):
            got = np.flatnonzero(flags[i : i + BLOCK]) + i
            out[at : at + len(got)] = got
            at += len(got)
        return out

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Dense ranks from 0 of 64-bit keys; beyond the budget by sorted runs in files, merged a block at a time."""
        n, out = len(keys), self.new(len(keys), np.int64)
        if keys.nbytes <= self.budget:
            out[:] = np.unique(keys, return_inverse=True)[1]
            return out
        run = max(1024, self.budget // 16)
        key, who = self.new(n, np.uint64), self.new(n, np.int64)
        for i in range(0, n, run):
            order = np.argsort(keys[i : i + run], kind="stable")
            key[i : i + run], who[i : i + run] = np.asarray(keys[i : i + run])[order], order + i
        heads = np.arange(0, n, run)
        ends = np.minimum(heads + run, n)
        piece = max(64, run // len(heads))
        last, rank = None, -1
        while len(heads):
            # all keys up to the least last key of the runs' next pieces are at hand
            stops = np.minimum(heads + piece, ends)
            bound = min(int(key[b - 1]) for b in stops)
            cuts = np.array([a + int(np.searchsorted(key[a:b], np.uint64(bound), side="right")) for a, b in zip(heads, stops, strict=True)])
            k = np.concatenate([key[a:b] for a, b in zip(heads, cuts, strict=True)])
            w = np.concatenate([who[a:b] for a, b in zip(heads, cuts, strict=True)])
            order = np.argsort(k, kind="stable")
            k = k[order]
            new = np.concatenate([[last is None or int(k[0]) != last], k[1:] != k[:-1]])
            step = np.cumsum(new) + rank
            out[w[order]] = step
            last, rank = int(k[-1]), int(step[-1])
            heads, ends = cuts[cuts < ends], ends[cuts < ends]
        return out


class SpillQueue:
    """A priority queue of (bucket, insertion order) -> (position, common prefix).

    Induction inserts tuples of one bucket in sorted order, so within a bucket it is first in, first out. Chunks
    beyond ``budget`` bytes of memory are written to one file in ``folder`` and read back when their turn comes.
    """

    def __init__(self, folder: str, budget: int):
        self._chunks: dict[int, list] = defaultdict(list)
        self._heap: list[int] = []
        self._held = 0
        self._budget = budget
        self._file = tempfile.TemporaryFile(dir=folder)
        self.spilled = 0

    def push(self, bucket: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if bucket not in self._chunks:
            heapq.heappush(self._heap, bucket)
        self._chunks[bucket].append((pos, lcp))
        self._held += pos.nbytes + lcp.nbytes
        if self._held > self._budget:
            self._spill()

    def _spill(self) -> None:
        self._file.seek(0, os.SEEK_END)
        for rows in self._chunks.values():
            for i, c in enumerate(rows):
                if isinstance(c[0], np.ndarray):
                    at = self._file.tell()
                    pos, lcp = c
                    self._file.write(pos.tobytes())
                    self._file.write(lcp.tobytes())
                    self.spilled += pos.nbytes + lcp.nbytes
                    rows[i] = (at, len(pos), pos.dtype, lcp.dtype)
        self._held = 0

    def _load(self, c) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(c[0], np.ndarray):
            self._held -= c[0].nbytes + c[1].nbytes
            return c
        at, n, a, b = c
        self._file.seek(at)
        return np.frombuffer(self._file.read(n * a.itemsize), a), np.frombuffer(self._file.read(n * b.itemsize), b)

    def lowest(self) -> int | None:
        while self._heap and self._heap[0] not in self._chunks:
            heapq.heappop(self._heap)
        return self._heap[0] if self._heap else None

    def take(self, bucket: int, reverse: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of a bucket in order of insertion, or in the opposite order of chunks; the bucket is empty after."""
        rows = self._chunks.pop(bucket, [])
        rows = rows[::-1] if reverse else rows
        part: list = []
        n = 0
        for c in rows:
            part.append(self._load(c))
            n += len(part[-1][0])
            if n >= BLOCK:
                yield self._join(part, reverse)
                part, n = [], 0
        if part:
            yield self._join(part, reverse)

    @staticmethod
    def _join(part: list, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(part) == 1:
            return part[0]
        part = part[::-1] if reverse else part
        return np.concatenate([p for p, _ in part]), np.concatenate([x for _, x in part])

    def close(self) -> None:
        self._file.close()


def _types(t: np.ndarray, files: Files) -> np.ndarray:
    """True where the suffix is of S type; the last symbol is a terminator and of S type."""
    n = len(t)
    out = files.new(n, bool)
    out[n - 1] = True
    for b in range(n - 1, 0, -BLOCK):
        a = max(0, b - BLOCK)
        x = np.asarray(t[a : b + 1])
        k = b - a
        at = np.where(x[:-1] != x[1:], np.arange(k), k)
        at = np.minimum.accumulate(at[::-1])[::-1]
        kind = np.full(k, bool(out[b]))
        ok = at < k
        kind[ok] = x[at[ok]] < x[at[ok] + 1]
        out[a:b] = kind
    return out


def _names(t: np.ndarray, s_type: np.ndarray, start: np.ndarray, end: np.ndarray, files: Files) -> np.ndarray:
    """Order-preserving names 1.. of the S* substrings t[start..end], both ends included.

    A symbol counts as 2 * symbol + type, so no substring is a proper prefix of another. As many symbols as fit into 64
    bits are ranked at a time; substrings that go on are ranked by their name so far and their next symbols.
    """
    most = max(int(t[i : i + BLOCK].max()) for i in range(0, len(t), BLOCK))
    bits = (2 * most + 1).bit_length()
    per = max(1, 63 // bits)

    def packed(who: np.ndarray | None, done: int) -> np.ndarray:
        n = len(start) if who is None else len(who)
        out = files.new(n, np.uint64)
        for i in range(0, n, BLOCK):
            pick = slice(i, min(n, i + BLOCK)) if who is None else who[i : i + BLOCK]
            a, b = start[pick] + done, end[pick]
            key = np.zeros(len(a), dtype=np.uint64)
            for k in range(per):
                at = np.minimum(a + k, b)
                sym = (t[at].astype(np.uint64) << np.uint64(1)) | s_type[at]
                key = (key << np.uint64(bits)) | np.where(a + k <= b, sym, np.uint64(0))
            out[i : i + len(a)] = key
        return out

    name = files.rank(packed(None, 0))
    done = per
    long = files.new(len(start), bool)
    for i in range(0, len(start), BLOCK):
        long[i : i + BLOCK] = end[i : i + BLOCK] - start[i : i + BLOCK] >= done
    who = files.where(long)
    while len(who):
        # substrings of one name go on all or none, so each such name is split by the ranks of what follows
        both = files.rank(packed(who, done)).view(np.uint64)
        for i in range(0, len(who), BLOCK):
            both[i : i + BLOCK] |= name[who[i : i + BLOCK]].astype(np.uint64) << np.uint64(32)
        sub = files.rank(both)
        top = max(int(name[i : i + BLOCK].max()) for i in range(0, len(name), BLOCK)) + 1
        low, count = files.new(top, np.int64), files.new(top, np.int64)
        low[:] = len(who)
        for i in range(0, len(who), BLOCK):
            n, k = name[who[i : i + BLOCK]], sub[i : i + BLOCK]
            np.minimum.at(low, n, k)
            np.maximum.at(count, n, k + 1)
        # how many names come before each: those that are not split count once
        first = files.new(top, np.int64)
        before = 0
        for i in range(0, top, BLOCK):
            size = np.where(count[i : i + BLOCK] > 0, count[i : i + BLOCK] - low[i : i + BLOCK], 1)
            first[i : i + BLOCK] = np.cumsum(size) - size + before
            before += int(size.sum())
        extra = files.new(len(who), np.int64)
        for i in range(0, len(who), BLOCK):
            extra[i : i + BLOCK] = sub[i : i + BLOCK] - low[name[who[i : i + BLOCK]]]
        for i in range(0, len(name), BLOCK):
            name[i : i + BLOCK] = first[name[i : i + BLOCK]]
        done += per
        on = files.new(len(who), bool)
        for i in range(0, len(who), BLOCK):
            pick = who[i : i + BLOCK]
            name[pick] += extra[i : i + BLOCK]
            on[i : i + BLOCK] = end[pick] - start[pick] >= done
        kept = files.where(on)
        new = files.new(len(kept), np.int64)
        for i in range(0, len(kept), BLOCK):
            new[i : i + BLOCK] = who[kept[i : i + BLOCK]]
        who = new
    for i in range(0, len(name), BLOCK):
        name[i : i + BLOCK] += 1
    return name


def _doubling(r: np.ndarray, cap: int) -> np.ndarray:
    """In-memory base case: positions of r's symbols other than 0 in suffix order, exact to ``cap`` symbols."""
    n = len(r)
    stop = np.flatnonzero(r == 0)
    sym = r.astype(np.int64) + len(stop)
    sym[stop] = np.arange(len(stop))
    counts = np.bincount(sym)
    below = np.concatenate([[0], np.cumsum(counts)])
    rank = below[sym]
    h = 1
    todo = np.flatnonzero(counts[sym] > 1)
    while len(todo) and h < 2 * cap:
        key = rank[todo] * (n + 1) + rank[todo + h]
        order = np.argsort(key, kind="stable")
        key, who = key[order], todo[order]
        old = rank[who]
        new_sub = np.concatenate([[True], key[1:] != key[:-1]])
        new_grp = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(who))
        sub = np.maximum.accumulate(np.where(new_sub, at, 0))
        grp = np.maximum.accumulate(np.where(new_grp, at, 0))
        rank[who] = old + (sub - grp)
        single = new_sub & np.concatenate([new_sub[1:], [True]])
        todo = np.sort(who[~single])
        h *= 2
    order = np.argsort(rank, kind="stable")
    return order[r[order] != 0]


def _neighbour_lcp(word: np.ndarray, stops: np.ndarray, pos: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, up to cap, of each suffix with the one before it.

    word: the eight bytes from each place on; stops: places of the terminators.
    """
    out = np.zeros(len(pos), dtype=np.int64)
    if len(pos) < 2:
        return out
    left = stops[np.searchsorted(stops, pos)] - pos
    a, b, todo = pos[:-1].copy(), pos[1:].copy(), np.arange(1, len(pos))
    most = np.minimum(np.minimum(left[:-1], left[1:]), cap)
    done = 0
    while len(todo):
        x = word[a + done] ^ word[b + done]
        same = x == 0
        low = x[~same]
        low = low & (~low + np.uint64(1))
        out[todo[~same]] = done + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        done += 8
        out[todo[same]] = done
        keep = same & (most[todo - 1] > done)
        a, b, todo = a[keep], b[keep], todo[keep]
    out[1:] = np.minimum(out[1:], most)
    return out


class _RangeMin:
    """Least value of x[lo..hi] (both included) for arrays of lo and hi."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        span = hi - lo + 1
        level = np.frexp(span.astype(np.float64))[1] - 1
        while len(self.rows) <= int(level.max(initial=0)):
            x, k = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(x[: max(0, len(x) - k)], x[k:]))
        out = np.empty(len(lo), dtype=self.rows[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k)) + 1])
        return out


class _Inducer:
    """Hands tuples of one bucket on to the buckets of the symbols before them, with their common prefixes."""

    def __init__(self, t: np.ndarray, queue: SpillQueue, sign: int, cap: int, carry: bool):
        self.t, self.queue, self.sign, self.cap, self.carry = t, queue, sign, cap, carry
        #: least common prefix since the last tuple handed on to a bucket
        self.since: np.ndarray | None = np.zeros(max(int(t[i : i + BLOCK].max()) for i in range(0, len(t), BLOCK)) + 1, dtype=np.int64) if carry else None
        self.own: list = []

    def start(self, bucket: int) -> None:
        self.bucket = bucket
        if self.carry:
            self.since[:] = 0

    def feed(self, pos: np.ndarray, lcp: np.ndarray, own: bool, first_of_own: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
        """Pushes to other buckets; returns the tuples for the same bucket (where ``own``)."""
        before = self.t[pos - 1].astype(np.int64)
        go = (before > self.bucket) if self.sign > 0 else (before < self.bucket) & (before > 0)
        if own:
            go |= before == self.bucket
        at = np.flatnonzero(go)
        b = before[at]
        order = np.argsort(b.astype(np.uint16) if b.size and b.max() < 65536 else b, kind="stable")
        at, b = at[order], b[order]
        fresh = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
        low = np.zeros(len(at), dtype=np.int64)
        if self.carry:
            lead = at[fresh]
            if len(at):
                rest = np.flatnonzero(~fresh)
                if len(rest):
                    low[rest] = _RangeMin(lcp)(at[rest - 1] + 1, at[rest])
                low[fresh] = np.minimum(self.since[b[fresh]], np.minimum.accumulate(lcp)[lead])
            # how far the least common prefix since each bucket's last tuple has fallen
            self.since = np.minimum(self.since, int(lcp.min()))
            if len(at):
                last = np.concatenate([fresh[1:], [True]])
                tail = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1], [self.cap]])
                self.since[b[last]] = tail[at[last] + 1]
            low = np.minimum(low + 1, self.cap)
        new = pos[at] - 1
        low = low.astype(lcp.dtype)
        mine = None
        edges = np.append(np.flatnonzero(fresh), len(b))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if own and b[i] == self.bucket:
                mine = (new[i:j], low[i:j])
            else:
                self.queue.push(self.sign * int(b[i]), new[i:j], low[i:j])
        return mine


def _run(t: np.ndarray, at: int, cap: int) -> int:
    """How often the symbol at ``at`` repeats from there, up to cap."""
    piece = t[at : at + cap]
    differ = np.flatnonzero(piece != piece[0])
    return int(differ[0]) if len(differ) else len(piece)


def induced_sort(
    t: np.ndarray,
    emit: Callable[[np.ndarray, np.ndarray], None],
    cap: int = 200,
    folder: str | None = None,
    budget: int = 64 << 20,
    base_case: int = 1 << 23,
    raw: np.ndarray | None = None,
) -> dict:
    """Calls emit(positions, common prefixes) in descending suffix order, a block at a time.

    t: 0, then strings of symbols >= 1, each closed by a 0. Each prefix length is that with the suffix emitted
    just before. raw: one byte for each symbol, where common prefixes are wanted; without it they are 0.
    Up to ``budget`` bytes of tuples stay in memory for each queue, the rest lies in files in ``folder``.
    Strings of names longer than ``base_case`` are sorted by recursion, shorter ones in memory.
    Arrays of more than ``budget`` bytes lie there too.
    Returns figures: levels of recursion, bytes of tuples spilled, bytes of arrays in files.
    """
    carry = raw is not None
    n = len(t)
    stats = {"levels": 1, "spilled": 0, "mapped": 0}
    files = Files(folder, budget)
    ends = files.new(n, bool)
    for i in range(0, n, BLOCK):
        ends[i : i + BLOCK] = t[i : i + BLOCK] == 0
    stops = files.where(ends)[1:]
    del ends
    if n <= 1 or not len(stops):
        return stats
    kind = np.uint8 if cap < 256 else np.int64
    s_type = _types(t, files)
    leads = files.new(n, bool)
    for i in range(1, n, BLOCK):
        j = min(n, i + BLOCK)
        leads[i:j] = s_type[i:j] & ~s_type[i - 1 : j - 1] & (np.asarray(t[i - 1 : j - 1]) > 0)
    star = files.where(leads)
    del leads
    inner = files.new(len(star), bool)
    for i in range(0, len(star), BLOCK):
        inner[i : i + BLOCK] = t[star[i : i + BLOCK]] > 0
    at = files.where(inner)
    if len(at):
        start, end = files.new(len(at), np.int64), files.new(len(at), np.int64)
        for i in range(0, len(at), BLOCK):
            start[i : i + BLOCK], end[i : i + BLOCK] = star[at[i : i + BLOCK]], star[at[i : i + BLOCK] + 1]
        named = _names(t, s_type, start, end, files)
        del start, end
        r = files.new(len(star) + 1, np.int64)
        for i in range(0, len(at), BLOCK):
            r[at[i : i + BLOCK] + 1] = named[i : i + BLOCK]
        del named
        seeds = files.new(len(at), np.int64)
        if len(r) <= base_case:
            order = _doubling(np.asarray(r), cap)
            for i in range(0, len(order), BLOCK):
                seeds[i : i + BLOCK] = star[order[i : i + BLOCK] - 1]
            del order
        else:
            left = [len(at)]

            def place(p: np.ndarray, _) -> None:
                # the recursion hands out the largest suffix first
                left[0] -= len(p)
                seeds[left[0] : left[0] + len(p)] = star[p[::-1] - 1]

            more = induced_sort(r, place, cap, folder, budget, base_case)
            stats["levels"] += more["levels"]
            stats["spilled"] += more["spilled"]
            stats["mapped"] += more["mapped"]
        del r
    else:
        seeds = star[:0]
    del star, inner, at, s_type
    seed_lcp = files.new(len(seeds), kind)
    if carry:
        padded = files.new(n + cap + 16, np.uint8)
        for i in range(0, n, BLOCK):
            padded[i : min(n, i + BLOCK)] = raw[i : i + BLOCK]
        word = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(padded) - 7,), strides=(1,))
        for i in range(0, len(seeds), BLOCK):
            a = max(0, i - 1)
            seed_lcp[i : i + BLOCK] = _neighbour_lcp(word, stops, np.asarray(seeds[a : i + BLOCK]), cap)[i - a :].astype(kind)
        del word, padded
    seed_at: dict[int, int] = {}
    for i in range(0, len(seeds), BLOCK):
        heads = t[seeds[i : i + BLOCK]]
        for j in np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])):
            seed_at.setdefault(int(heads[j]), i + int(j))
    bounds = sorted(seed_at.items())
    seed_range = {c: (i, bounds[k + 1][1] if k + 1 < len(bounds) else len(seeds)) for k, (c, i) in enumerate(bounds)}
    waiting = sorted(seed_range, reverse=True)

    # L types, ascending
    lo_queue = SpillQueue(folder, budget)
    kept = SpillQueue(folder, budget)
    push = _Inducer(t, lo_queue, 1, cap, carry)
    push.start(0)
    for i in range(0, len(stops), BLOCK):
        part = stops[i : i + BLOCK]
        push.feed(part, np.zeros(len(part), dtype=kind), own=False)
    while True:
        nxt = [x for x in (lo_queue.lowest(), waiting[-1] if waiting else None) if x is not None]
        if not nxt:
            break
        c = min(nxt)
        push.start(c)
        last = None
        wave = 0
        blocks = lo_queue.take(c)
        while True:
            again: list = []
            for pos, lcp in blocks:
                if last is None and len(lcp):
                    lcp = lcp.copy()
                    lcp[0] = 0
                kept.push(c, pos, lcp)
                mine = push.feed(pos, lcp, own=True)
                last = int(pos[-1])
                if mine is not None:
                    again.append(mine)
            if not again:
                break
            wave += 1
            again[0][1][0] = min(wave, cap)
            blocks = iter(again)
        if waiting and waiting[-1] == c:
            waiting.pop()
            a, b = seed_range[c]
            for i in range(a, b, BLOCK):
                pos, lcp = seeds[i : min(b, i + BLOCK)], seed_lcp[i : min(b, i + BLOCK)].copy()
                if i == a:
                    lcp[0] = min(_run(t, last, cap), _run(t, int(pos[0]), cap), cap) if carry and last is not None else 0
                push.feed(pos, lcp, own=False)
    stats["spilled"] += lo_queue.spilled + kept.spilled
    lo_queue.close()
    stats["mapped"] += files.mapped
    del seeds, seed_lcp

    # S types, descending; then the bucket's L types, descending
    hi_queue = SpillQueue(folder, budget)
    push = _Inducer(t, hi_queue, -1, cap, carry)
    buckets = sorted((-c for c in kept._chunks), reverse=True)
    while True:
        nxt = [x for x in (hi_queue.lowest(), buckets[-1] if buckets else None) if x is not None]
        if not nxt:
            break
        key = min(nxt)
        c = -key
        push.start(c)
        last = None
        wave = 0
        blocks = hi_queue.take(key)
        while True:
            again = []
            for pos, lcp in blocks:
                if last is None:
                    lcp = lcp.copy()
                    lcp[0] = 0
                emit(pos, lcp)
                mine = push.feed(pos, lcp, own=True)
                last = int(pos[-1])
                if mine is not None:
                    again.append(mine)
            if not again:
                break
            wave += 1
            again[0][1][0] = min(wave, cap)
            blocks = iter(again)
        if buckets and buckets[-1] == key:
            buckets.pop()
            pending = None  # the common prefix of the block before with the next smaller suffix
            for pos, lcp in kept.take(c, reverse=True):
                down = pos[::-1]
                shifted = np.empty_like(lcp)
                shifted[1:] = lcp[:0:-1]
                if pending is not None:
                    shifted[0] = pending
                else:
                    shifted[0] = min(_run(t, last, cap), _run(t, int(down[0]), cap), cap) if carry and last is not None else 0
                pending = lcp[0]
                emit(down, shifted)
                push.feed(down, shifted, own=False)
    stats["spilled"] += hi_queue.spilled
    hi_queue.close()
    kept.close()
    return stats


class Spool:
    """Collects the strings of a shard as ``0 s1 0 s2 0 ...``; beyond the budget their bytes go to a file as they come."""

    def __init__(self, files: Files):
        self.files, self.sizes, self.held, self.bytes = files, [], [np.zeros(1, np.uint8)], 1
        self._file = None

    def add(self, data: np.ndarray, at: np.ndarray) -> None:
        """Strings data[at[i]:at[i + 1]]."""
        size = np.diff(at)
        out = np.zeros(len(data) + len(size), dtype=np.uint8)
        out[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
        self.sizes.append(size)
        self.held.append(out)
        self.bytes += len(out)
        if sum(map(len, self.held)) > self.files.budget:
            self._file = self._file or tempfile.TemporaryFile(dir=self.files.folder)
            for x in self.held:
                self._file.write(x.tobytes())
            self.held = []

    def close(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, bytes, start of each string); a symbol is its byte + 1, and 0 closes a string."""
        if self._file is None:
            raw = np.concatenate(self.held)
        else:
            for x in self.held:
                self._file.write(x.tobytes())
            self._file.flush()
            with self._file as file:
                raw = np.memmap(file, np.uint8, "r", shape=(self.bytes,))
            self.files.mapped += self.bytes
        size = np.concatenate([np.zeros(0, np.int64), *self.sizes])
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1] + 1
        t = self.files.new(self.bytes, np.uint16)
        for i in range(0, self.bytes, BLOCK):
            t[i : i + BLOCK] = raw[i : i + BLOCK].astype(np.uint16) + np.uint16(1)
        t[0] = 0
        t[start + size] = 0
        return t, raw, start


def layout(texts: list[bytes], folder: str | None = None, budget: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bytes, start of each text) of ``0 s1 0 s2 0 ...``; a symbol is its byte + 1."""
    spool = Spool(Files(folder, budget))
    spool.add(np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64))
    return spool.close()


def suffix_array(texts: list[bytes], cap: int = 200, **options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in ascending order, common prefix with the suffix before, start of each text): for tests and small inputs."""
    t, raw, start = layout([x for x in texts if x])
    pos, lcp = [], []
    induced_sort(t, lambda p, x: (pos.append(p.copy()), lcp.append(x.astype(np.int64))), cap, raw=raw, **options)
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), start
    p, x = np.concatenate(pos)[::-1], np.concatenate(lcp)
    x = np.concatenate([[0], x[::-1][:-1]]) if len(x) else x
    return p, x, start


def repeated_starts(spool: Spool, length: int, **options) -> tuple[np.ndarray, np.ndarray, dict]:
    """(flags, start of each string, figures): flags[p] where the string of ``length`` symbols at p also starts elsewhere."""
    files = spool.files
    t, raw, start = spool.close()
    flag = files.new(len(t), bool)
    state = {"last": -1}

    def emit(pos: np.ndarray, lcp: np.ndarray) -> None:
        far = np.flatnonzero(lcp >= length)
        if len(far):
            flag[pos[far]] = True
            flag[pos[far[far > 0] - 1]] = True
            if far[0] == 0 and state["last"] >= 0:
                flag[state["last"]] = True
        state["last"] = int(pos[-1])

    stats = induced_sort(t, emit, length, files.folder, files.budget, raw=raw, **options)
    return flag, start, stats
