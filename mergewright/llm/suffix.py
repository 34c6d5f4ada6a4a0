"""Suffix arrays with common-prefix lengths by external induced sorting.

A text's suffixes fall into types S and L (smaller or larger than the suffix one to the right). The leftmost S of each run (LMS) are
sorted first: the pieces between them are sorted by induction and named, and the shorter text of names is sorted in the same way, by recursion, until all
names differ or stand for as many bytes as count. All other suffixes are induced from them: suffixes are traversed in order, and each hands the suffix to
its left to the bucket of that one's first character.

The buckets form a priority queue keyed by character, whose items (suffix and common-prefix length) arrive in order inside each. It holds `budget` bytes
in memory; beyond that all it holds goes to a file, stretch by stretch of a bucket. Text, names, LMS suffixes, sorted suffixes and lengths are files too, read through
memory maps or a block at a time, so that a text may be far larger than memory: what is held at a time is the budget and a few blocks.

Bytes have a bucket each, traversed as a stream. The names of an inner level may be as many as its characters, so there a bucket is a range of names that
fits the budget. The suffixes of a range, with those that they induce inside it, are loaded and sorted by (character, source) with doubling along the
chains of sources, which gives the order in which the traversal would have met them; a single name beyond the budget is a stream again.

Along with each suffix of the text itself travels the length it has in common with the one before it, capped: 1 more than the least among the sources between
two that feed the same bucket. The lengths of the LMS suffixes, where induction starts, are read off the text. Inner levels need no lengths and carry none."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import deque
from contextlib import contextmanager

import numpy as np

BUDGET = 1 << 20
BLOCK = 1 << 16
#: Zeros that follow a text in its file, beyond the cap.
PAD = 16
_LOG = np.zeros(BLOCK + 2, np.int64)
_LOG[2:] = np.floor(np.log2(np.arange(2, BLOCK + 2))).astype(np.int64)


@contextmanager
def scratch(folder: str | None = None):
    """A folder for the files of one task, deleted when it ends. Without one given it lies where Spark's own tasks spill on this machine; nothing in it
    outlives the task or is read by another, which a lost executor's task does all over again."""
    if folder is None:
        folder = next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.path.isdir(d) and os.access(d, os.W_OK)), None)
    made = tempfile.mkdtemp(prefix="suffixes-", dir=folder)
    try:
        yield made
    finally:
        shutil.rmtree(made, ignore_errors=True)


class Log:
    """A file of numbers that grows at its end."""

    def __init__(self, folder: str, kind):
        fd, self.path = tempfile.mkstemp(dir=folder)
        self.file, self.kind, self.n = os.fdopen(fd, "wb", 1 << 16), np.dtype(kind), 0

    def append(self, x: np.ndarray) -> None:
        if len(x):
            self.file.write(memoryview(np.ascontiguousarray(x, self.kind)).cast("B"))
            self.n += len(x)

    def read(self, lo: int, hi: int) -> np.ndarray:
        self.file.flush()
        return np.fromfile(self.path, self.kind, hi - lo, offset=lo * self.kind.itemsize)

    def blocks(self, lo: int = 0, hi: int | None = None):
        hi = self.n if hi is None else hi
        for a in range(lo, hi, BLOCK):
            yield self.read(a, min(hi, a + BLOCK))

    def back(self, lo: int = 0, hi: int | None = None):
        """Blocks from the end, each from its end."""
        hi = self.n if hi is None else hi
        for b in range(hi, lo, -BLOCK):
            yield self.read(max(lo, b - BLOCK), b)[::-1]

    def map(self) -> np.ndarray:
        self.file.flush()
        return np.asarray(np.memmap(self.path, self.kind, "r", shape=(self.n,))) if self.n else np.zeros(0, self.kind)

    def close(self) -> None:
        self.file.close()
        os.unlink(self.path)


class Queue:
    """Items by bucket, first in first out; kinds: the types of an item's parts. Over `budget` bytes in memory, all goes to a file for each part in `folder`, in
    which every bucket has its stretches."""

    def __init__(self, folder: str, kinds, budget: int = BUDGET):
        self.kinds, self.budget = [np.dtype(k) for k in kinds], budget
        self.held: dict[int, list[tuple]] = {}
        self.size, self.spilled, self.rest, self.written = 0, 0, 0, 0
        self.stretches: dict[int, deque] = {}  # (first item in the files, number)
        self.files = [tempfile.TemporaryFile(dir=folder, buffering=0) for _ in kinds]

    def push(self, bucket: int, *parts: np.ndarray) -> None:
        self.held.setdefault(bucket, []).append(parts)
        self.size += sum(p.nbytes for p in parts)
        if self.size > self.budget:
            self.spill()

    def spill(self) -> None:
        for k, (kind, file) in enumerate(zip(self.kinds, self.files)):
            raw = np.concatenate([parts[k] for some in self.held.values() for parts in some]).astype(kind, copy=False)
            os.pwrite(file.fileno(), memoryview(raw).cast("B"), self.written * kind.itemsize)
        for bucket, some in self.held.items():
            n = sum(len(parts[0]) for parts in some)
            self.stretches.setdefault(bucket, deque()).append((self.written, n))
            self.written += n
            self.spilled += 1
        self.held, self.size = {}, 0

    def pop(self, bucket: int):
        """The items of a bucket in order, BLOCK at most at a time; more may be pushed meanwhile. What is in the files came before what is held."""
        while True:
            if waiting := self.stretches.get(bucket):
                some, n = [], 0
                while waiting and n < BLOCK:
                    at, m = waiting.popleft()
                    if m > BLOCK - n:
                        waiting.appendleft((at + BLOCK - n, m - BLOCK + n))
                        m = BLOCK - n
                    some.append((at, m))
                    n += m
                self.rest = 0
                yield [np.concatenate([np.frombuffer(os.pread(file.fileno(), m * kind.itemsize, at * kind.itemsize), kind) for at, m in some]) for kind, file in zip(self.kinds, self.files)]
            elif some := self.held.pop(bucket, None):
                parts = [np.concatenate(p) if len(p) > 1 else p[0] for p in zip(*some)]
                self.size -= sum(p.nbytes for p in parts)
                for lo in range(0, len(parts[0]), BLOCK):
                    self.rest = max(0, len(parts[0]) - lo - BLOCK)
                    yield [p[lo : lo + BLOCK] for p in parts]
            else:
                return

    def emptied(self, bucket: int) -> bool:
        """Whether what pop() gave last is all that the bucket holds."""
        return not self.rest and not self.stretches.get(bucket) and bucket not in self.held

    def load(self, bucket: int) -> np.ndarray:
        """All items of a bucket of one part."""
        parts = [p[0] for p in self.pop(bucket)]
        return np.concatenate(parts) if parts else np.zeros(0, self.kinds[0])

    def close(self) -> None:
        for file in self.files:
            file.close()


class Feed:
    """The least common length since each bucket was last fed, over a traversal in order."""

    def __init__(self, sigma: int, cap: int):
        self.cap, self.seen, self.since = cap, np.zeros(sigma, bool), np.full(sigma, cap, np.int64)

    def lengths(self, lcp: np.ndarray, at: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """at: which of the block's items feed a bucket, ordered by bucket and then place; chars: the buckets. The lengths of the fed items."""
        m = len(lcp)
        table = [lcp]
        while 2 << (len(table) - 1) <= m:
            w, last = 1 << (len(table) - 1), table[-1]
            low = last.copy()
            np.minimum(last[:-w], last[w:], out=low[:-w])
            table.append(low)
        table = np.stack(table)
        first = np.ones(len(at), bool)
        first[1:] = chars[1:] != chars[:-1]
        before = np.where(first, -1, np.concatenate([[-1], at[:-1]]))
        level = _LOG[at - before]
        low = np.minimum(table[level, before + 1], table[level, at - (1 << level) + 1]).astype(np.int64)
        heads = chars[first]
        low[first] = np.where(self.seen[heads], np.minimum(low[first], self.since[heads]), -1)
        last = np.ones(len(at), bool)
        last[:-1] = first[1:]
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.cap)
        np.minimum(self.since, int(tail[0]), out=self.since)
        self.since[chars[last]] = tail[at[last] + 1]
        self.seen[heads] = True
        return np.minimum(low + 1, self.cap).astype(lcp.dtype)

    def skip(self, lcp: np.ndarray) -> None:
        np.minimum(self.since, int(lcp.min()), out=self.since)


def lms_blocks(t: np.ndarray):
    """The LMS suffixes in the order of the text, block by block."""
    n, before = len(t), True
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        x = t[lo : min(n, hi + 1)].astype(np.int64)
        step = np.sign(np.diff(x))
        if hi == n:
            step = np.append(step, -1)
        elif step[-1] == 0:  # the run goes on: what ends it says
            for a in range(hi, n, BLOCK):
                other = np.flatnonzero(t[a : a + BLOCK] != t[hi - 1])
                if len(other):
                    step[-1] = 1 if t[a + other[0]] > t[hi - 1] else -1
                    break
            else:
                step[-1] = -1
        at = np.where(step != 0, np.arange(len(step)), len(step))
        s = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
        yield lo + np.flatnonzero(s & ~np.concatenate([[before], s[:-1]]))
        before = bool(s[-1])


def ranges(t: np.ndarray, lo: int, hi: int, most: int) -> list[int]:
    """The first characters of ranges that cover [lo, hi) and have `most` suffixes at most, but for single characters."""
    width = max(1, -(-(hi - lo) // 4096))
    counts = np.zeros(-(-(hi - lo) // width), np.int64)
    for a in range(0, len(t), BLOCK):
        x = t[a : a + BLOCK].astype(np.int64)
        counts += np.bincount((x[(x >= lo) & (x < hi)] - lo) // width, minlength=len(counts))
    out, room = [], -1
    for i, k in enumerate(counts.tolist()):
        first = lo + i * width
        if k > most and width > 1:
            out += ranges(t, first, min(hi, first + width), most)
            room = -1
        elif k > room:
            out.append(first)
            room = most - k
        else:
            room -= k
    return out


def settle(t: np.ndarray, items: np.ndarray, terms: np.ndarray, lo: int, hi: int, sign: int):
    """One range of a traversal. items: the suffixes that arrived, in order; terms: those sorted before (LMS when larger ones are induced, sign 1; larger
    ones when smaller ones are, sign -1), in the order of the traversal. -> all suffixes of the range in that order, the character each induces (-1: none),
    and which are terms.

    In a traversal the suffixes of a character that came from outside of the range stand first, as they arrived; others follow in the order of their sources."""
    pos, source, term, chars = [np.concatenate([items, terms])], [np.full(len(items) + len(terms), -1)], np.arange(len(items) + len(terms)) >= len(items), []
    known, held = 0, term
    while len(pos[-1]):
        p = pos[-1]
        c = np.full(len(p), -1)
        has = p > 0
        c[has] = t[p[has] - 1]
        here = t[p].astype(np.int64)
        c[~(has & (sign * c > sign * here) | has & (c == here) & ~held)] = -1
        chars.append(c)
        inside = np.flatnonzero((c >= lo) & (c < hi))
        pos.append(p[inside] - 1)
        source.append(known + inside)
        known += len(p)
        held = np.zeros(len(inside), bool)
    pos, source, chars = np.concatenate(pos), np.concatenate(source), np.concatenate(chars) if chars else np.zeros(0, np.int64)
    n = len(pos)
    if not n:
        return pos, chars, term
    term = np.concatenate([term, np.zeros(n - len(term), bool)])
    c = t[pos].astype(np.int64)
    first = 2 * (c - lo if sign > 0 else hi - 1 - c) + term
    rank = np.concatenate([n + first, np.arange(n)])  # a suffix's own, then the places of those that have no source here
    after = np.concatenate([np.where(source >= 0, source, n + np.arange(n)), n + np.arange(n)])
    key = rank[:n] * (rank.max() + 1) + rank[after[:n]]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    slots = np.arange(n)
    while True:  # a rank is the first place of those that are still alike
        rank[order[slots]] = n + slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        alike = ~new
        alike[:-1] |= ~new[1:]
        slots = slots[alike]
        if not len(slots):
            return pos[order], chars[order], term[order]
        after[:n] = after[after[:n]]
        own = order[slots]
        by = np.lexsort((rank[after[own]], rank[own]))
        own = own[by]
        order[slots] = own
        one, two = rank[own], rank[after[own]]
        new = np.ones(len(own), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])


FEW = 256


def chains(t: np.ndarray, pos: np.ndarray, lcp: np.ndarray | None, c: int, cap: int):
    """Few suffixes that begin with c and are all that their bucket holds: with those that they induce in that same bucket, one after another along runs of c, which
    would else take a turn for every character of a run. -> suffixes in order and their lengths, then those with which the runs go on beyond BLOCK
    items and their lengths; None if no run goes on, or if the runs that they begin with differ, so that they are of different turns."""
    m = len(pos)
    if not (t[np.maximum(pos - 1, 0)][pos > 0] == c).any():
        return None
    for reach in (min(64, BLOCK // m), BLOCK // m):
        at = pos[:, None].astype(np.int64) - 1 - np.arange(reach)
        runs = np.concatenate([(at >= 0) & (t[np.maximum(at, 0)] == c), np.zeros((m, 1), bool)], axis=1).argmin(1)
        if runs.max() < reach:
            break
    more = int(runs.max()) == reach
    turns = np.arange(min(int(runs.max()), reach) + 1)
    alive = runs >= turns[:, None]
    lens = None
    if lcp is not None:
        ahead = pos[:, None].astype(np.int64) + np.arange(cap + 1)
        heading = ((ahead < len(t)) & (np.arange(cap + 1) < cap) & (t[np.minimum(ahead, len(t) - 1)] == c)).argmin(1)
        run = int(heading[0])
        if (heading != run).any():
            return None
        lens, low = np.empty((len(turns), m), np.int64), np.full(len(turns), cap)
        for i in range(m):
            low = np.minimum(low, int(lcp[i]))
            lens[:, i] = low + turns
            low[alive[:, i]] = cap
        heads = alive.argmax(1)
        lens[turns[1:], heads[1:]] = run + turns[1:] - 1
        lens[0] = lcp
        lens = np.minimum(lens, cap).astype(lcp.dtype)
    k, i = np.nonzero(alive)
    every, lens = (pos[i] - k).astype(pos.dtype), None if lens is None else lens[k, i]
    stop = np.searchsorted(k, reach) if more else len(k)
    return every[:stop], None if lens is None else lens[:stop], every[stop:], None if lens is None else lens[stop:]


class Seeds:
    """The LMS suffixes in order, taken from their file as far as a character."""

    def __init__(self, t: np.ndarray, pos: Log, lcp: Log | None):
        self.t, self.pos, self.lcp, self.at = t, pos, lcp, 0
        self.own = self.chars = np.zeros(0, np.int64)
        self.lens = None

    def take(self, stop: int):
        while True:
            if not len(self.own):
                if self.at >= self.pos.n:
                    return
                hi = min(self.pos.n, self.at + BLOCK)
                self.own, self.lens = self.pos.read(self.at, hi), None if self.lcp is None else self.lcp.read(self.at, hi)
                self.chars, self.at = self.t[self.own].astype(np.int64), hi
            k = int(np.searchsorted(self.chars, stop))
            if not k:
                return
            got = self.own[:k], None if self.lens is None else self.lens[:k]
            self.own, self.chars, self.lens = self.own[k:], self.chars[k:], None if self.lens is None else self.lens[k:]
            yield got


def _joined(blocks, kind) -> np.ndarray:
    parts = list(blocks)
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def induce(t: np.ndarray, sigma: int, bounds: list[int], seeds: Log, seed_lcp: Log | None, cap: int, budget: int, folder: str, told: dict, only_lms: bool = False) -> tuple[Log, Log | None]:
    """All suffixes, or only the LMS ones, from the last to the first, and each one's length in common with the next smaller (None without seed_lcp). seeds: the
    LMS suffixes in order. bounds: the first characters of the buckets; with lengths, every bucket is a single character."""
    n, carry, kind = len(t), seed_lcp is not None, seeds.kind
    small = np.dtype(np.uint8 if cap < 256 else np.int64)
    kinds = (kind, small) if carry else (kind,)
    first = np.array(bounds, np.int64)
    stops = np.append(first[1:], sigma)

    def send(queue: Queue, to: np.ndarray, chars: np.ndarray, lens=None) -> None:
        """Suffixes in order, each into the bucket of its character."""
        bucket = (np.searchsorted(first, chars, side="right") - 1).astype(np.min_scalar_type(len(first)))
        order = np.argsort(bucket, kind="stable")
        bucket, to = bucket[order], to[order]
        edge = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)]
        for a, b in zip(edge, edge[1:]):
            if b > a:
                queue.push(int(bucket[a]), to[a:b], *(() if lens is None else (lens[a:b],)))

    def stream(queue: Queue, b: int, c: int):
        """A bucket's blocks of suffixes and lengths, and whether those that they induce in the bucket itself are among them."""
        for pos, *lcp in queue.pop(b):
            lens = lcp[0] if carry else None
            if len(pos) <= FEW and queue.emptied(b) and (got := chains(t, pos, lens, c, cap)):
                yield got[0], got[1], True
                if len(got[2]):
                    queue.push(b, *got[2:] if carry else got[2:3])
            else:
                yield pos, lens, False

    def feed(queue: Queue, state: Feed | None, pos: np.ndarray, lcp, c: int, held: bool, sign: int) -> np.ndarray:
        """What a block of suffixes that begin with c induces (held: but for others that do too); -> the character before each (-1: none)."""
        before = np.full(len(pos), -1)
        has = pos > 0
        before[has] = t[pos[has] - 1]
        at = np.flatnonzero(has & ((sign * before > sign * c) | ((before == c) & (not held))))
        if not len(at):
            if carry:
                state.skip(lcp)
            return before
        at = at[np.argsort(before[at].astype(np.min_scalar_type(sigma)), kind="stable")]
        ch = before[at]
        send(queue, pos[at] - 1, ch, state.lengths(lcp, at, ch) if carry else None)
        return before

    def edge_of(a: int, b: int) -> int:
        """What a larger and a smaller suffix of one character have in common: it, as often as the shorter run has it."""
        run = []
        for p in (a, b):
            own = t[p : p + cap]
            other = np.flatnonzero(own != own[0])
            run.append(int(other[0]) if len(other) else len(own))
        return min(cap, *run)

    larger, state = Queue(folder, kinds, budget), Feed(sigma, cap) if carry else None
    found, found_lcp, marks, reader = Log(folder, kind), Log(folder, small) if carry else None, [], Seeds(t, seeds, seed_lcp)
    end = np.array([n - 1], kind)
    send(larger, end, t[end].astype(np.int64), np.zeros(1, small) if carry else None)
    if carry:
        state.seen[t[n - 1]] = True
        state.since[t[n - 1]] = 0
    tops = {}
    for b, (lo, hi) in enumerate(zip(first.tolist(), stops.tolist())):
        marks.append(found.n)
        if hi - lo > 1:
            pos, ch, term = settle(t, larger.load(b), _joined((p for p, _ in reader.take(hi)), kind), lo, hi, 1)
            found.append(pos[~term])
            out = ch >= hi
            send(larger, pos[out] - 1, ch[out])
            continue
        for pos, lcp, whole in stream(larger, b, lo):
            found.append(pos)
            if carry:
                found_lcp.append(lcp)
                tops[b] = int(pos[-1])
            feed(larger, state, pos, lcp, lo, whole, 1)
        begun = False
        for pos, lcp in reader.take(hi):
            if carry and not begun:
                lcp[0] = edge_of(tops[b], int(pos[0])) if b in tops else 0
                begun = True
            feed(larger, state, pos, lcp, lo, True, 1)
    marks.append(found.n)
    told["spilled"] = told.get("spilled", 0) + larger.spilled
    larger.close()
    smaller, state = Queue(folder, kinds, budget), Feed(sigma, cap) if carry else None
    out, out_lcp = Log(folder, kind), Log(folder, small) if carry else None
    for b in range(len(first) - 1, -1, -1):
        lo, hi, a, z = int(first[b]), int(stops[b]), marks[b], marks[b + 1]
        if hi - lo > 1:
            pos, ch, term = settle(t, smaller.load(b), _joined(found.back(a, z), kind), lo, hi, -1)
            out.append(pos[~term & (pos > 0) & (ch < 0)] if only_lms else pos)
            to = (ch >= 0) & (ch < lo)
            send(smaller, pos[to] - 1, ch[to])
            continue
        last, edge = None, 0
        for pos, lcp, whole in stream(smaller, b, lo):
            before = feed(smaller, state, pos, lcp, lo, whole, -1)
            out.append(pos[before > lo] if only_lms else pos)
            if carry:
                out_lcp.append(lcp if last is not None else lcp[1:])
                last = int(pos[-1])
        if last is not None:
            edge = edge_of(tops[b], last) if z > a else 0
            out_lcp.append(np.array([edge]))
        lens = found_lcp.back(a, z) if carry else None
        for pos in found.back(a, z):
            own = None
            if not only_lms:
                out.append(pos)
            if carry:
                lcp = next(lens)
                out_lcp.append(lcp)
                own = np.concatenate([[edge], lcp[:-1]]).astype(small)
                edge = int(lcp[-1])
            feed(smaller, state, pos, own, lo, True, -1)
    told["spilled"] += smaller.spilled
    smaller.close()
    found.close()
    if carry:
        found_lcp.close()
    return out, out_lcp


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether t[a : a + length] == t[b : b + length], for many at once."""
    ok, left = np.ones(len(a), bool), np.arange(len(a))
    for k in range(int(length.max(initial=0))):
        left = left[length[left] > k]
        equal = t[a[left] + k] == t[b[left] + k]
        ok[left[~equal]] = False
        left = left[equal]
        if not len(left):
            break
    return ok


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """The length that the suffixes at a and b have in common, up to cap, eight bytes at a time. t: bytes without 0 in common, followed by zeros enough."""
    words = np.lib.stride_tricks.as_strided(t, (len(t) - 7, 8), (1, 1))
    out, left = np.full(len(a), cap, np.int64), np.arange(len(a))
    for k in range(0, cap, 8):
        x = np.ascontiguousarray(words[a[left] + k]).view(np.uint64).ravel() ^ np.ascontiguousarray(words[b[left] + k]).view(np.uint64).ravel()
        differ = x != 0
        low = x[differ]
        low = low & (~low + np.uint64(1))
        out[left[differ]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        left = left[~differ]
        if not len(left):
            break
    return np.minimum(out, cap)


def by_character(t: np.ndarray, bounds: list[int], stops: list[int], some: Log, budget: int, folder: str) -> Log:
    """Suffixes in the order of their first characters."""
    queue, out, first = Queue(folder, (some.kind,), budget), Log(folder, some.kind), np.array(bounds, np.int64)
    for pos in some.blocks():
        bucket = (np.searchsorted(first, t[pos], side="right") - 1).astype(np.min_scalar_type(len(first)))
        order = np.argsort(bucket, kind="stable")
        edge = [0, *(np.flatnonzero(bucket[order[1:]] != bucket[order[:-1]]) + 1), len(order)]
        for a, b in zip(edge, edge[1:]):
            queue.push(int(bucket[order[a]]), pos[order[a:b]])
    for b, (lo, hi) in enumerate(zip(bounds, stops)):
        if hi - lo == 1:
            for (pos,) in queue.pop(b):
                out.append(pos)
        else:
            pos = queue.load(b)
            out.append(pos[np.argsort(t[pos], kind="stable")])
    queue.close()
    return out


def named(t: np.ndarray, lms: Log, order: Log, folder: str) -> tuple[str, int]:
    """A file with a number for each LMS suffix in the order of the text, equal for equal pieces up to the next one and rising with them, and how many numbers
    there are. order: the LMS suffixes from the largest piece to the smallest."""
    where, fd_path = lms.map(), tempfile.mkstemp(dir=folder)
    os.close(fd_path[0])
    names = np.memmap(fd_path[1], np.int32, "w+", shape=(lms.n,))
    k, tail, tail_length = -1, np.zeros(0, lms.kind), np.zeros(0, np.int64)
    for pos in order.back():
        at = np.searchsorted(where, pos)
        length = np.where(at < lms.n - 1, where[np.minimum(at + 1, lms.n - 1)].astype(np.int64) - pos + 1, -1)  # the last one runs into the end
        both, lengths = np.concatenate([tail, pos]), np.concatenate([tail_length, length])
        new = np.ones(len(both), bool)
        same = np.flatnonzero((lengths[1:] == lengths[:-1]) & (lengths[1:] > 0)) + 1
        new[same] = ~_same(t, both[same - 1], both[same], lengths[same])
        numbers = k + np.cumsum(new[len(tail) :])
        names[at] = numbers
        k, tail, tail_length = int(numbers[-1]), both[-1:], lengths[-1:]
    names.flush()
    return fd_path[1], k + 1


def lms_order(t: np.ndarray, sigma: int, bounds: list[int], cap: int, level: int, budget: int, folder: str, told: dict) -> Log:
    """The LMS suffixes, as far as the first cap bytes of the text tell, from the last to the first."""
    told["levels"] = max(told.get("levels", 0), level + 1)
    lms = Log(folder, np.int32 if len(t) < 1 << 31 else np.int64)
    for pos in lms_blocks(t):
        lms.append(pos)
    if lms.n < 2:
        return lms
    rough = by_character(t, bounds, [*bounds[1:], sigma], lms, budget, folder)
    order, _ = induce(t, sigma, bounds, rough, None, cap, budget, folder, told, only_lms=True)
    rough.close()
    path, k = named(t, lms, order, folder)
    if k < lms.n and 2 << level < cap:  # two characters at least from one LMS suffix to the next
        order.close()
        inner = suffixes(np.asarray(np.memmap(path, np.int32, "r", shape=(lms.n,))), k, cap, level + 1, budget, folder, told)
        order, where = Log(folder, lms.kind), lms.map()
        for at in inner.blocks():
            order.append(where[at])
        inner.close()
    os.unlink(path)
    lms.close()
    return order


def rising(order: Log, folder: str) -> Log:
    out = Log(folder, order.kind)
    for pos in order.back():
        out.append(pos)
    order.close()
    return out


def suffixes(t: np.ndarray, sigma: int, cap: int, level: int, budget: int, folder: str, told: dict) -> Log:
    """All suffixes of a text of names, from the last to the first."""
    bounds = ranges(t, 0, sigma, max(1, budget // 8))
    seeds = rising(lms_order(t, sigma, bounds, cap, level, budget, folder, told), folder)
    out, _ = induce(t, sigma, bounds, seeds, None, cap, budget, folder, told)
    seeds.close()
    return out


def sorted_suffixes(path: str, n: int, cap: int, folder: str, budget: int = BUDGET, told: dict | None = None):
    """path: a file of n bytes and cap + PAD zeros -> blocks of the suffixes in order, as far as the first cap bytes tell, and of the length each has in
    common with the one before, up to cap. told gets how many levels there were and how many times a bucket went to its file."""
    told = {} if told is None else told
    if not n:
        return
    padded = np.asarray(np.memmap(path, np.uint8, "r", shape=(n + cap + PAD,)))
    t, bounds = padded[:n], list(range(256))
    seeds = rising(lms_order(t, 256, bounds, cap, 0, budget, folder, told), folder)
    lcp, before = Log(folder, np.uint8 if cap < 256 else np.int64), None
    for pos in seeds.blocks():
        a = np.concatenate([pos[:1] if before is None else before, pos[:-1]])
        lcp.append(np.minimum(common(padded, a, pos, cap), n - np.maximum(a, pos)))
        before = pos[-1:]
    out, out_lcp = induce(t, 256, bounds, seeds, lcp, cap, budget, folder, told)
    seeds.close()
    lcp.close()
    yield from zip(out.back(), out_lcp.back())


def suffix_array(t: np.ndarray, cap: int = 200, budget: int = BUDGET, folder: str | None = None, told: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """sorted_suffixes() of bytes in memory, as a whole."""
    with scratch(folder) as own:
        with open(f"{own}/text", "wb") as f:
            f.write(t.tobytes() + bytes(cap + PAD))
        blocks = list(sorted_suffixes(f"{own}/text", len(t), cap, own, budget, told))
    if not blocks:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    return np.concatenate([p for p, _ in blocks]), np.concatenate([x for _, x in blocks])
