"""Suffix order and common prefixes by recursive induced sorting on disk.

Suffixes that begin a rise after a fall are sorted by naming the substrings
between them (an external sort) and, where names repeat, by the order of the
suffixes of the names, recursively.  All other suffixes are induced from these
in two passes.  Suffixes wait in queues by their first symbol, which are a
priority queue since they enter in order; the queues, the runs of the sorts and
all larger arrays are on disk, so a text may be far larger than ``memory``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of queues and sort runs that stay in memory, and of a page on disk.
MEMORY, PAGE = 16 << 20, 1 << 15
#: Rows that are worked on at a time, and how many long substrings are left to
#: be compared whole.
ROWS, FEW = 1 << 16, 256


class Scratch:
    """Pages and arrays, in memory up to a limit and beyond it on disk."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held = memory, 0
        self.file, self.slots, self.free = None, 0, []

    def array(self, n: int, kind) -> np.ndarray:
        """Zeros; an array larger than an eighth of the memory is mapped from a file."""
        size = n * np.dtype(kind).itemsize
        if size <= self.memory // 8:
            return np.zeros(n, kind)
        with tempfile.TemporaryFile() as f:  # the mapping keeps it until it is dropped
            f.truncate(size)
            return np.asarray(np.memmap(f, kind, "r+", shape=(n,)))

    def put(self, data: bytes) -> bytes | tuple[int, int]:
        """Keep a page; what :meth:`take` wants for it."""
        if self.held + len(data) <= self.memory:
            self.held += len(data)
            return data
        self.file = self.file or tempfile.TemporaryFile()
        slot = self.free.pop() if self.free else self.slots
        self.slots = max(self.slots, slot + 1)
        self.file.seek(slot * 2 * PAGE)
        self.file.write(data)
        return slot, len(data)

    def take(self, page: bytes | tuple[int, int]) -> bytes:
        if isinstance(page, bytes):
            self.held -= len(page)
            return page
        self.file.seek(page[0] * 2 * PAGE)
        self.free.append(page[0])
        return self.file.read(page[1])


class Queue:
    """First in, first out: rows of a few columns, in pages."""

    def __init__(self, scratch: Scratch, *kinds):
        self.scratch, self.kinds = scratch, [np.dtype(k) for k in kinds]
        self.rows = PAGE // sum(k.itemsize for k in self.kinds)
        self.pages: list = []
        self.parts: list[tuple] = []
        self.waiting = self.size = 0

    def put(self, *columns: np.ndarray) -> None:
        if not len(columns[0]):
            return
        self.parts.append(columns)
        self.waiting += len(columns[0])
        self.size += len(columns[0])
        if self.waiting >= self.rows:
            columns = self._joined()
            whole = self.waiting - self.waiting % self.rows
            for lo in range(0, whole, self.rows):
                page = b"".join(np.ascontiguousarray(c[lo : lo + self.rows], k).tobytes() for c, k in zip(columns, self.kinds, strict=True))
                self.pages.append(self.scratch.put(page))
            self.parts = [tuple(np.array(c[whole:], k) for c, k in zip(columns, self.kinds, strict=True))]
            self.waiting -= whole

    def _joined(self) -> list[np.ndarray]:
        return [np.concatenate([np.asarray(p[i], k) for p in self.parts]) for i, k in enumerate(self.kinds)]

    def _page(self, page) -> list[np.ndarray]:
        data, out, at = self.scratch.take(page), [], 0
        n = len(data) // sum(k.itemsize for k in self.kinds)
        for k in self.kinds:
            out.append(np.frombuffer(data, k, n, at))
            at += n * k.itemsize
        return out

    def block(self) -> list[np.ndarray] | None:
        """The next rows, about ROWS of them, or None; rows may be put in between."""
        return _some(self, ROWS) if self.size else None

    def blocks(self) -> Iterator[list[np.ndarray]]:
        while (block := self.block()) is not None:
            yield block


def _order(keys: list[np.ndarray], runs: bool = False) -> np.ndarray:
    """The order of rows by one or two keys, equal rows in any order; ``runs``:
    the rows are sorted runs, one behind the other."""
    if len(keys) == 1:
        return np.argsort(keys[0], kind="stable" if runs else None)
    # two ranks fit one number, which sorts faster than two columns
    return np.argsort(_dense(keys[0])[1] << 32 | _dense(keys[1])[1])


def sorted_blocks(scratch: Scratch, blocks: Iterator[list[np.ndarray]], keys: int) -> Iterator[list[np.ndarray]]:
    """External merge sort of rows by their first ``keys`` columns."""
    runs: list[Queue] = []
    held: list[list[np.ndarray]] = []
    size = 0

    def run() -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        o = _order(columns[:keys])
        return [c[o] for c in columns]

    for block in blocks:
        held.append(block)
        size += sum(c.nbytes for c in block)
        if size >= scratch.memory // 4:
            columns, size = run(), 0
            runs.append(Queue(scratch, *(c.dtype for c in columns)))
            runs[-1].put(*columns)
    if not runs:
        if held:
            yield run()
        return
    if held:
        columns = run()
        runs.append(Queue(scratch, *(c.dtype for c in columns)))
        runs[-1].put(*columns)
    # what no run's later rows can precede is ready
    most = max(1, 2 * ROWS // len(runs))
    heads = [_some(q, most) for q in runs]
    while any(len(h[0]) for h in heads):
        lasts = [tuple(int(h[i][-1]) for i in range(keys)) for h, q in zip(heads, runs, strict=True) if len(h[0]) and q.size]
        bound = min(lasts) if lasts else None
        ready = []
        for i, h in enumerate(heads):
            n = len(h[0]) if bound is None else _until(h, bound)
            ready.append([c[:n] for c in h])
            heads[i] = [c[n:] for c in h]
            if not len(heads[i][0]) and runs[i].size:
                heads[i] = _some(runs[i], most)
        columns = [np.concatenate(c) for c in zip(*ready, strict=True)]
        if len(columns[0]):
            o = _order(columns[:keys], runs=True)
            yield [c[o] for c in columns]


def _some(q: Queue, most: int) -> list[np.ndarray]:
    """The next pages of a queue, about ``most`` rows."""
    n = min(len(q.pages), max(1, most // q.rows))
    parts = [q._page(p) for p in q.pages[:n]]
    del q.pages[:n]
    if not q.pages and q.waiting:
        parts.append(q._joined())
        q.parts, q.waiting = [], 0
    out = [np.concatenate(c) for c in zip(*parts, strict=True)]
    q.size -= len(out[0])
    return out


def _until(columns: list[np.ndarray], bound: tuple[int, ...]) -> int:
    """How many sorted rows are not behind ``bound``."""
    lo, hi = 0, len(columns[0])
    for c, b in zip(columns, bound, strict=False):
        part = c[lo:hi]
        b = c.dtype.type(b)
        lo, hi = lo + int(np.searchsorted(part, b, "left")), lo + int(np.searchsorted(part, b, "right"))
    return hi


def _kind(n: int):
    return np.uint32 if n < 1 << 32 else np.int64


def _rising(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is not."""
    n = len(text)
    out = scratch.array(n, bool)
    behind = False
    for lo in range((n - 1) // ROWS * ROWS, -1, -ROWS):
        hi = min(n, lo + ROWS)
        now = np.asarray(text[lo:hi])
        then = np.concatenate([now[1:], text[hi : hi + 1]])
        m = len(then)  # one fewer at the text's end
        same = np.zeros(hi - lo, bool)
        up = np.zeros(hi - lo, bool)
        same[:m], up[:m] = now[:m] == then, now[:m] < then
        # equal neighbours are as the next unequal pair
        at = np.where(same, hi - lo, np.arange(hi - lo))
        at = np.minimum.accumulate(at[::-1])[::-1]
        up = np.append(up, behind)[at]
        out[lo:hi] = up
        behind = bool(up[0])
    return out


def _turns(rising: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Where a rise begins after a fall, in text order."""
    found, n = Queue(scratch, _kind(len(rising))), 0
    for lo in range(0, len(rising), ROWS):
        part = np.asarray(rising[max(0, lo - 1) : lo + ROWS])
        at = np.flatnonzero(part[1:] & ~part[:-1]) + max(0, lo - 1) + 1
        n += len(at)
        found.put(at)
    out, at = scratch.array(n, _kind(len(rising))), 0
    for (block,) in found.blocks():
        out[at : at + len(block)] = block
        at += len(block)
    return out


def _names(text: np.ndarray, rising: np.ndarray, turns: np.ndarray, most: int, scratch: Scratch) -> tuple[np.ndarray, bool]:
    """The rank of the substring from each turn to the next one (both included),
    equal ones having the same, and whether all differ.  ``most`` is the largest
    symbol.  A falling symbol comes before an equal rising one.
    """
    m, n = len(turns), len(text)
    bits = (2 * most + 2).bit_length()
    per = max(1, 63 // bits)
    rank = scratch.array(m, _kind(m))

    def size(j: np.ndarray) -> np.ndarray:
        ends = np.where(j + 1 < m, turns[np.minimum(j + 1, m - 1)].astype(np.int64) + 1, n)
        return ends - turns[j]

    def word(j: np.ndarray, skip: int) -> np.ndarray:
        out, start, own = np.zeros(len(j), np.uint64), turns[j].astype(np.int64), size(j)
        for i in range(skip, skip + per):
            at = np.minimum(start + i, n - 1)
            code = 2 * text[at].astype(np.uint64) + rising[at] + 1
            out = (out << np.uint64(bits)) | np.where(i < own, code, np.uint64(0))
        return out

    def first() -> Iterator[list[np.ndarray]]:
        for lo in range(0, m, ROWS):
            j = np.arange(lo, min(m, lo + ROWS))
            yield [word(j, 0), j]

    rest, at, last, head = Queue(scratch, np.int64), 0, None, 0
    for words, j in sorted_blocks(scratch, first(), 1):
        new = np.concatenate([[words[0] != last], words[1:] != words[:-1]])
        heads = np.maximum.accumulate(np.where(new, np.arange(at, at + len(j)), head))
        rank[j] = heads
        at, last, head = at + len(j), words[-1], int(heads[-1])
        rest.put(j[size(j) > per])
    skip = per
    while rest.size:
        now, rest = rest, Queue(scratch, np.int64)

        def more(now=now, skip=skip) -> Iterator[list[np.ndarray]]:
            for (j,) in now.blocks():
                yield [rank[j].astype(np.int64), word(j, skip), j]

        if now.size <= FEW:
            few = np.concatenate([j for (j,) in now.blocks()])
            if int((size(few) - skip).sum()) * 8 <= scratch.memory:
                _finish(text, rising, turns, rank, few, skip)
                break
            now.put(few)
        at, last, begun, head = 0, None, 0, 0
        for group, words, j in sorted_blocks(scratch, more(), 2):
            here = np.arange(at, at + len(j))
            other = np.concatenate([[last is None or group[0] != last[0]], group[1:] != group[:-1]])
            new = other | np.concatenate([[last is None or words[0] != last[1]], words[1:] != words[:-1]])
            starts = np.maximum.accumulate(np.where(other, here, begun))
            heads = np.maximum.accumulate(np.where(new, here, head))
            rank[j] = group + heads - starts
            at, last, begun, head = at + len(j), (group[-1], words[-1]), int(starts[-1]), int(heads[-1])
            rest.put(j[size(j) > skip + per])
        skip += per
    seen = scratch.array(m, bool)
    for lo in range(0, m, ROWS):
        seen[rank[lo : lo + ROWS]] = True
    return rank, all(bool(seen[lo : lo + ROWS].all()) for lo in range(0, m, ROWS))


def _finish(text, rising, turns, rank, few: np.ndarray, skip: int) -> None:
    """Refine the ranks of the few substrings that go on, by all that is left of them."""
    groups: dict[int, list[tuple[bytes, int]]] = {}
    n, m = len(text), len(turns)
    for j in few.tolist():
        lo, hi = int(turns[j]) + skip, int(turns[j + 1]) + 1 if j + 1 < m else n
        code = 2 * text[lo:hi].astype(np.uint64) + rising[lo:hi] + 1
        groups.setdefault(int(rank[j]), []).append((code.astype(">u8").tobytes(), j))
    for group, own in groups.items():
        own.sort()
        head, last = 0, None
        for i, (code, j) in enumerate(own):
            head, last = (head, last) if code == last else (i, code)
            rank[j] = group + head


def sorted_turns(text: np.ndarray, rising: np.ndarray, most: int, scratch: Scratch) -> np.ndarray:
    """The suffixes at which a rise begins, in order: by their names, and by the
    order of the names' suffixes where these repeat."""
    turns = _turns(rising, scratch)
    m = len(turns)
    out = scratch.array(m, turns.dtype)
    if not m:
        return out
    rank, differ = _names(text, rising, turns, most, scratch)
    order = None if differ else suffix_array(rank, m - 1, scratch)
    for lo in range(0, m, ROWS):
        if differ:
            out[rank[lo : lo + ROWS]] = turns[lo : lo + ROWS]
        else:
            out[lo : lo + ROWS] = turns[order[lo : lo + ROWS]]
    return out


def _ranges(text: np.ndarray, most: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's range, and how many suffixes each range has: ROWS at most,
    or more where they are of one symbol."""
    counts, range_of = scratch.array(most + 1, np.int64), scratch.array(most + 1, np.int32)
    for lo in range(0, len(text), ROWS):
        np.add.at(counts, text[lo : lo + ROWS].astype(np.int64), 1)
    totals, held = [], ROWS + 1
    for lo in range(0, most + 1, ROWS):
        part, at = np.asarray(counts[lo : lo + ROWS]), 0
        ends = np.cumsum(part)
        while at < len(part):
            before = int(ends[at - 1]) if at else 0
            upto = int(np.searchsorted(ends, before + ROWS - held, "right"))
            if upto <= at:  # the next symbol opens a range
                totals.append(0)
                held = 0
                upto = max(at + 1, int(np.searchsorted(ends, before + ROWS, "right")))
            range_of[lo + at : lo + upto] = len(totals) - 1
            held += int(ends[upto - 1]) - before
            totals[-1] = held
            at = upto
    return range_of, np.array(totals, np.int64)


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of keys, their ranks (equal ones alike), and how many differ."""
    order = np.argsort(key)
    now = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = steps = np.cumsum(np.concatenate([[0], now[1:] != now[:-1]]))
    return order, rank, int(steps[-1]) + 1


class _Pass:
    """One pass over the ranges of symbols: falling suffixes upwards, or rising
    ones downwards.  What a visited suffix induces waits in the queue of its
    range; what it induces in its own range is ordered with the rest of it."""

    def __init__(self, text, rising, range_of, totals, wanted: bool, scratch: Scratch):
        self.text, self.rising, self.range_of, self.totals, self.wanted, self.scratch = text, rising, range_of, totals, wanted, scratch
        self.kind, self.queues = _kind(len(text)), {}

    def put(self, of: int, at: np.ndarray) -> None:
        self.queues.setdefault(of, Queue(self.scratch, self.kind)).put(at)

    def induced(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The wanted predecessors of suffixes, their ranges, and whose they are."""
        own = np.flatnonzero(at > 0)
        before = at[own].astype(np.int64) - 1
        ok = self.rising[before] == self.wanted
        before = before[ok]
        return before, self.range_of[self.text[before].astype(np.int64)], own[ok]

    def push(self, of: int, at: np.ndarray, itself: bool = False) -> None:
        before, to, _ = self.induced(at)
        if not itself:
            before, to = before[to != of], to[to != of]
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        before, to = before[order], to[order]
        cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.put(int(to[lo]), before[lo:hi])

    def visit(self, of: int, others: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The range's suffixes in order (backwards in the downward pass), and
        whether each was induced; ``others`` are the known ones of the other type."""
        if self.totals[of] <= ROWS:
            waiting = self.queues.pop(of, None)
            first = [b[0] for b in waiting.blocks()] if waiting else []
            at, own = self._ranked(of, *(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (first, list(others))))
            self.push(of, at)
            yield at, own
            return
        # one symbol: what a suffix induces in its own range comes behind what waits there
        self.put(of, np.empty(0, self.kind))
        while (block := self.queues[of].block()) is not None:
            self.push(of, block[0], itself=True)
            yield block[0], np.ones(len(block[0]), bool)
        for at in others:  # these induce other symbols only
            self.push(of, at)
            yield at, np.zeros(len(at), bool)

    def _ranked(self, of: int, first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([first, rest])
        if not len(at):
            return at, np.empty(0, bool)
        known, parts, parents, base, now = len(at), [at], [np.arange(len(at))], 0, at
        while len(now):
            before, to, whose = self.induced(now)
            inside = to == of
            parents.append(whose[inside] + base)
            base += len(now)
            now = before[inside]
            parts.append(now)
        at, up = np.concatenate(parts), np.concatenate(parents)
        # of one symbol: those induced from other ranges, from this one, and the known ones
        turn = np.concatenate([np.arange(len(first)), np.arange(known, len(at)), np.arange(len(first), known)])
        back = np.empty(len(at), np.int64)
        back[turn] = np.arange(len(at))
        at, up = at[turn], back[up[turn]]
        inner = np.zeros(len(at), bool)
        inner[len(first) : len(at) - len(rest)] = True
        symbol = self.text[at].astype(np.int64)
        symbol = symbol.max() - symbol if self.wanted else symbol - symbol.min()
        order = _radix(symbol)
        now, mixed = symbol[order], inner[order]
        alike = (now[1:] == now[:-1]) & mixed[1:] & mixed[:-1]
        rank = np.empty(len(at), np.int64)
        while True:
            rank[order] = steps = np.cumsum(np.concatenate([[0], ~alike]))
            if steps[-1] == len(at) - 1:
                break
            then = rank[up]  # alike so far: as what induced them, and so on
            order = _radix(then)
            order = order[_radix(rank[order])]
            alike = (rank[order][1:] == rank[order][:-1]) & (then[order][1:] == then[order][:-1])
            up = up[up]
        own = np.ones(len(at), bool)
        own[len(at) - len(rest) :] = False
        return at[order], own[order]


def _radix(key: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on, by 16 bits at a time."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    top = int(key.max()) >> 16
    while top:
        key = key >> 16
        order = order[np.argsort((key & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        top >>= 16
    return order


def suffix_array(text: np.ndarray, most: int, scratch: Scratch) -> np.ndarray:
    """The suffixes of a sequence of numbers up to ``most``, in order; a suffix
    comes before those that it begins."""
    n, kind = len(text), _kind(len(text))
    order = scratch.array(n, kind)
    if n < 2:
        return order
    rising = _rising(text, scratch)
    turns = sorted_turns(text, rising, most, scratch)
    range_of, totals = _ranges(text, most, scratch)
    seeds = np.zeros(len(totals) + 1, np.int64)
    for lo in range(0, len(turns), ROWS):
        seeds[1:] += np.bincount(range_of[text[turns[lo : lo + ROWS]].astype(np.int64)], minlength=len(totals))
    seeds = np.cumsum(seeds)

    def parts(of: np.ndarray, lo: int, hi: int) -> Iterator[np.ndarray]:
        return (np.asarray(of[i : min(i + ROWS, hi)]) for i in range(lo, hi, ROWS))

    fallen, at = scratch.array(n, kind), 0
    bounds = np.zeros(len(totals) + 1, np.int64)
    upward = _Pass(text, rising, range_of, totals, False, scratch)
    upward.put(int(range_of[int(text[n - 1])]), np.array([n - 1], kind))  # nothing is behind it
    for r in range(len(totals)):
        for block, own in upward.visit(r, parts(turns, int(seeds[r]), int(seeds[r + 1]))):
            block = block[own]
            fallen[at : at + len(block)] = block
            at += len(block)
        bounds[r + 1] = at
    at = n
    downward = _Pass(text, rising, range_of, totals, True, scratch)
    for r in range(len(totals) - 1, -1, -1):
        lo, hi = int(bounds[r]), int(bounds[r + 1])
        backwards = (np.asarray(fallen[max(lo, i - ROWS) : i])[::-1] for i in range(hi, lo, -ROWS))
        for block, _ in downward.visit(r, backwards):
            order[at - len(block) : at] = block[::-1]
            at -= len(block)
    return order


class _Induction:
    """One pass over bytes: suffixes are visited in order and put their wanted
    predecessors into the queue of their byte, each with the prefix that it
    shares with the entry before it: one more than the least common prefix
    visited since."""

    def __init__(self, text: np.ndarray, rising: np.ndarray, wanted: bool, depth: int, scratch: Scratch):
        self.text, self.rising, self.wanted, self.depth = text, rising, wanted, depth
        self.queues = [Queue(scratch, _kind(len(text)), np.uint8) for _ in range(256)]
        self.since = np.zeros(256, np.uint8)  # least common prefix since the byte's last entry

    def visit(self, at: np.ndarray, lcp: np.ndarray) -> None:
        ok = np.flatnonzero(at > 0)
        before = at[ok].astype(np.int64) - 1
        mine = self.rising[before] == self.wanted
        ok, before = ok[mine], before[mine]
        into = self.text[before]
        order = np.argsort(into, kind="stable")
        ok, into, before = ok[order], into[order], before[order]
        tails = np.minimum.accumulate(lcp[::-1])[::-1]
        if not len(ok):
            self.since = np.minimum(self.since, tails[0])
            return
        same = np.concatenate([[False], into[1:] == into[:-1]])
        cuts = np.append(np.flatnonzero(~same), len(ok))
        first = cuts[:-1]
        shared = np.empty(len(ok), np.uint8)
        shared[same] = _least_between(lcp, ok[:-1][same[1:]] + 1, ok[same])
        heads = np.minimum.accumulate(lcp)
        shared[first] = np.minimum(self.since[into[first]], heads[ok[first]])
        shared = np.minimum(shared, self.depth - 1) + np.uint8(1)
        self.since = np.minimum(self.since, tails[0])
        last = ok[cuts[1:] - 1]
        self.since[into[first]] = np.where(last + 1 < len(lcp), tails[np.minimum(last + 1, len(lcp) - 1)], self.depth)
        for lo, hi in zip(first.tolist(), cuts[1:].tolist(), strict=True):
            self.queues[into[lo]].put(before[lo:hi], shared[lo:hi])


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi] (both inclusive) for many ranges."""
    if not len(lo):
        return np.empty(0, values.dtype)
    level = np.frexp(hi - lo + 1)[1] - 1  # the largest power of two within the range
    out, table = np.empty(len(lo), values.dtype), values
    for k in range(int(level.max()) + 1):
        if k:
            step = 1 << (k - 1)
            table = np.minimum(table[:-step], table[step:])
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << k) + 1])
    return out


def _common(padded: np.ndarray, n: int, a: int, b: int, depth: int) -> int:
    most = min(depth, n - a, n - b)
    differ = np.flatnonzero(padded[a : a + most] != padded[b : b + most])
    return int(differ[0]) if len(differ) else most


def suffix_order(padded: np.ndarray, n: int, depth: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of a text's suffixes, the largest first, each with the prefix, up to
    ``depth`` bytes (255 at most), that it shares with the one before it.

    ``padded`` holds the n bytes of text and at least ``depth`` more.
    """
    if not n:
        return
    text, kind = padded[:n], _kind(n)
    rising = _rising(text, scratch)
    turns = sorted_turns(text, rising, 255, scratch)
    # what neighbours among the turns share
    shared, seeds = scratch.array(len(turns), np.uint8), np.zeros(257, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    for lo in range(0, len(turns), ROWS):
        at = turns[max(0, lo - 1) : lo + ROWS].astype(np.int64)
        seeds[1:] += np.bincount(text[at[min(lo, 1) :]], minlength=256)
        x = windows[at]
        differ = x[1:] != x[:-1]
        alike = np.where(differ.any(1), differ.argmax(1), depth)
        left = np.minimum(n - at, depth)
        alike = np.minimum(alike, np.minimum(left[1:], left[:-1])).astype(np.uint8)
        shared[max(lo, 1) : lo + len(alike) + (lo == 0)] = alike
    seeds = np.cumsum(seeds)

    fallen, fell, size, bounds = scratch.array(n, kind), scratch.array(n, np.uint8), 0, np.zeros(257, np.int64)
    upward = _Induction(text, rising, False, depth, scratch)
    upward.queues[int(text[-1])].put(np.array([n - 1], kind), np.zeros(1, np.uint8))  # nothing is behind it
    for byte in range(256):
        prev = -1
        while (block := upward.queues[byte].block()) is not None:
            at, lcp = block
            lcp = lcp.copy()
            if prev < 0:
                lcp[0] = 0
            fallen[size : size + len(at)], fell[size : size + len(at)] = at, lcp
            size += len(at)
            upward.visit(at, lcp)
            prev = int(at[-1])
        bounds[byte + 1] = size
        for lo in range(int(seeds[byte]), int(seeds[byte + 1]), ROWS):
            hi = min(lo + ROWS, int(seeds[byte + 1]))
            at, lcp = np.asarray(turns[lo:hi]), np.array(shared[lo:hi])
            if lo == seeds[byte]:
                lcp[0] = _common(padded, n, prev, int(at[0]), depth) if prev >= 0 else 0
            upward.visit(at, lcp)

    downward = _Induction(text, rising, True, depth, scratch)
    for byte in range(255, -1, -1):
        prev = -1
        while (block := downward.queues[byte].block()) is not None:
            at, lcp = block
            lcp = lcp.copy()
            if prev < 0:
                lcp[0] = 0
            yield at, lcp
            downward.visit(at, lcp)
            prev = int(at[-1])
        lo, end = int(bounds[byte]), int(bounds[byte + 1])
        for hi in range(end, lo, -ROWS):
            from_ = max(lo, hi - ROWS)
            at = np.asarray(fallen[from_:hi])[::-1]
            lcp = np.empty(len(at), np.uint8)
            lcp[1:] = fell[from_ + 1 : hi][::-1]
            lcp[0] = fell[hi] if hi < end else _common(padded, n, prev, int(at[0]), depth) if prev >= 0 else 0
            yield at, lcp
            downward.visit(at, lcp)
