"""External induced sorting of suffixes with their longest common prefixes.

Suffixes are typed S or L by whether the next suffix is greater or smaller; the S suffixes right behind
an L suffix are *stars*.  A pass draws tuples (suffix, common prefix with the tuple before it) from a
disk-backed queue in order of their first symbol, and each puts the suffix one place to the left into
the queue, with the least common prefix since that symbol's last tuple plus one.  A rising pass from the
stars induces the L suffixes, a falling pass from those the S suffixes.

Two rounds of passes make a sort.  The first starts from unsorted stars: what it gives are the sorted
substrings between stars, and carried prefixes as long as two substrings tell that they are equal, so
they get one name.  The names form a shorter text that is sorted by recursion (by doubling as soon as
it fits in memory); its order and common prefixes seed the second round, which streams all suffixes, the
greatest first, to the caller.

No step holds more than a few parts of ``memory`` tuples: queues write what exceeds it to files, arrays
that are longer are files, and the text is read in parts.
"""

from __future__ import annotations

import shutil
import tempfile
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np

#: Tuples that a queue keeps in memory, and items from which on an array is a file.
MEMORY = 4_000_000
#: A common prefix that is known to be as long as anyone asks.
LONG = 1 << 30
Sink = Callable[[np.ndarray, np.ndarray], None]


class Workspace:
    """A private folder of one sort; it goes when the sort ends, however it ends.

    Files here are a task's scratch space, as Spark's own spills are: a lost task starts its sort anew.
    """

    def __init__(self, memory: int = MEMORY):
        self.memory, self.spills = memory, 0
        self.folder: Path | None = None
        self._files = 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)

    def file(self) -> Path:
        if self.folder is None:
            self.folder = Path(tempfile.mkdtemp(prefix="suffixes-"))
        self._files += 1
        return self.folder / f"{self._files}"

    def array(self, n: int, kind=np.int32) -> np.ndarray:
        """Zeros, in a file if there are many."""
        if n <= self.memory:
            return np.zeros(n, kind)
        return np.memmap(self.file(), kind, "w+", shape=(n,))


class TupleQueue:
    """Tuples (suffix, common prefix) by symbol, first in first out, in files beyond ``memory`` tuples."""

    def __init__(self, space: Workspace, kind):
        self.space, self.kind, self.size = space, np.dtype([("s", kind), ("p", np.int32)]), 0
        self.lists: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.extents: dict[int, deque[tuple[Path, int, int]]] = defaultdict(deque)

    def push(self, symbol: int, suffix: np.ndarray, prefix: np.ndarray) -> None:
        self.lists[symbol].append((suffix, prefix))
        self.size += len(suffix)
        if self.size > self.space.memory:
            self._spill()

    def push_groups(self, symbols: np.ndarray, starts: np.ndarray, suffix: np.ndarray, prefix: np.ndarray) -> None:
        """Groups of tuples laid end to end, each with its symbol."""
        ends = [*starts[1:].tolist(), len(suffix)]
        for symbol, a, b in zip(symbols.tolist(), starts.tolist(), ends, strict=True):
            self.lists[symbol].append((suffix[a:b], prefix[a:b]))
        self.size += len(suffix)
        if self.size > self.space.memory:
            self._spill()

    def _spill(self) -> None:
        path, at = self.space.file(), 0
        self.space.spills += 1
        with open(path, "wb") as out:
            for symbol, parts in self.lists.items():
                rows = np.empty(sum(len(s) for s, _ in parts), self.kind)
                rows["s"], rows["p"] = np.concatenate([s for s, _ in parts]), np.concatenate([p for _, p in parts])
                rows.tofile(out)
                self.extents[symbol].append((path, at, len(rows)))
                at += len(rows)
        self.lists.clear()
        self.size = 0

    def _read(self, path: Path, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.fromfile(path, self.kind, n, offset=at * self.kind.itemsize)
        return rows["s"].copy(), rows["p"].copy()

    def has(self, symbol: int) -> bool:
        return bool(self.extents.get(symbol)) or symbol in self.lists

    def _listed(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        parts = self.lists.pop(symbol)
        self.size -= sum(len(s) for s, _ in parts)
        return np.concatenate([s for s, _ in parts]), np.concatenate([p for _, p in parts])

    def parts(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The symbol's tuples in order, with those that come while they are read."""
        while self.has(symbol):
            if self.extents.get(symbol):
                yield self._read(*self.extents[symbol].popleft())
            else:
                yield self._listed(symbol)

    def parts_back(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same parts from the last one on, each in order."""
        if symbol in self.lists:
            yield self._listed(symbol)
        while self.extents.get(symbol):
            yield self._read(*self.extents[symbol].pop())


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low : high + 1]) for each pair, low <= high, by a sparse table."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    order = np.argsort(level.astype(np.uint8), kind="stable")
    edges = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    out, row = np.empty(len(low), values.dtype), values
    for k in range(len(edges) - 1):
        here = order[edges[k] : edges[k + 1]]
        if len(here):
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << k) + 1])
        if k + 2 < len(edges):
            row = np.minimum(row[: -(1 << k)], row[1 << k :])
    return out


class _Induction:
    """The passes over one text.  In a *naming* round stars count as equal when their symbols are."""

    def __init__(self, text: np.ndarray, symbols: list[int], space: Workspace, naming: bool):
        self.text, self.symbols, self.space, self.naming = text, symbols, space, naming
        self.kind = np.int32 if len(text) < 2**31 - 1 else np.int64
        top = (symbols[-1] if symbols else 0) + 1
        self.seen, self.tail = np.full(top, -1, np.int64), np.zeros(top, np.int32)
        self.chunks = 0

    def _bucket(self) -> None:
        self.first_chunk, self.between = self.chunks, np.zeros(0, np.int32)

    def _induce(self, symbol: int, suffix: np.ndarray, prefix: np.ndarray, equal: bool) -> None:
        """Put what is one place to the left into the queue; ``equal`` lets the same symbol pass."""
        before = suffix - 1
        target = self.text[before]
        if self.rising:
            ok = target >= symbol if equal else target > symbol
        else:
            ok = target <= symbol if equal else target < symbol
        at = np.flatnonzero(ok & (suffix > 0))
        if len(at):
            to = target[at]
            order = np.argsort(to, kind="stable")
            at, to = at[order], to[order]
            new = np.append(True, to[1:] != to[:-1])
            head, inner = np.flatnonzero(new), np.flatnonzero(~new)
            common = np.empty(len(at), np.int32)
            if len(inner):
                common[inner] = least_between(prefix, at[inner - 1] + 1, at[inner])
            # The first tuple of a symbol here: the least prefix since its last one, 0 from another bucket.
            own = to[head]
            chunk = self.seen[own] - self.first_chunk
            carried = np.zeros(len(head), np.int32)
            known = chunk >= 0
            carried[known] = np.minimum(self.tail[own[known]], self.between[chunk[known]])
            common[head] = np.minimum(carried, np.minimum.accumulate(prefix)[at[head]])
            after = np.append(np.minimum.accumulate(prefix[:0:-1])[::-1], np.int32(LONG))
            self.tail[own] = after[at[np.append(head[1:], len(at)) - 1]]
            self.seen[own] = self.chunks
            self.queue.push_groups(own, head, before[at], common + np.int32(1))
        self.between = np.append(np.minimum(self.between, prefix.min()), np.int32(LONG))
        self.chunks += 1

    def rise(self, stars: TupleQueue) -> TupleQueue:
        """The L suffixes, by symbol in order."""
        self.rising, self.queue = True, TupleQueue(self.space, self.kind)
        large = TupleQueue(self.space, self.kind)
        n = len(self.text)
        self.queue.push(int(self.text[n - 1]), np.array([n - 1], self.kind), np.zeros(1, np.int32))
        for symbol in self.symbols:
            last = -1
            self._bucket()
            for suffix, prefix in self.queue.parts(symbol):
                if last < 0:
                    prefix[0] = 0
                last = int(suffix[-1])
                large.push(symbol, suffix, prefix)
                self._induce(symbol, suffix, prefix, True)
            border = True
            for suffix, prefix in stars.parts(symbol):
                if border:
                    prefix[0], border = self._border(last, int(suffix[0])), False
                self._induce(symbol, suffix, prefix, False)
        return large

    def fall(self, large: TupleQueue, sink: Sink) -> None:
        """All suffixes, the greatest first, each with its common prefix with the one before it."""
        self.rising, self.queue = False, TupleQueue(self.space, self.kind)
        self.seen[:] = -1
        for symbol in reversed(self.symbols):
            last = -1
            self._bucket()
            for suffix, prefix in self.queue.parts(symbol):
                if last < 0:
                    prefix[0] = 0
                last = int(suffix[-1])
                sink(suffix, prefix)
                self._induce(symbol, suffix, prefix, True)
            link = None
            for suffix, prefix in large.parts_back(symbol):
                if link is None:
                    link = self._border(last, int(suffix[-1]))
                turned = np.append(np.int32(link), prefix[:0:-1])
                link = int(prefix[0])
                sink(suffix[::-1], turned)
                self._induce(symbol, suffix[::-1], turned, False)

    def _border(self, last: int, first: int) -> int:
        """What an L suffix and an S suffix of one symbol have in common; ``last`` is -1 if there is none."""
        if last < 0:
            return 0
        if self.naming:
            return 1
        return int(common_prefixes(self.text, np.array([last]), np.array([first]))[0])


def common_prefixes(text: np.ndarray, x: np.ndarray, y: np.ndarray, most: int = LONG) -> np.ndarray:
    """Symbols that the suffixes at ``x`` and ``y`` have in common."""
    n, depth = len(text), 0
    out, live = np.zeros(len(x), np.int32), np.arange(len(x))
    x, y = x.astype(np.int64), y.astype(np.int64)
    while len(live) and depth < most:
        ok = np.flatnonzero(np.maximum(x, y) < n)
        ok = ok[text[x[ok]] == text[y[ok]]]
        live, x, y = live[ok], x[ok] + 1, y[ok] + 1
        out[live] += 1
        depth += 1
    return out


def find_stars(text: np.ndarray, space: Workspace) -> np.ndarray:
    """The positions of the stars, read from the end in parts."""
    n, found = len(text), []
    right, right_s, end = -1, False, n  # what follows the part: its symbol, and whether it is of type S
    path, count = space.file() if n > space.memory else None, 0
    kind = np.int32 if n < 2**31 - 1 else np.int64
    while end:
        begin = max(0, end - space.memory)
        part = np.asarray(text[begin:end]).astype(np.int64)
        ahead = np.append(part[1:], right)
        # Where a symbol repeats, the end of its run decides.
        place = np.arange(len(part))
        stop = np.minimum.accumulate(np.where(part != ahead, place, len(part))[::-1])[::-1]
        inside = stop < len(part)
        is_s = np.full(len(part), right_s)
        is_s[inside] = ahead[stop[inside]] > part[stop[inside]]
        before = np.append(int(text[begin - 1]) if begin else -1, part[:-1])
        stars = np.flatnonzero(is_s & (before > part)) + begin
        count += len(stars)
        if path is None:
            found.append(stars)
        else:
            with open(path, "ab") as out:
                stars[::-1].astype(kind).tofile(out)
        right, right_s, end = int(part[0]), bool(is_s[0]), begin
    if path is None:
        return np.concatenate(found).astype(kind)
    return np.memmap(path, kind, "r", shape=(count,))[::-1] if count else np.zeros(0, kind)


def _blocks(n: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


class _Namer:
    """Takes a naming round's suffixes, the greatest first, and numbers the stars by their substrings."""

    def __init__(self, text: np.ndarray, stars: np.ndarray, space: Workspace):
        self.text, self.at = text, space.array(len(text) // 2 + 1)
        # Stars are two places apart at least, so half a position names one.
        self.size = space.array(len(text) // 2 + 1)
        for a, b in _blocks(len(stars), space.memory):
            ends = np.asarray(stars[a + 1 : b + 1])
            ends = np.append(ends, len(text)) if b == len(stars) else ends
            self.size[stars[a:b] >> 1] = ends - stars[a:b] + 1
        self.count, self.since, self.last_size = 0, LONG, -1

    def __call__(self, suffix: np.ndarray, prefix: np.ndarray) -> None:
        before = np.where(suffix > 0, self.text[suffix - 1], 0)
        # A suffix with a greater symbol before it is a star if it is of type S; L suffixes that look
        # alike have no size.
        where = np.flatnonzero((suffix > 0) & (before > self.text[suffix]))
        where = where[self._is_star(suffix[where])]
        if not len(where):
            self.since = min(self.since, int(prefix.min()))
            return
        size = self.size[suffix[where] >> 1]
        common = np.minimum.reduceat(prefix[: where[-1] + 1], np.append(0, where[:-1] + 1))
        common[0] = min(int(common[0]), self.since)
        ahead = np.append(self.last_size, size[:-1])
        fresh = (size != ahead) | (common < size)
        number = self.count + np.cumsum(fresh)
        self.at[suffix[where] >> 1] = number
        self.count, self.last_size = int(number[-1]), int(size[-1])
        rest = prefix[where[-1] + 1 :]
        self.since = int(rest.min()) if len(rest) else LONG

    def _is_star(self, suffix: np.ndarray) -> np.ndarray:
        # Of type S: the next different symbol is greater.
        here, ahead = self.text[suffix], suffix.astype(np.int64) + 1
        out, live = np.zeros(len(suffix), bool), np.arange(len(suffix))
        n = len(self.text)
        while len(live):
            inside = ahead[live] < n
            live = live[inside]
            follows = self.text[ahead[live]]
            out[live[follows > here[live]]] = True
            live = live[follows == here[live]]
            ahead[live] += 1
        return out

    def names(self, stars: np.ndarray, space: Workspace) -> np.ndarray:
        """The stars' names from 0 in text order; the smallest substring has the smallest name."""
        out = space.array(len(stars))
        for a, b in _blocks(len(stars), space.memory):
            out[a:b] = self.count - self.at[stars[a:b] >> 1]
        return out


def sort_in_memory(names: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a short text by doubling, and common prefixes; equal for ``deep`` names counts as LONG."""
    n = len(names)
    ranks, width = [names.astype(np.int64)], 1
    while True:
        rank = ranks[-1]
        behind = np.zeros(n, np.int64)
        if width < n:
            behind[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        rise = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = rise
        ranks.append(rank)
        width *= 2
        if width >= deep or rise[-1] == n - 1:
            break
    shared = np.zeros(n, np.int32)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int32)
    for level in range(len(ranks) - 1, -1, -1):
        rank = np.append(ranks[level], -1)
        x, y = np.minimum(a, n), np.minimum(b, n)
        same = (x < n) & (y < n) & (rank[x] == rank[y])
        # Ranks past the end of the text differ, since nothing else ends there.
        step = np.where(same, 1 << level, 0).astype(np.int32)
        common += step
        a, b = a + step, b + step
    shared[1:] = np.where(common >= deep, LONG, common)
    return order.astype(np.int32 if n < 2**31 - 1 else np.int64), shared


def _sort_names(names: np.ndarray, distinct: int, space: Workspace, deep: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(names)
    if distinct == n or n == 1:
        order = space.array(n)
        for a, b in _blocks(n, space.memory):
            order[names[a:b]] = np.arange(a, b)
        return order, space.array(n)
    if n <= space.memory:
        return sort_in_memory(names, deep)
    order, shared, at = space.array(n), space.array(n), [n]

    def keep(suffix: np.ndarray, prefix: np.ndarray) -> None:
        # A prefix belongs to the greater of two suffixes, the one that came before.
        end = at[0]
        order[end - len(suffix) : end] = suffix[::-1]
        if end < n:
            shared[end] = prefix[0]
        shared[end - len(suffix) + 1 : end] = prefix[:0:-1]
        at[0] = end - len(suffix)

    sort_suffixes(names, space, keep, deep)
    return order, shared


def sort_suffixes(text: np.ndarray, space: Workspace, sink: Sink, deep: int = LONG) -> None:
    """Send all suffixes, the greatest first, to ``sink(suffixes, common prefixes with the one before)``.

    The end of the text is smaller than every symbol.  Suffixes with ``deep`` symbols in common may come
    in any order, and their common prefix may be given as more.
    """
    n = len(text)
    symbols = sorted(set().union(*(np.unique(text[a:b]).tolist() for a, b in _blocks(n, space.memory))))
    stars = find_stars(text, space)
    seeds = TupleQueue(space, np.int32 if n < 2**31 - 1 else np.int64)
    if len(stars):
        for a, b in _blocks(len(stars), space.memory):
            _deal(text, seeds, np.asarray(stars[a:b]), np.ones(b - a, np.int32))
        naming = _Induction(text, symbols, space, True)
        namer = _Namer(text, stars, space)
        naming.fall(naming.rise(seeds), namer)
        names = namer.names(stars, space)
        order, shared = _sort_names(names, namer.count, space, deep)
        for a, b in _blocks(len(order), space.memory):
            here = np.asarray(order[a:b]).astype(np.int64)
            ahead = np.append(order[a - 1] if a else here[0], here[:-1]).astype(np.int64)
            _deal(text, seeds, np.asarray(stars[here]), _in_symbols(text, stars, ahead, here, np.asarray(shared[a:b]), a == 0))
    final = _Induction(text, symbols, space, False)
    final.fall(final.rise(seeds), sink)


def _deal(text: np.ndarray, queue: TupleQueue, suffix: np.ndarray, prefix: np.ndarray) -> None:
    to = text[suffix]
    order = np.argsort(to, kind="stable")
    to = to[order]
    head = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    queue.push_groups(to[head], head, suffix[order], prefix[order])


def _in_symbols(text: np.ndarray, stars: np.ndarray, ahead: np.ndarray, here: np.ndarray, shared: np.ndarray, first: bool) -> np.ndarray:
    """Common prefixes of stars that follow each other, from those of their names: equal names, then symbols."""
    ends = len(stars)
    known = shared < LONG
    known[0] &= not first
    k = np.where(known, shared, 0).astype(np.int64)
    place = lambda i: np.where(i < ends, stars[np.minimum(i, ends - 1)], len(text)).astype(np.int64)
    base = place(here + k) - place(here)
    out = base + common_prefixes(text, np.where(known, place(ahead + k), len(text)), place(here + k))
    out = np.where(known, out, LONG).astype(np.int32)
    if first:
        out[0] = 0
    return out


def sorted_suffixes(text: np.ndarray, space: Workspace, deep: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """The whole suffix array in rising order with common prefixes, for short texts and tests."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    sort_suffixes(text, space, lambda s, p: parts.append((s.copy(), p.copy())), deep)
    suffix, prefix = np.concatenate([s for s, _ in parts]), np.concatenate([p for _, p in parts])
    return suffix[::-1], np.append(0, prefix[:0:-1])
