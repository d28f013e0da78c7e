"""Splitting texts into the pieces that byte-pair merges never cross, many texts at a time in numpy.

The split follows the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Pieces repeat a lot, so each distinct piece is encoded once and kept in a bounded cache.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in groups of about so many characters; a longer text is a group of its own.
GROUP_CHARS = 1_500_000
#: Distinct pieces that a worker keeps; beyond, it forgets all and goes on.
CACHE_PIECES = 1_500_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The characters with the Unicode property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = 0x9E3779B97F4A7C15


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of each character, and a 64-bit random value for it."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            kinds[c] = LETTER
        elif first == "N":
            kinds[c] = NUMBER
    kinds[WHITE] = SPACE
    with np.errstate(over="ignore"):
        x = (np.arange(1, 0x110001, dtype=np.uint64)) * np.uint64(_BASE)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return kinds, x


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of texts laid end to end; ``text_starts`` are those of non-empty texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _tables()[0][points]
    head = np.zeros(n + 1, bool)
    head[text_starts] = True
    run = head.copy()
    run[1:n] |= kinds[1:] != kinds[:-1]
    start = run.copy()
    # A run of other than white space takes one blank before it; any other white space stands alone.
    after = np.flatnonzero(run[1:n] & ~head[1:n] & (kinds[1:] != SPACE) & (kinds[:-1] == SPACE)) + 1
    start[after - 1] = True
    blank = points[after - 1] == 32
    start[after[blank]] = False
    # Contractions: an apostrophe that starts a piece, with the letters of an ending right behind it.
    at = np.flatnonzero(run[:n] & start[:n] & (points == 39))
    at = at[(at + 1 < n) & ~head[np.minimum(at + 1, n)]]
    if len(at):
        one = points[at + 1]
        far = np.minimum(at + 2, n - 1)
        two = np.where((at + 2 < n) & ~head[np.minimum(at + 2, n)], points[far], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for where, size in ((at[short], 1), (at[long & ~short], 2)):
            start[where + 1] = False
            start[np.minimum(where + 1 + size, n)] = True
    return np.flatnonzero(start[:n])


def piece_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each piece."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(points)))
    powers = np.full(int(sizes.max()), _BASE, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(powers, out=powers)
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        terms = _tables()[1][points] * powers[place]
        x = np.add.reduceat(terms, starts) + sizes.astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PieceEncoder:
    """Token ids of texts, piece by piece, with a bounded cache of encoded pieces."""

    def __init__(self, encode: Callable[[bytes], Iterable[int]], most: int = CACHE_PIECES):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        # The characters of each piece, so that a hash alone decides nothing.
        self.letters = np.zeros(0, np.uint32)
        self.from_letter = np.zeros(0, np.int64)
        self.n_letters = np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """``keys`` are sorted and new."""
        found = [self.encode(p.encode("utf-8", "surrogatepass")) for p in pieces]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        begin = len(self.ids) + np.cumsum(size) - size
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.begin = np.insert(self.begin, where, begin)
        self.size = np.insert(self.size, where, size)
        self.ids = np.concatenate([self.ids, flat])
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.from_letter = np.insert(self.from_letter, where, len(self.letters) + np.cumsum(n) - n)
        self.n_letters = np.insert(self.n_letters, where, n)
        self.letters = np.concatenate([self.letters, np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)])

    def _as_cached(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slot: np.ndarray) -> bool:
        """Whether every piece has the characters of the cached piece with its hash."""
        if not (self.n_letters[slot] == sizes).all():
            return False
        place = np.repeat(self.from_letter[slot] - starts, sizes)
        place += np.arange(len(points))
        return bool((self.letters[place] == points).all())

    def _one_by_one(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = piece_starts(points, np.zeros(1, np.int64))
        pieces = [text[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(text)], strict=True)]
        return np.array([i for p in pieces for i in self.encode(p.encode("utf-8", "surrogatepass"))], np.uint32)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        heads = ends - np.fromiter(map(len, texts), np.int64, len(texts))
        starts = piece_starts(points, heads[ends > heads])
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        stops = np.append(starts[1:], len(points))
        keys, first, back = np.unique(piece_hashes(points, starts), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._forget()
        slot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == keys[inside]
        if not known.all():
            new = first[~known]
            self._learn(keys[~known], [joined[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
            slot = np.searchsorted(self.keys, keys)
        slot = slot[back]
        if not self._as_cached(points, starts, stops - starts, slot):
            # Two pieces with one hash: these texts go without the cache.
            return [self._one_by_one(t) for t in texts]
        begin, size = self.begin[slot], self.size[slot]
        done = np.cumsum(size)
        place = np.arange(done[-1]) - np.repeat(done - size, size) + np.repeat(begin, size)
        ids = self.ids[place]
        # Texts end where a piece ends.
        cut = np.concatenate([[0], done])[np.searchsorted(starts, ends)]
        return np.split(ids, cut[:-1])


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``GROUP_CHARS`` characters each, and their texts (null as empty)."""
    for batch in batches:
        texts, at, size = batch.column(column), 0, 0
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for k, n in enumerate(sizes):
            size += int(n)
            if size >= GROUP_CHARS or k == len(sizes) - 1:
                part = batch.slice(at, k + 1 - at)
                yield part, [t or "" for t in part.column(column).to_pylist()]
                at, size = k + 1, 0
