"""Removal of long repeated substrings with suffix arrays built by external induced sorting.

Every window of ``length`` bytes is assigned to its *minimizer*, the byte run of ``GRAM`` bytes in it
whose hash is smallest, so equal windows meet at equal minimizers.  Neighbouring windows with one
minimizer form a unit: a stretch of text a little longer than a window.  This deals the corpus out:
units whose minimizer occurs once hold nothing repeated, and units with equal bytes are folded into one
with a count before they travel (every window of a unit that occurs twice is repeated).

All other units go to shards by minimizer, and the suffixes of each shard's whole text are sorted with
their common prefixes (``suffix_sort``): windows whose suffixes are neighbours with ``length`` bytes or
more in common are repeated.  A shard ends at the first minimizer behind ``shard_bytes``; its sort keeps
``memory`` tuples and has the rest in files, so both can be set apart.  A minimizer with more than
``deal_bytes`` of different units (a passage that very many documents hold in different surroundings) is dealt over several;
what each of them has found repeated stands, and the digests of its distinct windows meet those of the
others, so that no group needs one task.

The repeated windows go back to their documents, and the bytes that they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import release, ship_package, stored, whole_text
from docstrata.llm.suffix_sort import MEMORY, Workspace, sort_suffixes

LENGTH = 400
GRAM = 64
#: Bytes of units from which on a shard ends.
SHARD_BYTES = 4 << 20
#: A minimizer with more bytes of different units is dealt over several shards, so many bytes to each.  Every
#: window of a dealt unit is a row then, so minimizers that fit in one shard stay together.
DEAL_BYTES = SHARD_BYTES
#: Units whose windows are handled together when a shard is done.
UNITS = 4096
#: Texts longer than this are scanned in overlapping parts; positions within a part fit in 20 bits.
_PART = (1 << 20) - 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(GRAM // 8)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of each run of ``GRAM`` bytes."""
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        words = _mix(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64))
        h = np.zeros(n, np.uint64)
        for k in range(GRAM // 8):
            h += words[8 * k : 8 * k + n] * _ODD[k]
        return _mix(h)


def units_of(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimizer hash of each unit of a text."""
    begin, count, key = [], [], []
    width = length - GRAM + 1
    for base in range(0, len(data) - length + 1, _PART - length + 1):
        part = data[base : base + _PART]
        h = gram_hashes(part)
        n = len(part) - length + 1
        tagged = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
        filled = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
        filled[: len(h)] = tagged
        blocks = filled.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        at = (least & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        begin.append(first + base)
        count.append(np.diff(np.append(first, n)))
        key.append(h[at[first]].view(np.int64))
    if not begin:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(begin), np.concatenate(count), np.concatenate(key)


def _list_units(rows: DataFrame, length: int) -> DataFrame:
    """``rows(id, mark, body)`` to a row per unit: id, mark, begin, windows, key, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, begin, count, key, digest = [], [], [], [], []
                for k, text in enumerate(part.column("body")):
                    data = text.as_buffer()
                    data = data.to_pybytes() if data is not None else b""
                    if len(data) < length:
                        continue
                    b, c, h = units_of(data, length)
                    row.append(np.full(len(b), k))
                    begin.append(b)
                    count.append(c)
                    key.append(h)
                    digest += [xxhash.xxh3_128_digest(data[x : x + y + length - 1]) for x, y in zip(b.tolist(), c.tolist(), strict=True)]
                if not row:
                    continue
                owner = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column("id").take(owner),
                        "mark": part.column("mark").take(owner),
                        "begin": pa.array(np.concatenate(begin), pa.int64()),
                        "windows": pa.array(np.concatenate(count), pa.int64()),
                        "key": pa.array(np.concatenate(key), pa.int64()),
                        "digest": pa.array(digest, pa.binary()),
                    }
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, mark bigint, begin bigint, windows bigint, key bigint, digest binary")


def _fetch(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted units, with their other columns."""
    names = [c for c in wanted.columns if c not in ("id", "mark")]
    per_row = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct(*names)).alias("units"))
    w = per_row.select(F.col("id").alias("w_id"), F.col("mark").alias("w_mark"), "units")
    joined = rows.join(w, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).select("body", "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                data = part.column("body")[0].as_buffer().to_pybytes()
                units = part.column("units").flatten()
                columns = {c: units.field(c) for c in names}
                sizes = zip(columns["begin"].to_pylist(), columns["windows"].to_pylist(), strict=True)
                columns["body"] = pa.array([data[x : x + y + length - 1] for x, y in sizes], pa.binary())
                yield pa.RecordBatch.from_pydict({c: columns[c] for c in ("key", "salt", "dealt", "digest", "windows", "times", "body")})

    return joined.mapInArrow(run, "key bigint, salt int, dealt boolean, digest binary, windows bigint, times bigint, body binary")


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: each item's group, and its place in the group."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Shard:
    """The units that one sort sees: their bytes as one text, each with an end symbol 0 behind it.

    Bytes are symbols from 1 on.  A common prefix of a window's length that starts inside a unit's windows
    holds no end symbol, so neither side crosses an end.
    """

    def __init__(self, space: Workspace, length: int):
        self.space, self.length = space, length
        self.units: list[tuple] = []  # key, digest, windows, times, dealt
        self.pieces: list[bytes] = []
        self.size = self.waiting = 0
        self.path = None

    def add(self, unit: tuple, body: bytes) -> None:
        self.units.append(unit)
        self.pieces.append(body)
        self.size += len(body) + 1
        self.waiting += len(body) + 1
        if self.waiting > self.space.memory:
            self.path = self.path or self.space.file()
            with open(self.path, "ab") as out:
                self._symbols().tofile(out)
            self.pieces, self.waiting = [], 0

    def _symbols(self) -> np.ndarray:
        text = np.frombuffer(b"".join(p + b"\0" for p in self.pieces), np.uint8).astype(np.uint16) + np.uint16(1)
        text[np.cumsum([len(p) + 1 for p in self.pieces], dtype=np.int64) - 1] = 0
        return text

    def text(self) -> np.ndarray:
        if self.path is None:
            return self._symbols()
        with open(self.path, "ab") as out:
            if self.pieces:
                self._symbols().tofile(out)
        self.pieces = []
        return np.memmap(self.path, np.uint16, "r")

    def results(self) -> Iterator[pa.RecordBatch]:
        """Runs of repeated windows; of units that are dealt over several shards also their other windows' digests."""
        text, length = self.text(), self.length
        marks = self.space.array(len(text), np.uint8)
        last = np.zeros(0, np.int64)

        def mark(suffix: np.ndarray, prefix: np.ndarray) -> None:
            nonlocal last
            hit = np.flatnonzero(prefix >= length)
            marks[suffix[hit]] = 1
            marks[suffix[hit[hit > 0] - 1]] = 1
            if len(hit) and hit[0] == 0:
                marks[last] = 1
            last = suffix[-1:].copy()

        sort_suffixes(text, self.space, mark, length)
        start = 0
        for at in range(0, len(self.units), UNITS):
            units = self.units[at : at + UNITS]
            count = np.array([u[2] for u in units], np.int64)
            begin = start + np.cumsum(count + length) - count - length
            start = int(begin[-1] + count[-1] + length)
            row, place = _ragged(count)
            repeated = (marks[begin[row] + place] > 0) | (np.array([u[3] for u in units]) > 1)[row]
            first = repeated & ((place == 0) | ~np.append(False, repeated[:-1]))
            final = repeated & ((place == count[row] - 1) | ~np.append(repeated[1:], False))
            a, z = np.flatnonzero(first), np.flatnonzero(final)
            yield _found(units, row[a].tolist(), place[a].tolist(), (place[z] + 1).tolist(), None)
            known, out = set(), ([], [], [], [])
            for k in [k for k, u in enumerate(units) if u[4]]:
                body = (text[begin[k] : begin[k] + count[k] + length - 1] - 1).astype(np.uint8).tobytes()
                low = int(np.searchsorted(row, k))
                for w in range(int(count[k])):
                    digest = xxhash.xxh3_128_digest(body[w : w + length])
                    if not repeated[low + w]:
                        for column, value in zip(out, (k, w, w + 1, digest), strict=True):
                            column.append(value)
                    elif digest not in known:
                        known.add(digest)
            if out[0]:
                yield _found(units, *out)
            if known:
                yield _found(units, None, None, None, sorted(known))


_FOUND = "key bigint, digest binary, first bigint, behind bigint, window binary"


def _found(units: list[tuple], who: list | None, first: list | None, behind: list | None, window: list | None) -> pa.RecordBatch:
    n = len(who if who is not None else window)
    none = [None] * n
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array(none if who is None else [units[k][0] for k in who], pa.int64()),
            "digest": pa.array(none if who is None else [units[k][1] for k in who], pa.binary()),
            "first": pa.array(first or none, pa.int64()),
            "behind": pa.array(behind or none, pa.int64()),
            "window": pa.array(window or none, pa.binary()),
        }
    )


def _sorted_shards(units: DataFrame, length: int, shard_bytes: int, memory: int) -> DataFrame:
    """``units``, each key and salt within one task and in order, to what their shards have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Workspace(memory) as space:
            shard, now = Shard(space, length), None
            for batch in batches:
                names = ("key", "salt", "digest", "windows", "times", "dealt", "body")
                for key, salt, digest, windows, times, dealt, body in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if shard.size >= shard_bytes and (key, salt) != now:
                        yield from shard.results()
                        shard = Shard(space, length)
                    now = (key, salt)
                    shard.add((key, digest, windows, times, dealt), body)
            if shard.units:
                yield from shard.results()

    return units.mapInArrow(run, _FOUND)


def _between_shards(loose: DataFrame) -> DataFrame:
    """Windows that were alone in their shard, to the runs of those that another shard has too.

    A shard lists each distinct window of a dealt minimizer once: with its place if it was alone there.
    """
    often = loose.groupBy("window").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("window")
    hits = loose.filter("digest IS NOT NULL").join(often, "window").select("key", "digest", F.col("first").alias("begin"))
    order = Window.partitionBy("key", "digest").orderBy("begin")
    islands = hits.withColumn("island", F.col("begin") - F.row_number().over(order))
    runs = islands.groupBy("key", "digest", "island").agg(F.min("begin").alias("first"), (F.max("begin") + 1).alias("behind"))
    return runs.select("key", "digest", "first", "behind")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    with_text: bool = False,
    shard_bytes: int = SHARD_BYTES,
    deal_bytes: int = DEAL_BYTES,
    memory: int = MEMORY,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` if asked for.

    Every byte that a ``length``-byte string covers which also starts anywhere else is removed; strings
    are judged on the input.  Null texts are empty; texts shorter than ``length`` stay whole.  Rows that
    repeat an id and a text are separate places, so each repeats the other.  Other columns are ignored;
    an empty table gives an empty result.  ``kept`` is binary, since a cut may fall inside a character.
    ``length`` is ``GRAM`` bytes at least; ``shard_bytes``, ``deal_bytes`` and ``memory`` change how shards are cut and
    sorted, never the result.
    """
    if length < GRAM:
        raise ValueError(f"length is {GRAM} at least")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    # Places are named by id and a hash of the text, so rows that share an id stay apart.
    rows = rows.select("id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("body"))
    long = rows.filter(F.length("body") >= length)
    listed = stored(_list_units(long, length), "units")
    shared = stored(listed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"), "shared")
    places = stored(listed.join(shared, "key"), "places")
    release(listed, shared)
    units = places.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "mark", "begin")).alias("at"), F.first("windows").alias("windows"))
    units = stored(units, "folded")
    per_key = units.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.sum(F.col("windows") + F.lit(length)).alias("bytes"))
    per_key = stored(per_key, "keys")
    # One unit, many times: there is nothing to compare it with, and every window of it is repeated.
    sized = units.join(per_key, "key")
    alone = sized.filter("different = 1").select("key", "digest", F.lit(0).cast("long").alias("first"), F.col("windows").alias("behind"))
    spread = F.ceil(F.col("bytes") / F.lit(deal_bytes)).cast("int")
    salt = F.pmod(F.xxhash64("digest"), spread).cast("int")
    some = sized.filter("different > 1").select("at.*", "windows", "key", salt.alias("salt"), (spread > 1).alias("dealt"), "digest", "times")
    fetched = _fetch(long, some, length).repartition("key", "salt").sortWithinPartitions("key", "salt", "digest")
    found = stored(_sorted_shards(fetched, length, shard_bytes, memory), "found")
    apart = _between_shards(found.filter("window IS NOT NULL"))
    runs = stored(found.filter("window IS NULL").drop("window").unionByName(alone).unionByName(apart), "runs")
    release(units, per_key, found)
    spans = places.join(runs, ["key", "digest"]).select("id", "mark", (F.col("begin") + F.col("first")).alias("a"), (F.col("begin") + F.col("behind") - 1 + length).alias("b"))
    per_row = spans.groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    per_row = per_row.select(F.col("id").alias("s_id"), F.col("mark").alias("s_mark"), "spans")
    judged = rows.join(per_row, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left")
    return _cut(judged.select("id", "body", "spans"), with_text).withColumnRenamed("id", id_col)


def _cut(judged: DataFrame, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size, removed, runs, kept = [], [], [], []
                for text, spans in zip(part.column("body"), part.column("spans"), strict=True):
                    data, out, done, n = text.as_buffer().to_pybytes(), [], 0, 0
                    gone = 0
                    for s in spans.as_py() or ():
                        if s["a"] > done or not n:
                            n += 1
                            out.append(data[done : s["a"]])
                            gone += s["b"] - s["a"]
                        else:
                            gone += max(0, s["b"] - done)
                        done = max(done, s["b"])
                    out.append(data[done:])
                    size.append(len(data))
                    removed.append(gone)
                    runs.append(n)
                    kept.append(b"".join(out))
                columns = {
                    "id": part.column("id"),
                    "n_bytes": pa.array(size, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(runs, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                }
                if with_text:
                    columns["kept"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    kind = judged.schema["id"].dataType.simpleString()
    return judged.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
