"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has ``COORDINATES`` places.  In round ``i`` of the first half each shingle hash falls into one
place; in the second half round ``i`` fills its own place, so every place is filled after at most twice
as many rounds.  A place keeps the smallest (round, hash).  Two sketches agree in a place with the
probability of their sets' Jaccard similarity, concentrated as if places were independent.

Documents whose sketches agree in all rows of a band share a bucket.  The members of a bucket are first
compared with one of them, on the full shingle sets; what these confirmed links connect is one class.
Buckets that still hold more than one class are compared whole, in blocks, so that no link is lost where
the first comparison fails.  What all confirmed links connect is a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import ship_package, stored
from docstrata.llm.components import connected_components
from docstrata.llm.pretoken import grouped

WORDS = 5
#: 32 bands of 6 rows: a pair of similarity 0.8 is missed with probability 6e-5, one of 0.85 with 3e-7, and one of
#: 0.5 is a candidate with probability 0.4, one of 0.3 with 0.02.
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Members of a bucket that are compared in one place, with one of them or with each other or as many others.
BLOCK = 256
#: Columns of shingles that are counted at a time.
COLUMNS = 4096
#: Words whose hashes a worker remembers; beyond, it forgets all and goes on.
WORD_CACHE = 400_000
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15
_FULL = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A-Z lower-cased; a shorter text is one run."""
    # bytes.lower and bytes.split know A-Z and 0x20, 0x09-0x0D only.
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    with np.errstate(over="ignore"):
        take = min(words, len(h))
        out = np.full(len(h) - take + 1, np.uint64(take))
        for k in range(take):
            out = out * np.uint64(_STEP) + h[k : len(h) - take + 1 + k]
        return np.unique(_mix(out))


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of ``t`` coordinates for each non-empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * t, _FULL, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            h = _mix(flat + np.uint64((i + 1) * _STEP & (2**64 - 1)))
            value = (np.uint64(i) << np.uint64(56)) | (h >> np.uint64(8))
            place = (h & np.uint64(0xFF)).astype(np.int64) % t if i < t else i - t
            np.minimum.at(out, owner * t + place, value)
            if len(short := np.flatnonzero((out.reshape(-1, t) == _FULL).any(axis=1))) == 0:
                break
            if len(short) < len(sets):
                keep = np.isin(owner, short)
                flat, owner = flat[keep], owner[keep]
    return out.reshape(-1, t)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    out = np.empty((len(rows), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(rows), np.uint64(b + 1) * _M1)
            for r in range(ROWS):
                key = _mix(key * np.uint64(31) + rows[:, b * ROWS + r])
            out[:, b] = key
    return out.view(np.int64)


def set_key(shingle_set: np.ndarray) -> bytes | None:
    """A digest of the whole set; None if it is empty."""
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest() if len(shingle_set) else None


def sketch_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs(id, text_hash, body)`` to id, text_hash, n_shingles, set_key (null for an empty set) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in grouped(batches, "body"):
            sets = [shingles(t, words) for t in texts]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(sketches(full)) if full else ())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column("id"),
                    "text_hash": part.column("text_hash"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array([set_key(s) for s in sets], pa.binary()),
                    "bands": pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                }
            )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, text_hash bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The links between sets of side 0 and sets of side 1, or among all if there is one side alone.

    Intersections are counted as products of columns of shingles that at least two sets hold.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[column] > 1
    row, column = row[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((counts > 1).sum()), COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[row[here], column[here] - low] = 1
        common += table @ table.T
    common = np.rint(common).astype(np.int64)
    link = common * 100 >= (sizes[:, None] + sizes - common) * percent
    wanted = np.triu(np.ones(link.shape, bool), 1)
    if side.any() and not side.all():
        wanted &= side[:, None] != side
    return list(zip(*(x.tolist() for x in np.nonzero(link & wanted)), strict=True))


def _forest(n: int, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that connect the same as all: one fewer than there are members in each component."""
    root, kept = list(range(n)), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= ``percent`` * union of their shingle sets, and a
    component is what links reach; its id is its smallest identifier.  Texts without words (null,
    empty, white space) are linked with nothing.  Rows that share an id with different texts are linked
    each by its own text; a null id takes part through its text only: it gets the component of equal or
    linked texts, or null where none of them has an id.  Extra columns are ignored; an empty table gives an empty result.
    """
    judged = _judged(docs, id_col, text_col, percent, words)
    return judged.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _judged(docs: DataFrame, id_col: str, text_col: str, percent: int, words: int) -> DataFrame:
    """(id, text_hash, n_shingles, component_id) of every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("body"))
    drawn = stored(sketch_documents(rows, words), "sketches")
    # A node is a shingle set; a text of its smallest id stands for it (of a null id where it has no other).
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("at")
    nodes = drawn.filter("set_key IS NOT NULL").groupBy(F.col("set_key").alias("node")).agg(first, F.min("bands").alias("bands"))
    nodes = stored(nodes.select("node", "at.id", "at.text_hash", "bands"), "nodes")
    where = nodes.select("node", "id", "text_hash")
    seats = nodes.select(F.explode("bands").alias("band"), "node")
    shared = seats.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").drop("high")
    seats = stored(seats.join(stored(shared, "buckets"), "band"), "seats")
    near = stored(seats.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "stars")
    linked = _star_links(rows, where, near, percent, words)
    classes = stored(connected_components(linked), "classes")
    linked = linked.unionByName(_bucket_links(rows, where, _open_buckets(seats, classes), percent, words))
    links = connected_components(linked)
    # A component is named by the smallest id of its nodes.
    least = links.join(where, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    linked = links.join(least, "component").select("node", "component_id")
    components = where.join(linked, "node", "left").select(F.col("node").alias("set_key"), F.coalesce("component_id", "id").alias("component_id"))
    # Both sides of this join are plain reads, so adaptive execution can split a set that most rows have.
    components = stored(components, "components")
    out = drawn.select("id", "text_hash", "n_shingles", "set_key").join(components, "set_key", "left")
    return out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))).drop("set_key")


def _open_buckets(seats: DataFrame, classes: DataFrame) -> DataFrame:
    """(family, node) of the buckets that hold more than one class; of buckets with equal members one."""
    of = classes.select("node", F.col("component").alias("class"))
    classed = seats.join(of, "node", "left").withColumn("class", F.coalesce("class", "node"))
    members = classed.groupBy("band").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("m"), F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("mix")
    )
    open_buckets = members.filter("low <> high").groupBy("m", "first", "mix").agg(F.min("band").alias("band"))
    open_buckets = stored(open_buckets.select("band", "m"), "open")
    return stored(seats.select("band", "node").join(open_buckets, "band").select(F.col("band").alias("family"), "node", "m"), "families")


def _sets_in_places(rows: DataFrame, where: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """``places(node, family, i, j, side)`` with each node's shingle set, dealt and in order.

    Texts are fetched by id and hash, once for all places of a node; the plan is the same at every size.
    """
    per_node = places.groupBy("node").agg(F.collect_list(F.struct("family", "i", "j", "side")).alias("places"))
    named = per_node.join(where, "node").select("node", F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "places").hint("merge")
    own = rows.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("node", "body", "places")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in grouped(batches, "body"):
            sets = [shingles(t, words) for t in texts]
            # Another text of the id with the same hash is not the node's.
            mine = [set_key(s) == node for s, node in zip(sets, part.column("node").to_pylist(), strict=True)]
            for k in range(part.num_rows):
                if not mine[k]:
                    continue
                units = part.column("places").slice(k, 1).flatten()
                for at in range(0, len(units), BLOCK):
                    some = units.slice(at, BLOCK)
                    n = len(some)
                    same = pa.array(np.zeros(n, np.int64))
                    columns = {c: some.field(c) for c in ("family", "i", "j", "side")}
                    columns["node"] = part.column("node").slice(k, 1).take(same)
                    columns["shingles"] = pa.array([sets[k].tobytes()] * n, pa.binary())
                    yield pa.RecordBatch.from_pydict(columns)

    kind = places.schema["family"].dataType.simpleString()
    dealt = own.mapInArrow(deal, f"family {kind}, i int, j int, side int, node binary, shingles binary")
    return dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "node")


def _star_links(rows: DataFrame, where: DataFrame, near: DataFrame, percent: int, words: int) -> DataFrame:
    """The links among ``near(a, b)``: every ``b`` meets its ``a`` in as many places as they need."""
    sized = stored(near.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cells")), "centres")
    zero = F.lit(0)
    arms = near.join(sized, "b").select(F.col("a").alias("node"), F.col("b").alias("family"), F.pmod(F.xxhash64("a"), "cells").cast("int").alias("i"), zero.alias("j"), F.lit(1).alias("side"))
    centres = sized.select(F.col("b").alias("node"), F.col("b").alias("family"), F.explode(F.sequence(zero, F.col("cells") - 1)).alias("i"), zero.alias("j"), zero.alias("side"))
    placed = _sets_in_places(rows, where, arms.unionByName(centres), words)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, None
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("family", "i", "side", "node")), strict=True)
            for (family, i, side, node), data in zip(keys, batch.column("shingles"), strict=True):
                own = np.frombuffer(data.as_buffer(), np.uint64)
                if not side:
                    now, centre = (family, i), own
                elif (family, i) == now:
                    both = len(np.intersect1d(own, centre, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(centre) - both):
                        found.append((node, family))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return stored(placed.mapInArrow(confirm, "a binary, b binary"), "links")


def _bucket_links(rows: DataFrame, where: DataFrame, families: DataFrame, percent: int, words: int) -> DataFrame:
    """``families(family, node, m)`` to confirmed links (a, b) that connect what all links inside connect.

    A family of ``m`` nodes is dealt into blocks of about ``BLOCK``, and every pair of its blocks is compared
    in one place, so a node is sent once for each block of its family and no family meets in one task.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    seats = families.select("family", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    seats = seats.select("family", "node", "block", other)
    i, j = F.least("block", "other"), F.greatest("block", "other")
    side = ((F.col("block") == j) & (i != j)).cast("int")
    placed = _sets_in_places(rows, where, seats.select("node", "family", i.alias("i"), j.alias("j"), side.alias("side")), words)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sides, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            found = _forest(len(nodes), similar_pairs(sets, np.array(sides), percent))
            return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in end], pa.binary()) for end in ([a for a, _ in found], [b for _, b in found])], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j")), strict=True)
            for key, node, side, data in zip(keys, batch.column("node").to_pylist(), batch.column("side").to_pylist(), batch.column("shingles"), strict=True):
                if key != now:
                    if len(nodes) > 1:
                        yield links()
                    now, nodes, sides, sets = key, [], [], []
                # Rows that repeat an id and a text have one place among the nodes.
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sides.append(bool(side))
                    sets.append(np.frombuffer(data.as_buffer(), np.uint64))
        if len(nodes) > 1:
            yield links()

    return stored(placed.mapInArrow(confirm, "a binary, b binary"), "links")


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The document with the smallest id of each component, with all columns; rows with a null id stay.

    Rows that share an id stay or go by their own texts.
    """
    judged = _judged(docs, "doc_id", "text", percent, WORDS)
    gone = judged.filter("id <> component_id").select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    # The row travels as one value, so its columns may have any names.
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_text"))
    return marked.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_text") == F.col("gone_text")), "left_anti").select("row.*")
