"""Packing token sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder.  The remainders' lengths, in classes a few
tokens wide, form a histogram of bounded size; on it a linear program over *patterns* (which classes
share a sequence) is solved by column generation, with an unbounded-knapsack dynamic program pricing
new patterns by the dual values.  Whole uses of the patterns are taken, what rounding leaves is packed
best-fit decreasing, and the documents, ranked within their class, take the slots of the patterns.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import ship_package, stored
from docstrata.llm.pretoken import PieceEncoder, grouped

CAPACITY = 2048
#: Tokens in a length class; a power of two, so that the capacity is a whole number of classes.
WIDTH = 8
END_ID = 1
#: The classic pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a byte-level BPE file of the ``tokenizers`` library, without special tokens.

    Such files write each byte as a printable character: itself where printable, else the next free
    character from U+0100 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    return {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def added_tokens(path: str) -> dict[str, int]:
    """Literals that such a file gives an id of their own; those that take the text around them are refused."""
    with open(path, encoding="utf-8") as f:
        added = [t for t in json.load(f).get("added_tokens", ()) if t["content"]]
    if wide := [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
        raise ValueError(f"added tokens that depend on the text around them: {wide}")
    return {t["content"]: t["id"] for t in added}


class TextEncoder:
    """Token ids as the library gives them: added tokens by their ids, what lies between in pieces."""

    def __init__(self, path: str):
        core = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=vocabulary(path), special_tokens={})._core_bpe
        self.pieces, self.added = PieceEncoder(core.encode_single_piece), added_tokens(path)
        # Of literals that start at one place the longest counts.
        self.literal = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        # Literals and what lies before, between and behind them take turns.
        split = [self.literal.split(t) if any(a in t for a in self.added) else [t] for t in texts]
        found = iter(self.pieces([part for parts in split for part in parts[::2]]))
        out = []
        for parts in split:
            ids = [np.array([self.added[part]], np.uint32) if k % 2 else next(found) for k, part in enumerate(parts)]
            out.append(np.concatenate(ids) if len(ids) > 1 else ids[0])
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def token_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """The pieces of every document: full ones and the remainder, with class, task and rank in both."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = _encoder(path), TaskContext.get().partitionId(), {}
        for part, texts in grouped(batches, "body"):
            row, start, length, crc, total, klass, rank = [], [], [], [], [], [], []
            for k, ids in enumerate(encoder(texts)):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    c = -(-len(piece) // width) if len(piece) < capacity else 0
                    row.append(k)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    klass.append(c)
                    rank.append(seen.get(c, 0))
                    seen[c] = rank[-1] + 1
            whole = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column("id").take(whole(row)),
                    "start": whole(start),
                    "length": whole(length),
                    "ids_crc32": whole(crc),
                    "doc_tokens": whole(total),
                    "class": pa.array(klass, pa.int32()),
                    "task": pa.array([task] * len(row), pa.int32()),
                    "rank": whole(rank),
                }
            )

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, task int, rank bigint"
    return rows.mapInArrow(run, schema)


def _priced(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each class the most valuable multiset of ``sizes`` within ``capacity`` that holds it.

    Returns the values and the patterns, a row each; the best of them is the best pattern of all.
    """
    best, counts = np.zeros(capacity + 1), np.zeros((capacity + 1, len(sizes)), np.int32)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], counts[room] = best[room - 1], counts[room - 1]
        if fit := fits[room]:
            gain = values[:fit] + best[room - sizes[:fit]]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], counts[room] = gain[k], counts[room - sizes[k]]
                counts[room, k] += 1
    return values + best[capacity - sizes], counts[capacity - sizes] + np.eye(len(sizes), dtype=np.int32)


#: A pattern of this value or less does not better the plan.
ENOUGH = 1 + 1e-7
#: Pivots after which the inverse is worked out anew.
RENEW = 100
#: How far prices keep to the best dual values known so far; less where that finds nothing.
SMOOTH = (0.9, 0.6, 0.0)


#: Demands are raised by so small a share, differently for each class, so that no two ratios tie and no basis returns.
APART = 1e-9


def _leaving(use: np.ndarray, move: np.ndarray) -> int:
    """The row that leaves: the least ratio; of those that rounding cannot tell apart the one that moves most."""
    up = np.flatnonzero(move > 1e-7)
    ratio = use[up] / move[up]
    tied = up[ratio <= ratio.min() + 1e-13]
    return int(tied[move[tied].argmax()])


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns (one column each), how often the linear program uses each, and dual values that prove it.

    ``sizes`` ascend.  The start is one pattern for each class, filled with that class alone.  A round
    prices the best pattern that holds each class, by dual values drawn towards the best known ones, and pivots
    among these patterns until none is better.  The first known ones are the sizes' shares of the capacity, which
    no pattern exceeds.  Generation ends at the optimum alone: when the plain dual values price no pattern above
    ``ENOUGH``, or when feasible dual values reach the plan's own number of sequences.
    """
    m = len(sizes)
    # Demands are scaled, so that tolerances mean the same for any corpus.
    scale = float(demand.max())
    plain = demand / scale
    want = plain + APART * (1 + np.arange(m) * 0.6180339887498949 % 1)
    patterns = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    use, pivots, since = inverse @ want, 0, 0
    center, near = sizes / capacity, 0
    while True:
        dual = inverse.sum(axis=0)
        if use.sum() - center @ want <= 1e-9 * use.sum():
            break
        share = SMOOTH[near]
        tried = share * center + (1 - share) * dual
        values, pool = _priced(tried, sizes, capacity)
        feasible = tried / max(1.0, values.max())
        if feasible @ want > center @ want:
            center = feasible
        pool = pool[pool @ dual > ENOUGH]
        if not len(pool):
            if near + 1 < len(SMOOTH):
                near += 1
            elif since:
                # Before the optimum is believed, the inverse is made exact.
                inverse, since = np.linalg.inv(patterns.astype(float)), 0
                use = np.maximum(inverse @ want, 0)
            else:
                center = dual
                break
            continue
        near = 0
        while True:
            value = pool @ inverse.sum(axis=0)
            j = int(value.argmax())
            if value[j] <= ENOUGH:
                break
            move = inverse @ pool[j]
            leave = _leaving(use, move)
            step = use[leave] / move[leave]
            use = np.maximum(use - step * move, 0)
            use[leave] = step
            patterns[:, leave] = pool[j]
            pivots, since = pivots + 1, since + 1
            if pivots % RENEW == 0:
                inverse = np.linalg.inv(patterns.astype(float))
                use = np.maximum(inverse @ want, 0)
            else:
                inverse[leave] /= move[leave]
                move[leave] = 0
                inverse -= np.outer(move, inverse[leave])
    return patterns, np.maximum(np.linalg.solve(patterns.astype(float), plain), 0) * scale, center


def plan_patterns(histogram: dict[int, int], units: int) -> list[tuple[int, int, int, int, int]]:
    """Slots ``(class, first rank, ranks, items in a sequence, first sequence)`` for every remainder.

    ``histogram`` has at most ``units`` classes; the result is bounded by the patterns and by what
    rounding leaves, and doesn't grow with the number of documents.
    """
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    patterns, use, _ = column_generation(sizes, demand.astype(float), units)
    left, uses = demand.copy(), []
    for k in np.argsort(-use):
        column = patterns[:, k]
        times = int(use[k] + 1e-9)
        if (held := column > 0).any():
            times = min(times, int((left[held] // column[held]).min()))
        if times > 0:
            uses.append((column, times))
            left -= column * times
    # Best-fit decreasing over what is left: fewer sequences than there are patterns hold it.
    bins: list[list] = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            fits = [b for b in bins if b[0] >= sizes[k]]
            if fits:
                b = min(fits, key=lambda b: b[0])
            else:
                bins.append(b := [units, np.zeros(len(sizes), np.int64)])
            b[0] -= int(sizes[k])
            b[1][k] += 1
    uses += [(b[1], 1) for b in bins]
    slots, given, sequence = [], np.zeros(len(sizes), np.int64), 0
    for column, times in uses:
        for k in np.flatnonzero(column):
            slots.append((int(sizes[k]), int(given[k]), int(column[k]) * times, int(column[k]), sequence))
            given[k] += int(column[k]) * times
        sequence += times
    return slots


def pack_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, width: int = WIDTH
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is a vocabulary that every executor can open.  A literal of one of its added tokens in a
    text gets that token's id, as in the library.  A null or empty text is the end token alone.  Rows that repeat an id are packed each.  A full piece is a sequence of its own.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, path, id_col, text_col, capacity, width), "pieces")
    counts = stored(pieces.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["class"]: r["n"] for r in counts.filter("class > 0").groupBy("class").agg(F.sum("n").alias("n")).collect()}
    slots = plan_patterns(histogram, capacity // width)
    sequences = max((first + ranks // each for _, _, ranks, each, first in slots), default=0)
    # A rank within a class: the rank within its task behind the pieces of the tasks before.
    before = F.sum("n").over(Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("class", "task", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["class", "task"]).withColumn("nth", F.col("rank") + F.col("before"))
    full = ranked.filter("class = 0").select("id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(sequences) + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = spark.createDataFrame(slots, "slot_class int, first long, ranks long, each long, sequence long")
    fits = (F.col("class") == F.col("slot_class")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("first") + F.col("ranks"))
    # The slots are bounded by the number of classes (see plan_patterns), whatever the corpus.
    placed = ranked.filter("class > 0").join(F.broadcast(table), fits)
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.expr("(nth - first) div each"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
    out = full.unionByName(placed.select(*full.columns))
    return out.withColumnRenamed("id", id_col)
