"""Ranked lexical search: an inverted index in shards, walked term by term first and document by document then.

Tasks read whole texts and close a shard of postings behind every ``SHARD_BYTES`` of text.  A query's terms
fall into short and long lists within a shard.  The postings of the short lists are summed term at a time
into accumulators; the accumulators then stand as one more iterator, with the largest sum of each block of
documents as its bound, beside the long lists and their block maxima.  These are walked together document
at a time: blocks, and documents in them, whose bounds cannot reach the ten best found so far are skipped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docstrata.llm.common import scratch_path, ship_package, stored

#: Bytes of text behind which a task closes a shard; a longer text is a shard's last.
SHARD_BYTES = 4 << 20
#: Texts are counted in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Documents to a block of bounds.
BLOCK = 64
#: A list is long where one document in so many of the shard holds the term.
LONG = 16
#: Blocks that are walked before the bar is raised again.
STRIDE = 16
#: Queries that are searched at once, and the bytes of their texts.
QUERIES, QUERY_BYTES = 2_000, 8 << 20
#: An index for known queries holds their terms alone if these are no more than this, and all terms otherwise.
VOCABULARY = 1 << 19

# Fixed: a term is a run of ASCII letters, digits and everything beyond ASCII; only A-Z are lowered.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order; none for null."""
    return text.translate(_FOLD).split() if text else []


INDEX = "ids array<{kind}>, lengths array<bigint>, n_docs bigint, n_terms bigint, terms array<binary>, df array<int>, docs array<int>, tf array<int>"


class _Shard:
    """Postings of the texts that a task has read since the last shard."""

    def __init__(self, known: dict[bytes, int] | None, words: list[bytes] | None):
        self.known, self.words = known, words
        self._clear()

    def _clear(self) -> None:
        self.bytes, self.rows, self.lengths, self.parts = 0, [], [], []
        self.numbers = {} if self.known is None else self.known

    def add(self, texts: list[bytes | None]) -> list[int]:
        """Counts the terms of the texts; the places of those that have any."""
        flat, sizes, kept = [], [], []
        for k, text in enumerate(texts):
            found = terms_of(text)
            if found:
                flat += found
                sizes.append(len(found))
                kept.append(k)
            self.bytes += len(text or b"")
        if self.known is None:
            numbers = self.numbers
            for t in set(flat).difference(numbers):
                numbers[t] = len(numbers)
        ids = np.fromiter((self.numbers.get(t, -1) for t in flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(sizes)) + len(self.lengths), sizes)
        held = ids >= 0
        pairs, tf = np.unique((ids[held] << 32) | doc[held], return_counts=True)
        self.parts.append((pairs, tf.astype(np.int32)))
        self.lengths += sizes
        return kept

    def close(self) -> dict[str, pa.Array]:
        """The shard as arrays of one row; then it is empty again."""
        pairs = np.concatenate([p for p, _ in self.parts])
        tf = np.concatenate([t for _, t in self.parts])
        order = np.argsort(pairs, kind="stable")
        pairs, tf = pairs[order], tf[order]
        numbers, df = np.unique(pairs >> 32, return_counts=True)
        words = self.words if self.words is not None else list(self.numbers)
        row = {
            "lengths": pa.array([self.lengths], pa.list_(pa.int64())),
            "n_docs": pa.array([len(self.lengths)], pa.int64()),
            "n_terms": pa.array([sum(self.lengths)], pa.int64()),
            "terms": pa.array([[words[i] for i in numbers.tolist()]], pa.list_(pa.binary())),
            "df": pa.array([df.astype(np.int32)], pa.list_(pa.int32())),
            "docs": pa.array([(pairs & 0xFFFFFFFF).astype(np.int32)], pa.list_(pa.int32())),
            "tf": pa.array([tf], pa.list_(pa.int32())),
        }
        self._clear()
        return row


def build_index(docs: DataFrame, terms: Iterable[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all ``docs`` as a stored table, one row per shard (columns: ``INDEX``).

    Of ``terms`` (None: all) postings are kept; document lengths count every term.  A text without a term, null
    included, is no document of the index.  Rows that repeat an id are documents each.  An empty table gives an
    index without shards.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    words = None if terms is None else spark.sparkContext.broadcast(sorted(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = None if words is None else words.value
        shard = _Shard(None if listed is None else {t: k for k, t in enumerate(listed)}, listed)
        ids: list[pa.Array] = []

        def row() -> pa.RecordBatch:
            whole = pa.concat_arrays(ids)
            out = {"ids": pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)} | shard.close()
            ids.clear()
            return pa.RecordBatch.from_pydict(out)

        def count(part: pa.RecordBatch, texts: list[bytes | None]) -> None:
            kept = shard.add(texts)
            ids.append(part.column("id").take(pa.array(kept, pa.int64())))

        for batch in batches:
            texts, at, size = [], 0, 0
            for k, text in enumerate(batch.column("body")):
                texts.append(text.as_py())
                size += len(texts[-1] or b"")
                if size >= GROUP_BYTES or k == batch.num_rows - 1:
                    count(batch.slice(at, k + 1 - at), texts)
                    texts, at, size = [], k + 1, 0
                    if shard.bytes >= SHARD_BYTES and shard.lengths:
                        yield row()
        if shard.lengths:
            yield row()

    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, INDEX.format(kind=kind)), "lexical")


@dataclass
class Weighted:
    """What a task needs to search for a block of queries."""

    n_docs: int
    n_terms: int
    weights: dict[bytes, int]
    #: (number, [(term, times)]) of each query that has terms.
    queries: list[tuple[int, list[tuple[bytes, int]]]]
    k: int


@dataclass
class _Best:
    """The best documents of a query so far: (-score, id is null, id), in order, and how much was looked at."""

    k: int
    found: list[tuple] = field(default_factory=list)

    @property
    def bar(self) -> int:
        """A score below this is of no use; equal ones may win by their ids."""
        return -self.found[-1][0] if len(self.found) == self.k else 1

    def offer(self, scores: np.ndarray, docs: np.ndarray, ids: pa.Array) -> None:
        good = scores >= self.bar
        scores, docs = scores[good], docs[good]
        if len(scores) > 4 * self.k:
            # Of many, only those that reach the k-th best among them; ties with it stay.
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, docs = scores[scores >= least], docs[scores >= least]
        if len(scores):
            names = ids.take(pa.array(docs, pa.int64())).to_pylist()
            self.found = sorted(self.found + [(-s, i is None, i) for s, i in zip(scores.tolist(), names, strict=True)], key=lambda x: (x[0], x[1], 0 if x[2] is None else x[2]))[: self.k]


class ShardSearch:
    """One shard, with the impacts of a term worked out when a query first asks for them."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, terms: list[bytes], df: np.ndarray, docs: np.ndarray, tf: np.ndarray, given: Weighted):
        self.ids, self.docs, self.tf, self.given = ids, docs, tf, given
        self.size = len(lengths)
        self.blocks = -(-self.size // BLOCK)
        ends = np.cumsum(df)
        self.lists = {t: (int(e - n), int(e)) for t, e, n in zip(terms, ends, df, strict=True) if t in given.weights}
        wide = 75 * int(lengths.max()) * given.n_docs >= 1 << 62
        scaled = np.array([75 * n * given.n_docs // given.n_terms for n in lengths.tolist()]) if wide else 75 * lengths * given.n_docs // given.n_terms
        self.m = scaled.astype(np.int64) + 25
        self.seen: dict[bytes, tuple] = {}
        self.postings = self.scored = 0

    def _list(self, term: bytes) -> tuple[np.ndarray, np.ndarray] | tuple[None, np.ndarray, np.ndarray]:
        """(documents, impacts) of a short list; (None, impacts of all documents, block maxima) of a long one."""
        if term not in self.seen:
            a, b = self.lists[term]
            docs, tf = self.docs[a:b], self.tf[a:b].astype(np.int64)
            impact = self.given.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[docs]))
            if (b - a) * LONG < self.size:
                self.seen[term] = (docs, impact)
            else:
                dense = np.zeros(self.blocks * BLOCK, np.int64)
                dense[docs] = impact
                self.seen[term] = (None, dense, dense.reshape(-1, BLOCK).max(axis=1))
        return self.seen[term]

    def search(self, terms: list[tuple[bytes, int]], best: _Best) -> None:
        """Offers every document that may be among the best."""
        sums = np.zeros(self.blocks * BLOCK, np.int64)
        long = []
        # Term at a time over the short lists.
        for term, times in terms:
            if term in self.lists:
                found = self._list(term)
                if found[0] is None:
                    long.append((times, found[1], found[2]))
                else:
                    sums[found[0]] += times * found[1]
                self.postings += self.lists[term][1] - self.lists[term][0]
        tops = sums.reshape(-1, BLOCK).max(axis=1)
        if not long:
            held = np.flatnonzero(sums >= best.bar)
            best.offer(sums[held], held, self.ids)
            return
        # Document at a time over the accumulators and the long lists, those that may add most first.
        long.sort(key=lambda x: -x[0] * int(x[2].max()))
        rest = np.zeros((len(long) + 1, self.blocks), np.int64)
        for k in range(len(long) - 1, -1, -1):
            rest[k] = rest[k + 1] + long[k][0] * long[k][2]
        bound = tops + rest[0]
        # The k-th largest accumulator alone is already a score that k documents reach.
        seed = int(np.partition(sums, len(sums) - best.k)[len(sums) - best.k]) if len(sums) > best.k else 0
        bar = max(best.bar, seed, 1)
        live = np.flatnonzero(bound >= bar)
        for at in range(0, len(live), STRIDE):
            some = live[at : at + STRIDE]
            some = some[bound[some] >= bar]
            if not len(some):
                continue
            docs = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            block = np.repeat(some, BLOCK)
            score = sums[docs]
            for k, (times, dense, _) in enumerate(long):
                may = score + rest[k][block] >= bar
                docs, block, score = docs[may], block[may], score[may]
                if not len(docs):
                    break
                self.scored += len(docs)
                score = score + times * dense[docs]
            good = score >= bar
            best.offer(score[good], docs[good], self.ids)
            bar = max(bar, best.bar)


def _shards(batches: Iterator[pa.RecordBatch], given: Weighted) -> Iterator[ShardSearch]:
    flat = lambda batch, name, k: batch.column(name)[k].values
    for batch in batches:
        for k in range(batch.num_rows):
            numbers = [flat(batch, name, k).to_numpy(zero_copy_only=False) for name in ("lengths", "df", "docs", "tf")]
            yield ShardSearch(flat(batch, "ids", k), numbers[0], flat(batch, "terms", k).to_pylist(), *numbers[1:], given)


def _search_block(index: DataFrame, block: list[tuple[int, list[tuple[bytes, int]]]], k: int) -> DataFrame:
    """(q, id, score), the ``k`` best of each task's shards for each query."""
    spark = index.sparkSession
    sums = index.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    wanted = sorted({t for _, terms in block for t, _ in terms})
    # As a table, so that frequencies of other terms never leave the executors.
    listed = spark.createDataFrame(pa.table({"term": pa.array(wanted, pa.binary())}), "term binary")
    counted = index.select(F.inline(F.arrays_zip("terms", "df"))).join(F.broadcast(listed), F.col("terms") == F.col("term")).groupBy("term").agg(F.sum("df").alias("df"))
    weights = {bytes(r["term"]): math.floor(1000 * math.log((2 * sums["d"] + 2) / (2 * r["df"] + 1))) for r in counted.collect()}
    given = spark.sparkContext.broadcast(Weighted(sums["d"] or 0, sums["t"] or 0, weights, block, k))
    kind = index.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = given.value
        best = {q: _Best(have.k) for q, _ in have.queries}
        names = pa.null()
        for shard in _shards(batches, have):
            names = shard.ids.type
            for q, terms in have.queries:
                shard.search(terms, best[q])
        rows = [(q, i, -s) for q, b in best.items() for s, _, i in b.found]
        if rows:
            q, i, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "id": pa.array(i, names), "score": pa.array(s, pa.int64())})

    return index.select("ids", "lengths", "terms", "df", "docs", "tf").mapInArrow(run, f"q bigint, id {kind.simpleString()}, score bigint")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each row of ``queries``, best first.

    Scores are above 0; equal ones go by ascending id (null ids last).  A query without a term, null
    included, has no rows; rows that repeat an item are queries each.  Empty tables give an empty result.
    Other columns are ignored.  Queries go to the executors in blocks of ``QUERIES`` at most, so their number
    is not bounded; documents never leave their tasks but for the ``k`` best of each.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(item_col).alias("item"), F.col(query_col).cast("binary").alias("body"))
    folded = F.translate(F.col(query_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = queries.select(F.explode(F.split(folded, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).alias("w")).filter("w <> ''").distinct()
    few = [r["w"].encode() for r in words.limit(VOCABULARY + 1).collect()]
    index = build_index(docs, few if len(few) <= VOCABULARY else None, id_col, text_col)
    schema = f"{item_col} {asked.schema['item'].dataType.simpleString()}, rank int, {id_col} {docs.schema[id_col].dataType.simpleString()}, score bigint"
    blocks = _blocks(asked)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return _ranked(index, first, k, schema)
    # Each block is written before the next is read, so neither the plan nor the driver's memory grows with them.
    path = scratch_path(spark, "ranked")
    for block in chain((first, second), blocks):
        _ranked(index, block, k, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _ranked(index: DataFrame, block: list[tuple], k: int, schema: str) -> DataFrame:
    """The result's rows for a block of queries."""
    kinds = StructType.fromDDL(schema)
    kind = to_arrow_schema(kinds).field(0).type
    items = pa.table({"q": pa.array([q for q, _, _ in block], pa.int64()), "item": pa.array([item for _, item, _ in block], kind)})
    items = index.sparkSession.createDataFrame(items, f"q bigint, item {kinds[0].dataType.simpleString()}")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    top = _search_block(index, [(q, terms) for q, _, terms in block], k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # A block has ``QUERIES`` rows at most.
    return top.join(F.broadcast(items), "q").select(*[F.col(c).alias(n) for c, n in zip(("item", "rank", "id", "score"), kinds.names, strict=True)])


def _blocks(asked: DataFrame) -> Iterator[list[tuple]]:
    """The queries that have terms as (number, item, [(term, times)]), a bounded block at a time."""
    block, size = [], 0
    for q, row in enumerate(asked.toLocalIterator()):
        body = bytes(row["body"]) if row["body"] is not None else None
        terms = sorted(Counter(terms_of(body)).items())
        if terms:
            block.append((q, row["item"], terms))
            size += len(body)
        if len(block) >= QUERIES or size >= QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block
