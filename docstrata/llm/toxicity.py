"""Toxicity scores by the nearest labelled examples.

A bounded sample of labelled documents gives the examples and their vocabulary: every word
of theirs.  Vectors hold all of it; a word weighs (1 + log tf) * idf * phi, where phi is
the correlation of the word's presence with the label in the sample (the README has what plain idf gives).
The examples' unit vectors form an inverted index with block maxima: a query first bounds the cosine of
every block of examples, scores the blocks with the greatest bounds, then those whose bound can still beat
the neighbours it has, so the neighbours are exact.  Their distance-weighted vote, calibrated on left-out
examples, is the score; the neighbours are its evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import held_out, ship_package, stored
from docstrata.llm.pretoken import grouped

#: Labelled documents of each class to learn from, the first by a hash of the id.
SAMPLE_PER_CLASS = 1500
NEIGHBOURS = 15
BLOCK = 64
#: Blocks that a query scores before it knows how near its neighbours are.
FIRST_BLOCKS = 4
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def _ragged(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... for each k, ``sizes[k]`` of them."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@dataclass
class BlockMaxIndex:
    """Postings of unit vectors, by term and block of examples, with the greatest weight in each block."""

    ids: list
    labels: np.ndarray
    starts: np.ndarray  # of each term's blocks
    blocks: np.ndarray  # block numbers, by term
    most: np.ndarray  # greatest weight in the block
    begin: np.ndarray  # of the block's postings
    docs: np.ndarray
    weights: np.ndarray

    @classmethod
    def build(cls, ids: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> BlockMaxIndex:
        # Examples with the same strongest term lie together, so block maxima differ between blocks.
        lead = np.array([int(t[w.argmax()]) if len(t) else -1 for t, w in vectors], np.int64)
        order = np.argsort(lead, kind="stable")
        sizes = np.array([len(vectors[k][0]) for k in order], np.int64)
        place = np.repeat(np.arange(len(order)), sizes)
        none = [np.zeros(0, np.int64)]
        term = np.concatenate(none + [vectors[k][0] for k in order])
        weight = np.concatenate([np.zeros(0)] + [vectors[k][1] for k in order])
        by_term = np.argsort(term, kind="stable")
        place, term, weight = place[by_term], term[by_term], weight[by_term]
        block = place // BLOCK
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else none[0]
        most = np.maximum.reduceat(weight, new) if len(term) else np.zeros(0)
        starts = np.searchsorted(term[new], np.arange(terms + 1))
        return cls([ids[k] for k in order], labels[order], starts, block[new], most, np.append(new, len(term)), place, weight)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples with a positive cosine; ties go to lower places."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        entry, share = _ragged(self.starts[terms], sizes), np.repeat(weights, sizes)
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        if not len(entry):
            return places, cosines
        block = self.blocks[entry]
        bound = np.bincount(block, self.most[entry] * share)
        # The most promising blocks first; then, together, all that may still hold a nearer example.
        order = np.argsort(-bound, kind="stable")
        for group in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            least = cosines[-1] - 1e-12 if len(cosines) >= k else 1e-300
            wanted = np.zeros(len(bound), bool)
            wanted[group] = bound[group] >= least
            picked = np.flatnonzero(wanted[block])
            if not len(picked):
                continue
            own = entry[picked]
            sizes = self.begin[own + 1] - self.begin[own]
            posting = _ragged(self.begin[own], sizes)
            score = np.bincount(self.docs[posting], self.weights[posting] * np.repeat(share[picked], sizes))
            found = np.flatnonzero(score)
            if without is not None:
                found = found[found != without]
            places, cosines = np.concatenate([places, found]), np.concatenate([cosines, score[found]])
            if len(cosines) > k:
                # Only those that reach the k-th cosine are put in order.
                near = np.flatnonzero(cosines >= np.partition(cosines, -k)[-k])
                places, cosines = places[near], cosines[near]
            best = np.lexsort((places, -cosines))[:k]
            places, cosines = places[best], cosines[best]
        return places, cosines


@dataclass
class ToxicityModel:
    terms: dict[str, int]
    weights: np.ndarray  # idf * phi of each term
    index: BlockMaxIndex
    slope: np.ndarray
    alone: float

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A unit vector of distinct terms; terms without weight are left out."""
        raw = (1 + np.log(counts)) * self.weights[terms]
        here = raw > 0
        terms, raw = terms[here], raw[here]
        return terms, raw / np.sqrt((raw * raw).sum()) if len(raw) else raw

    def judge(self, terms: np.ndarray, weights: np.ndarray, without: int | None = None) -> tuple[float, list[tuple]]:
        """The calibrated score and the neighbours (id, label, cosine)."""
        places, cosines = self.index.nearest(terms, weights, NEIGHBOURS, without)
        if not len(places):
            return self.alone, []
        x = _features(self.index.labels[places], cosines)
        score = float(1 / (1 + np.exp(-np.clip(x @ self.slope, -30, 30))))
        return score, [(self.index.ids[p], int(self.index.labels[p]), float(min(c, 1.0))) for p, c in zip(places.tolist(), cosines.tolist(), strict=True)]


def _features(labels: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """Bias, the vote weighted by closeness, and the vote times the nearest cosine."""
    weight = 1 / (1.05 - np.minimum(cosines, 1.0))
    vote = float((weight * labels).sum() / weight.sum())
    return np.array([1.0, 2 * vote - 1, (2 * vote - 1) * float(cosines[0])])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    slope = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ slope, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * slope)
        slope += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return slope


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters, in order."""
    return _WORD.findall(text.lower())


def term_counts(text: str, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The known words of a text, each once, and how often they occur."""
    found = [(terms[w], n) for w, n in Counter(words_of(text)).items() if w in terms]
    ids = np.fromiter((t for t, _ in found), np.int64, len(found))
    return ids, np.fromiter((n for _, n in found), np.float64, len(found))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """(id, label, body) of the labelled documents to learn from."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    order = (F.xxhash64("id"), F.col("id"))
    of_class = lambda k: known.filter(F.col("label") == k).orderBy(*order).limit(per_class)
    # At most per_class ids and labels of each class, so they may go to every executor.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).filter("body IS NOT NULL")
    return rows.join(F.broadcast(of_class(1).unionByName(of_class(0))), "id")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from at most ``per_class`` labelled documents of each class that are not held out.

    Null labels and labels without a text are ignored; of repeated labels the toxic one counts, and of
    repeated documents the first text in order; of equal texts with equal labels one.
    """
    ship_package(docs.sparkSession)
    rows = _sample(docs, labels, per_class, id_col, text_col).groupBy("id", "label").agg(F.min("body").alias("body"))
    # Of copies of one text with one label, one counts.
    rows = rows.groupBy("body", "label").agg(F.min("id").alias("id")).select("id", "label", "body")
    rows = stored(rows, "examples")
    kind = rows.schema["id"].dataType.simpleString()

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in grouped(batches, "body"):
            found = [sorted(set(words_of(x))) for x in texts]
            yield pa.RecordBatch.from_pydict({"label": part.column("label"), "terms": pa.array(found, pa.list_(pa.string()))})

    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    n = n1 + n0
    seen = rows.mapInArrow(distinct_terms, "label int, terms array<string>").select("label", F.explode("terms").alias("term"))
    # The terms of at most 2 * per_class documents, so they may come to the driver.
    seen = seen.groupBy("term").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("df")).orderBy("term").toArrow()
    terms = {t: k for k, t in enumerate(seen.column("term").to_pylist())}
    a, df = (seen.column(c).to_numpy().astype(np.float64) for c in ("a", "df"))
    spread = np.sqrt(np.maximum(df * (n - df) * n1 * n0, 1e-9))
    phi = np.abs(a * n0 - (df - a) * n1) / spread
    model = ToxicityModel(terms, np.log(1 + n / np.maximum(df, 1)) * phi, BlockMaxIndex.build([], np.zeros(0), [], len(terms)), np.zeros(3), (n1 + 0.5) / (n + 1))
    if not terms:
        return model
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in grouped(batches, "body"):
            found = [term_counts(t, sent.value) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column("id"),
                    "label": part.column("label"),
                    "terms": pa.array([t.tobytes() for t, _ in found], pa.binary()),
                    "counts": pa.array([c.tobytes() for _, c in found], pa.binary()),
                }
            )

    examples = rows.mapInArrow(counts, f"id {kind}, label int, terms binary, counts binary").orderBy("id").collect()
    vectors = [model.vector(np.frombuffer(r["terms"], np.int64), np.frombuffer(r["counts"])) for r in examples]
    blank = [r["label"] for r, v in zip(examples, vectors, strict=True) if not len(v[0])]
    labels_of = np.array([r["label"] for r in examples])
    model.index = BlockMaxIndex.build([r["id"] for r in examples], labels_of, vectors, len(terms))
    model.alone = (sum(blank) + 0.5) / (len(blank) + 1)
    # Calibration: every example is judged without itself.
    place = {i: k for k, i in enumerate(model.index.ids)}
    x, target = [], []
    for r, (own, weights) in zip(examples, vectors, strict=True):
        places, cosines = model.index.nearest(own, weights, NEIGHBOURS, place[r["id"]])
        if len(places):
            x.append(_features(model.index.labels[places], cosines))
            target.append(r["label"])
    if x:
        model.slope = _logistic(np.array(x), np.array(target, float))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, evidence.

    ``evidence`` is the neighbours, nearest first: (doc_id, label, cosine), ids of any type.  A text without
    any term of the examples (null and empty ones too) has none, and the score of the blank examples.  Rows that repeat an id
    are scored each; other columns are ignored.  The index that goes to the executors is bounded by the
    sample and the vocabulary.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part, texts in grouped(batches, "body"):
            item = pa.struct([("doc_id", part.column("id").type), ("label", pa.int32()), ("cosine", pa.float64())])
            judged = [own.judge(*own.vector(*term_counts(t, own.terms))) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column("id"),
                    "score": pa.array([s for s, _ in judged], pa.float64()),
                    "evidence": pa.array([[{"doc_id": i, "label": y, "cosine": c} for i, y, c in near] for _, near in judged], pa.list_(item)),
                }
            )

    out = rows.mapInArrow(run, f"id {kind}, score double, evidence array<struct<doc_id:{kind},label:int,cosine:double>>")
    return out.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
    )
