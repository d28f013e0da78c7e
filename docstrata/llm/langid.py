"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in long overlapping windows of bytes, in both directions: state runs on across words, and
the first and last bytes of a window only warm it up, unless the text begins or ends there.  Every byte
position gets language probabilities from both directions' states, and a document's probabilities are the
mean over all its positions.  The network is trained in numpy by backpropagation through time on
stretches of a bounded sample of documents.

Gates are piecewise linear (values clipped to [0, 1], candidates to [-1, 1]):
``z = clip(Az x + Bz h)``, ``r = clip(Ar x + Br h)``, ``c = clip(Ac x + r * Bc h)``, ``h' = h + z (c - h)``.
The byte ``PAD`` behind a shorter window closes the gate ``z``, so the state passes it unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import held_out, ship_package
from docstrata.llm.pretoken import grouped

HIDDEN = 16
EMBED = 16
#: Bytes that a window labels, and bytes on either side that it reads as well.
OWN, CONTEXT = 960, 32
#: Windows that are read side by side.
WIDTH = 512
#: Documents the network may learn from, shared alike by all languages, and what each language has at least
#: however many there are; they are the first of a language by a hash of the id.
SAMPLE_DOCS, LEAST_DOCS = 1500, 50
#: Stretches of each such document, spread evenly over its whole text, and bytes in each.
STRETCHES, STRETCH = 24, 64
#: Bits of the hash by which ids are counted before they are chosen.
HASH_BITS = 10
STEPS, BATCH, RATE = 400, 128, 0.01
PAD = 256
UNKNOWN = "und"


def padded(windows: list[bytes]) -> np.ndarray:
    """Bytes by time and window, with ``PAD`` behind shorter windows."""
    table = np.full((len(windows), max(map(len, windows), default=0)), PAD, np.intp)
    for row, w in zip(table, windows, strict=True):
        row[: len(w)] = np.frombuffer(w, np.uint8)
    return np.ascontiguousarray(table.T)


@dataclass
class ByteNetwork:
    """Weights of both directions (forward 0, backward 1) and of the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, languages: list[str], seed: int = 7) -> ByteNetwork:
        draw = np.random.default_rng(seed)
        w = {"embed": draw.normal(0, 0.5, (PAD + 1, EMBED))}
        for d in "01":
            w["in" + d] = draw.normal(0, EMBED**-0.5, (3 * HIDDEN, EMBED))
            w["rec" + d] = draw.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN))
            # Gates start half open, where they have a slope.
            w["in" + d][: 2 * HIDDEN] /= 4
            w["rec" + d][: 2 * HIDDEN] /= 4
            w["bias" + d] = np.repeat([0.5, 0.0], [2 * HIDDEN, HIDDEN])
        w["out"] = draw.normal(0, 0.1, (len(languages), 2 * HIDDEN))
        w["shift"] = np.zeros(len(languages))
        return cls(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def _drive(self, d: str) -> np.ndarray:
        """What each byte adds to the gates, by gate and byte."""
        w = self.weights
        drive = w["in" + d] @ w["embed"].T + w["bias" + d][:, None]
        drive[:HIDDEN, PAD] = -1e6
        return drive

    def states(self, table: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states by time, unit and window."""
        h3, drive, rec = HIDDEN, self._drive(d), self.weights["rec" + d]
        steps, width = table.shape
        h = np.zeros((h3, width), drive.dtype)
        out = np.empty((steps, h3, width), drive.dtype)
        x, u, c = np.empty((3 * h3, width), drive.dtype), np.empty((3 * h3, width), drive.dtype), np.empty_like(h)
        for t in range(steps) if d == "0" else range(steps - 1, -1, -1):
            np.take(drive, table[t], axis=1, out=x, mode="clip")
            np.matmul(rec, h, out=u)
            gates = x[: 2 * h3]
            gates += u[: 2 * h3]
            np.clip(gates, 0, 1, out=gates)
            np.multiply(gates[h3:], u[2 * h3 :], out=c)
            c += x[2 * h3 :]
            np.clip(c, -1, 1, out=c)
            if keep is not None:
                keep.append((t, h.copy(), gates.copy(), c.copy(), u[2 * h3 :].copy()))
            c -= h
            c *= gates[:h3]
            h += c
            out[t] = h
        return out

    def _label(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        w = self.weights
        logits = w["out"][:, :HIDDEN] @ forward
        logits += w["out"][:, HIDDEN:] @ backward
        logits += w["shift"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def label(self, table: np.ndarray) -> np.ndarray:
        """Language probabilities by time, language and window."""
        return self._label(self.states(table, "0"), self.states(table, "1"))

    def gradients(self, table: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions against their window's language, and its gradients through time."""
        keeps: dict[str, list] = {"0": [], "1": []}
        sides = [self.states(table, d, keeps[d]) for d in "01"]
        p = self._label(*sides)
        mask, windows = table != PAD, np.arange(table.shape[1])
        n = max(1, mask.sum())
        loss = -(np.log(p[:, target, windows] + 1e-9) * mask).sum() / n
        e = p
        e[:, target, windows] -= 1
        e *= mask[:, None, :] / n
        w, h3 = self.weights, HIDDEN
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["shift"] = e.sum(axis=(0, 2))
        for k, d in enumerate("01"):
            half = slice(k * h3, (k + 1) * h3)
            g["out"][:, half] = np.einsum("tlb,thb->lh", e, sides[k], optimize=True)
            own = w["out"][:, half].T @ e
            back = np.zeros((h3, table.shape[1]), own.dtype)
            by_byte = np.zeros((PAD + 1, 3 * h3), own.dtype)
            for t, h, gates, c, uc in reversed(keeps[d]):
                z, r = gates[:h3], gates[h3:]
                dh = own[t] + back
                dc = dh * z * (np.abs(c) < 1)
                dz = dh * (c - h) * ((z > 0) & (z < 1))
                dr = dc * uc * ((r > 0) & (r < 1))
                np.add.at(by_byte, table[t], np.concatenate([dz, dr, dc]).T)
                du = np.concatenate([dz, dr, dc * r])
                g["rec" + d] += du @ h.T
                back = dh * (1 - z) + w["rec" + d].T @ du
            g["bias" + d] = by_byte.sum(axis=0)
            g["in" + d] = by_byte.T @ w["embed"]
            g["embed"] += by_byte @ w["in" + d]
        return float(loss), g

    def fit(self, windows: list[bytes], target: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> ByteNetwork:
        """Adam on batches of windows, languages drawn alike however often they occur."""
        draw = np.random.default_rng(seed)
        share = 1 / np.bincount(target)[target]
        share /= share.sum()
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            pick = draw.choice(len(windows), batch, p=share)
            _, g = self.gradients(padded([windows[i] for i in pick]), target[pick])
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1))) * min(1.0, 1.0 / max(size, 1e-9))
            for k, x in g.items():
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.99 * second[k] + 0.01 * x * x
                fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                self.weights[k] = (self.weights[k] - pace * fix * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean of each text's position probabilities; zeros for an empty text."""
        out = np.zeros((len(texts), len(self.languages)))
        windows = []  # length, text, begin, first and last of its own bytes
        for k, text in enumerate(texts):
            for at in range(0, len(text), OWN):
                begin, end = max(0, at - CONTEXT), min(len(text), at + OWN + CONTEXT)
                windows.append((end - begin, k, begin, at - begin, min(len(text), at + OWN) - begin))
        windows.sort()
        for a in range(0, len(windows), WIDTH):
            part = windows[a : a + WIDTH]
            table = padded([texts[k][begin : begin + size] for size, k, begin, _, _ in part])
            own = np.zeros((len(part), len(table)), np.float32)
            for row, (_, _, _, low, high) in zip(own, part, strict=True):
                row[low:high] = 1
            own = np.ascontiguousarray(own.T)
            forward, backward = self.states(table, "0"), self.states(table, "1")
            total = np.zeros((len(self.languages), len(part)))
            for t in range(0, len(table), 32):
                p = self._label(forward[t : t + 32], backward[t : t + 32])
                total += np.einsum("tlb,tb->lb", p, own[t : t + 32])
            np.add.at(out, np.array([k for _, k, _, _, _ in part]), total.T)
        return out / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]


def label_positions(network: ByteNetwork, text: str) -> list[str]:
    """The most likely language of each byte of a text, read as one window."""
    best = network.label(padded([text.encode()]))[:, :, 0].argmax(axis=1) if text else []
    return [network.languages[k] for k in best]


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> DataFrame:
    """(lang, _id, body) to learn from: for each language its first ids by hash, all if it has few.

    A language has ``most`` by the number of languages, ``LEAST_DOCS`` at least.  Held-out rows, null labels
    and blank texts are left out; of rows that repeat an id and a label the first text in order
    counts, and rows of one label without an id count as one.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("body").rlike(r"\S") & ~held_out("_id"))
    share = max(LEAST_DOCS, -(-most // max(1, rows.select("lang").distinct().count())))
    # The ids are chosen without the texts, so only the chosen texts travel.
    hashed = F.xxhash64("_id")
    keys = rows.select("lang", "_id").distinct().withColumn("part", F.shiftrightunsigned(hashed, 64 - HASH_BITS))
    # Only the parts of the hash's range that a language's first ids lie in are put in order.
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = keys.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    first = keys.join(F.broadcast(parts.filter(F.col("before") < share).select("lang", "part")), ["lang", "part"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("part", hashed, "_id"))
    chosen = first.withColumn("nth", nth).filter(F.col("nth") <= share).select(F.col("lang").alias("_lang"), F.col("_id").alias("_chosen"))
    same = (F.col("lang") == F.col("_lang")) & F.col("_id").eqNullSafe(F.col("_chosen"))
    return rows.join(F.broadcast(chosen), same, "left_semi").groupBy("lang", "_id").agg(F.min("body").alias("body"))


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> tuple[list[str], list[bytes], np.ndarray]:
    """Languages, stretches and their languages from the texts of ``training_rows``.

    Executors cut the stretches, so ``STRETCHES * STRETCH`` bytes of a document reach the driver at most.
    """
    rows = training_rows(docs, id_col, text_col, lang_col, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in grouped(batches, "body"):
            cut = []
            for text in texts:
                data = text.encode("utf-8", "surrogatepass")
                # Every stretch of a short text, evenly spread ones of a long text.
                places = range(0, len(data), max(STRETCH, -(-len(data) // STRETCHES)))
                cut.append([data[a : a + STRETCH] for a in places])
            yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "cut": pa.array(cut, pa.list_(pa.binary()))})

    cut = rows.select("lang", "body").mapInArrow(run, "lang string, cut array<binary>").select("lang", F.explode("cut").alias("bytes"))
    found = sorted((r["lang"], bytes(r["bytes"])) for r in cut.collect())
    languages = sorted({lang for lang, _ in found})
    number = {lang: k for k, lang in enumerate(languages)}
    return languages, [b for _, b in found], np.array([number[lang] for lang, _ in found], np.int64)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_DOCS) -> ByteNetwork | None:
    """A network from a sample of each language's rows that are not held out; None without any."""
    ship_package(docs.sparkSession)
    languages, windows, target = training_windows(docs, id_col, text_col, lang_col, most)
    return ByteNetwork.new(languages).fit(windows, target) if windows else None


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter, with all their columns; those that a network can judge."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(t or "") for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def detect_languages(
    docs: DataFrame, network: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, and the columns named in ``keep``.

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing could be
    learned.  Of languages with equal scores the first in order is taken.  Rows that repeat an id are
    judged each; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    # Own names for what goes through Python, so that columns of the table may have any name.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.struct(*[F.col(c) for c in (keep or [id_col])]).alias("kept"))
    if not keep:
        rows = rows.drop("kept")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "body") + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in grouped(batches, "body"):
            known = [network is not None and has_letter(t) for t in texts]
            shares = network.pooled([t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts, known, strict=True)]) if network else np.zeros((len(texts), 1))
            best = shares.argmax(axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: part.column(c) for c in part.schema.names if c != "body"},
                    "lang_pred": pa.array([network.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], pa.string()),
                    "score": pa.array([float(min(1.0, s[b])) if ok else 0.0 for s, b, ok in zip(shares, best, known, strict=True)], pa.float64()),
                }
            )

    out = rows.mapInArrow(run, schema)
    own = [] if id_col in keep else [F.col("id").alias(id_col)]
    held = [held_out(F.col("id")).alias("held_out"), F.col("lang_pred"), F.col("score")]
    return out.select(*own, *[F.col(f"kept.{c}").alias(c) for c in keep], *held)
