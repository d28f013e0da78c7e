"""Conversations as training texts in windows of a budget of tokens.

A turn is written as ``<|im_start|>role``, a line end, its text and ``<|im_end|>``; control strings in roles and
texts are escaped so that they can be read back.  Prefix sums of the turns' tokens place every turn in its
conversation; a window is a span of whole turns that begin within one stretch of ``room`` tokens.  Later
windows repeat the system turn and the last turns before them, up to ``history`` tokens; only turns that are
new in a window are targets, so every assistant text is learned once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.functions.numbering import running_total
from docstrata.llm.common import ship_package
from docstrata.llm.packing import TextEncoder
from docstrata.llm.pretoken import grouped

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TARGET = "assistant"


@dataclass(frozen=True)
class Budget:
    """Tokens of a window: for what is new in it, for repeated turns, and for the system turn."""

    room: int = 1408
    history: int = 384
    system: int = 256

    @property
    def total(self) -> int:
        return self.room + self.history + self.system


def escape(text: str) -> str:
    """One more backslash between ``<`` and ``|``, so that no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it stands in a window, and where its text begins and ends there."""
    head = START + escape(role).replace("\n", LINE) + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape(role.replace(LINE, "\n")), unescape(rest.rpartition(END)[0])))
    return turns


@lru_cache(maxsize=2)
def _encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def _written(conversations: DataFrame, path: str, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, raw, body, lead, tail, tokens): every turn as it is written, with its number of tokens."""
    ship_package(conversations.sparkSession)
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for part, texts in grouped(batches, "raw"):
            made = [write_turn(r, t) for r, t in zip(part.column("role").to_pylist(), texts, strict=True)]
            bodies = [m[0] for m in made]
            yield pa.RecordBatch.from_pydict(
                {
                    "conv": part.column("conv"),
                    "turn": part.column("turn"),
                    "role": part.column("role"),
                    "body": pa.array(bodies, pa.string()),
                    "lead": pa.array([m[1] for m in made], pa.int32()),
                    "tail": pa.array([m[2] for m in made], pa.int32()),
                    "tokens": pa.array([len(ids) for ids in encode(bodies)], pa.int64()),
                }
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"conv {kinds['conv']}, turn {kinds['turn']}, role string, body string, lead int, tail int, tokens bigint")


WINDOW = "conv {conv}, at bigint, text string, tokens bigint, turns int, repeated int, loss array<struct<begin:bigint,end:bigint>>, over boolean"


def windows_of(turns: list[dict], system: dict | None, budget: Budget) -> Iterator[dict]:
    """The windows that begin in one stretch of a conversation.

    ``turns`` ascend by ``at``: the stretch's own turns, and before them those near enough to be repeated.
    All own turns but the last end within the stretch; if the last does not fit in with them it is a window
    of its own.
    """
    own = [t for t in turns if t["own"]]
    last = own[-1]
    crossing = len(own) > 1 and last["at"] + last["tokens"] - own[0]["at"] > budget.room
    for new in (own[:-1], [last]) if crossing else (own,):
        begin = new[0]["at"]
        again = [t for t in turns if t["at"] < begin and t["at"] >= begin - budget.history and not (t["at"] == 0 and system is not None)]
        if system is not None and begin > 0:
            again = [system, *again]
        size, loss = 0, []
        for k, t in enumerate([*again, *new]):
            if k >= len(again) and t["role"] == TARGET:
                loss.append({"begin": size + t["lead"], "end": size + t["tail"]})
            size += len(t["body"])
        tokens = sum(t["tokens"] for t in (*again, *new))
        yield {
            "at": begin, "text": "".join(t["body"] for t in (*again, *new)), "tokens": tokens, "turns": len(again) + len(new), "repeated": len(again), "loss": loss,
            "over": tokens > budget.total,
        }


def format_windows(
    conversations: DataFrame, path: str, budget: Budget = Budget(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per window: conv, at, text, tokens, turns, repeated, loss, over.

    ``path`` is a vocabulary that every executor can open.  ``at`` orders a conversation's windows: the tokens of its
    turns before the window's new ones.  The first ``repeated`` of the window's ``turns`` stand in earlier windows too:
    the leading system turn, then turns that begin at most ``history`` tokens before.  ``loss`` are spans of code
    points of ``text``: the texts of new assistant turns.  A window has ``budget.total`` tokens at most, unless a turn alone has more
    than ``room`` or the system turn more than ``system``: turns are never cut, and ``over`` says so.

    Turns go by ``turn`` (null first), then by role and text.  Null texts and roles are empty; rows with a null
    conversation are one conversation; repeated rows are turns each; other columns are ignored; an empty table
    gives no windows.  Stretches are groups of bounded size, and prefix sums are taken by ranges, so a
    conversation may hold any share of the rows.
    """
    written = _written(conversations, path, conv, turn, role, text)
    placed = running_total(written, "tokens", ["turn", "role", "body"], ["conv"], name="at")
    # A turn is wanted where it begins and where a window may begin that repeats it.
    stretch = lambda x: F.floor(x / F.lit(budget.room))
    spread = placed.withColumn("cell", F.explode(F.sequence(stretch(F.col("at")), stretch(F.col("at") + budget.history))))
    row = F.struct("at", "tokens", "role", "body", "lead", "tail", (F.col("cell") == stretch(F.col("at"))).alias("own"))
    cells = spread.groupBy("conv", "cell").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.bool_or(row["own"]).alias("any")).filter("any").drop("any")
    system = placed.filter("at = 0 AND role = 'system'").select(F.col("conv").alias("s_conv"), F.struct("at", "tokens", "role", "body", "lead", "tail").alias("system"))
    cells = cells.join(system, F.col("conv").eqNullSafe(F.col("s_conv")), "left").select("conv", "rows", "system")
    kind = written.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made, which = [], []
                for n, (rows, lead) in enumerate(zip(part.column("rows").to_pylist(), part.column("system").to_pylist(), strict=True)):
                    found = list(windows_of(rows, lead, budget))
                    made += found
                    which += [n] * len(found)
                fields = {"at": pa.int64(), "text": pa.string(), "tokens": pa.int64(), "turns": pa.int32(), "repeated": pa.int32(), "loss": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), "over": pa.bool_()}
                columns = {name: pa.array([w[name] for w in made], t) for name, t in fields.items()}
                yield pa.RecordBatch.from_pydict({"conv": part.column("conv").take(pa.array(which, pa.int64()))} | columns)

    out = cells.mapInArrow(run, WINDOW.format(conv=kind))
    return out.withColumnRenamed("conv", conv)


class _Digest:
    """What is read back of one conversation, window by window."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = 0

    def add(self, text: str, repeated: int, loss: list[dict]) -> None:
        for role, said in read_turns(text)[repeated:]:
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for span in loss:
            target = unescape(text[span["begin"] : span["end"]])
            self.loss.update(target.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(target)
        self.formatted += len(text)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation's windows.

    A digest needs its conversation's windows in order; they pass through one task, which keeps one batch of
    them and the state of the digest, never the conversation.
    """
    ship_package(windows.sparkSession)
    kind = windows.schema[conv].dataType.simpleString()
    rows = windows.select(F.col(conv).alias("conv"), "at", "text", "repeated", "loss").repartition("conv").sortWithinPartitions("conv", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = (None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        now, conv_type = None, pa.null()

        def out(done: list[_Digest]) -> pa.RecordBatch:
            columns = zip(*(d.row() for d in done), strict=True)
            return pa.RecordBatch.from_pydict({n: pa.array(list(c), t or conv_type) for n, c, t in zip(names, columns, kinds, strict=True)})

        for batch in batches:
            conv_type, done = batch.schema.field("conv").type, []
            for r in batch.select(["conv", "text", "repeated", "loss"]).to_pylist():
                if now is None or now.conv != r["conv"]:
                    if now is not None:
                        done.append(now)
                    now = _Digest(r["conv"])
                now.add(r["text"], r["repeated"], r["loss"])
            if done:
                yield out(done)
        if now is not None:
            yield out([now])

    out = rows.mapInArrow(run, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return out.withColumnRenamed("conv", conv)
