"""Byte-pair encoding and decoding by prefix dynamic programming.

For each prefix of a piece there is exactly one token that a valid encoding of that prefix ends with:
the token whose neighbour on the left, the last token of what remains, may stand before it.  The
encoder stores that token for each byte, so encodings are read backwards from any prefix, appending
bytes never changes what is stored, and after an edit only bytes near it are computed again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import ship_package
from docstrata.llm.pretoken import PieceEncoder, grouped

#: Token pairs whose neighbourhood a worker remembers; beyond, it forgets all and goes on.
PAIRS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixEncoder:
    """Encodes single pieces; ``last`` tables allow exact appends and local re-encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.usable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                self.usable[token] = rank
            elif (two := self._halves_of(token, rank)) is not None:
                self.halves[rank] = two
                self.merged[two] = rank
                self.usable[token] = rank
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.usable.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    def _halves_of(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last two parts that merges of lower rank leave of a token; None if they never meet."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], rank))
            if self.ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` as they are when they stand side by side.

        The later formed of the two is taken apart until its outer half is a byte; a merge across the
        border that would have come before the current step shows that the pair cannot survive.
        """
        limit = len(self.tokens)
        merged, halves = self.merged, self.halves
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (one token for each byte done so far) up to the whole piece, in place.

        The automaton names the tokens that end at each byte, the longest first.
        """
        done = len(last)
        if done == len(piece):
            return last
        base = max(0, done + 1 - self.longest)
        last += [-1] * (len(piece) - done)
        known = self.known
        for end, (token, size) in self.automaton.iter(piece[base:].decode("latin-1")):
            end += base
            if last[end] < 0:
                begin = end + 1 - size
                if begin == 0:
                    last[end] = token
                    continue
                pair = (last[begin - 1] << 20) | token
                ok = known.get(pair)
                if ok is None:
                    if len(known) > PAIRS:
                        known.clear()
                    ok = known[pair] = self.may_follow(last[begin - 1], token)
                if ok:
                    last[end] = token
        return last

    def edit(self, piece: bytes, last: list[int], begin: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The piece with ``[begin, end)`` replaced, and its table; only bytes near the edit are done again.

        What is stored for a byte depends on the ``longest`` bytes and tokens before it, so once that
        many tokens behind the edit are as they were, the rest is too.
        """
        edited = piece[:begin] + new + piece[end:]
        table, shift, same = last[:begin], len(new) - (end - begin), 0
        while len(table) < len(edited):
            self.extend(edited[: len(table) + 1], table)
            at = len(table) - 1
            old = at - shift
            same = same + 1 if at >= begin + len(new) and last[old] == table[at] else 0
            if same >= self.longest:
                table += last[old + 1 :]
                break
        return edited, table

    def read(self, last: list[int]) -> list[int]:
        """The encoding of the prefix that ``last`` covers."""
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is itself a token is that token; any other goes through the prefix table."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.extend(piece, []))

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[PrefixEncoder, PieceEncoder]:
    own = PrefixEncoder(read_ranks(path))
    return own, PieceEncoder(own.encode)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256, and the ids if ``with_ids``.

    ``path`` is a rank file that every executor can open.  Null and empty texts have no tokens; rows
    that repeat an id are encoded each; other columns are ignored.  A worker holds the vocabulary, a
    bounded cache of pieces and one group of texts.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, encoder = _encoder(path)
        for part, texts in grouped(batches, "body"):
            encoded = encoder(texts)
            columns = {
                "id": part.column("id"),
                "n_tokens": pa.array([len(ids) for ids in encoded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in encoded], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(own.decode(ids.tolist())).hexdigest() for ids in encoded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([ids.astype(np.int32) for ids in encoded], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
