"""Grouping of spelling variants by a frontier that walks a trie held as a relation.

The trie of all words, and that of all words read backwards, are one table of edges: (node, label, child,
word that ends at the child).  Prefixes that neither branch nor end a word are folded into labels.  A state is
(word, position, node, edits); all states are joined with the edges level by level.  A state without an edit
tries every edge of its node, exactly or with one letter more, fewer or other; one with an edit takes
the edge of its next letter alone.  Where a state with one edit ends with its word at the end of another word,
that is a neighbour.  An edit in the second half of a word leaves its first half as it is, and one in the
first half the second: the walk starts in the middle of the word, once in each trie, where few words are left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import release, ship_package, stored

MIN_LENGTH, MIN_COUNT = 7, 2
#: A form occurs so many times as often as its variant, at least.
TIMES = 10
#: One run in so many loses a letter.
EVERY = 31

# Fixed: a run's letters, and the letters that a lowered run may have.
RUN = "[A-Za-zÀ-ÿ]"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Different words from which on a task passes on what it has counted.
HELD = 1 << 18
#: The bit of a word's end in the mask of letters.
END = f"{1 << 62}L"
#: Masks of 64 bits that tell which rests of words cannot stand below a node.
MARKS = 3
_NEXT = ("low", "high", *[f"mark{k}" for k in range(MARKS)])
#: Seeds of the two tries, and an odd factor with bits all over.
_SEEDS, _FACTOR, _MASK = (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127), 0x9E3779B97F4A7C15, (1 << 64) - 1


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, held: int = HELD) -> DataFrame:
    """(word, n): lowered runs of letters, some of which have lost a letter by a hash of id and run.

    A null text has no runs; a null id is written as nothing.  A task counts before it passes words on, at most ``held``
    different ones and those of one more text.
    """
    ship_package(docs.sparkSession)
    # Shorter runs cannot give a word, since runs only lose letters.
    pattern = re.compile(RUN + f"{{{min_length},}}")

    def flushed(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            for d, text in zip(batch.column("d"), batch.column("body"), strict=True):
                begun = zlib.crc32(f"{d.as_py()}:".encode())
                for word, n in Counter(pattern.findall(text.as_py().translate(LOWER).decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    found[word] = found.get(word, 0) + n
                if len(found) >= held:
                    yield flushed(found)
                    found = {}
        yield flushed(found)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.col(text_col).cast("binary").alias("body")).filter("body IS NOT NULL")
    words = texts.mapInArrow(run, "word string, n bigint").filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _with_nodes(words: DataFrame, root: int) -> DataFrame:
    """(way, word, n, nodes): each word as it is and backwards, with a hash of each prefix from ``root`` letters on."""
    ship_package(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for way in (0, 1):
                told, nodes, sizes = [], [], [0]
                for word in batch.column("word").to_pylist():
                    word = word[::-1] if way else word
                    h = _SEEDS[way]
                    for k, c in enumerate(word, 1):
                        h = ((h ^ ord(c)) * _FACTOR) & _MASK
                        h ^= h >> 32
                        if k >= root:
                            nodes.append(h - (1 << 64) if h >> 63 else h)
                    told.append(word)
                    sizes.append(len(nodes))
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()))
                yield pa.RecordBatch.from_pydict({"way": pa.array([way] * len(told), pa.int8()), "word": pa.array(told, pa.string()), "n": batch.column("n"), "nodes": lists})

    return words.select("word", "n").mapInArrow(run, "way tinyint, word string, n bigint, nodes array<bigint>")


def _bit(letter: Column) -> tuple[Column, Column]:
    """A letter's bit in the mask of a-z (whose bit 62 is the end of a word) and in that of the others."""
    code = F.ascii(letter)
    low = F.when(letter == "", F.lit(1 << 62)).when(code < 128, F.expr("shiftleft(1L, code - 97)")).otherwise(F.lit(0))
    return low.cast("bigint"), F.when(code >= 128, F.expr("shiftleft(1L, code - 192)")).otherwise(F.lit(0).cast("bigint"))


def _mark(h: Column) -> tuple[Column, Column]:
    """The place of a rest of a word, by its hash: which of ``MARKS`` masks, and its bit there."""
    return F.pmod(h, F.lit(MARKS)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int"))


def _marks(h: Column) -> list[Column]:
    """A rest of a word, by its hash, as one bit in ``MARKS`` masks; a node's masks hold those of all words below it."""
    which, bit = _mark(h)
    return [F.when(which == k, bit).otherwise(F.lit(0).cast("bigint")) for k in range(MARKS)]


@dataclass(frozen=True)
class Trie:
    """Stored tables: the words' ways through the trie, its edges, and the words that end at its nodes."""

    path: DataFrame
    edges: DataFrame

    def ends(self) -> DataFrame:
        """(node, near, near_n) of the nodes where words end."""
        last = self.path.filter(F.col("depth") == F.length("word"))
        return last.select("node", F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word")).alias("near"), F.col("n").alias("near_n"))


def build_trie(words: DataFrame, root: int) -> Trie:
    """The trie of ``words(word, n)`` and that of the words backwards, below their first ``root`` letters.

    ``path`` has a row for each word and each node of its that is kept: way, word, n, depth, node, and the
    word's next kept node (child, child_depth).  Kept are prefixes of ``root`` letters, those that branch
    and those that are words.  ``edges`` has a row per edge and step: under an empty step for states without an
    edit, under its first letter for those with one; with it go the letters behind the child (low, high) and marks
    of the rests below it.  Nodes are told by 64-bit hashes: two prefixes with one hash become one node,
    whose further candidates the last comparison of words drops.
    """
    hashed = stored(_with_nodes(words, root), "prefixes")
    steps = hashed.select("way", "word", "n", F.posexplode("nodes").alias("k", "node"))
    steps = steps.select("way", "word", "n", (F.col("k") + root).alias("depth"), "node")
    lettered = steps.select("node", "depth", F.substring(F.col("word"), F.col("depth") + 1, F.length("word")).alias("rest")).withColumns({"code": F.ascii("rest"), "h": F.xxhash64("rest")})
    masks = zip(_NEXT, [*_bit(F.substring("rest", 1, 1)), *_marks(F.col("h"))], strict=True)
    nodes = lettered.groupBy("node").agg(*[F.bit_or(m).alias(c) for c, m in masks], F.min("depth").alias("least"))
    kept = nodes.filter((F.col("least") == root) | (F.bit_count("low") + F.bit_count("high") > 1) | F.expr(f"low & {END} <> 0")).drop("least")
    kept = stored(kept, "nodes")
    # A word has no more kept nodes than letters, so its window is bounded.  Rows are sorted by the hash first, which
    # is compared as a number, unlike the words.
    after = lambda c: F.expr(f"lead({c}) OVER (PARTITION BY xxhash64(word), word, way ORDER BY depth)").alias
    path = steps.join(kept.select("node"), "node", "left_semi")
    path = stored(path.select("way", "word", "n", "depth", "node", after("node")("child"), after("depth")("child_depth")), "trie")
    label = F.substring(F.col("word"), F.col("depth") + 1, F.col("child_depth") - F.col("depth"))
    edges = path.filter("child IS NOT NULL").select("node", "child", label.alias("label")).distinct().join(kept.withColumnRenamed("node", "child"), "child")
    step = F.explode(F.array(F.lit(""), F.substring("label", 1, 1)))
    edges = stored(edges.select("node", step.alias("step"), "label", "child", *_NEXT), "edges")
    release(hashed, kept)
    return Trie(path, edges)


def neighbours(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, near, near_n) of every two words of ``words(word, n)`` that one edit parts, both ways round.

    Words are distinct and have ``min_length`` letters at least.  There are as many rounds as kept nodes on the
    longest way from a word's middle to its end; the frontier is written after each.
    """
    trie = build_trie(words, max(1, min_length // 2))
    # An edit with fewer letters before it than half of them, rounded down, has half of them, rounded up, behind it.
    middle = F.floor((F.length("word") + F.col("way")) / 2)
    # A word starts at its last kept node up to there: the next one lies behind the middle.
    states = trie.path.filter((F.col("depth") <= middle) & F.coalesce(F.col("child_depth") > middle, F.lit(True)))
    states = states.select("way", "word", F.col("depth").alias("at"), "node", F.lit(0).alias("edits"))
    levels = []
    while True:
        levels.append(stored(_advance(states, trie.edges), "frontier"))
        states = levels[-1].filter("NOT met").drop("met")
        if states.isEmpty():
            break
    release(trie.edges)
    ended = reduce(DataFrame.unionByName, [level.filter("met").select("way", "word", "node") for level in levels])
    pairs = ended.join(trie.ends(), "node").select(F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word")).alias("word"), "near", "near_n")
    # One pair may be met in both tries, and by edits of equal letters side by side.  Dealt by word, pairs need no
    # other shuffle, here or where they are counted by word.
    return pairs.filter(F.levenshtein("word", "near", 1) == 1).repartition("word").distinct()


def _advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further: those that go on, and (``met``) those that have come to the end of another word."""
    rest = lambda k, skip=0: F.substring(F.col("word"), F.col("at") + 1 + skip, k)
    met = states.withColumn("step", F.when(F.col("edits") == 0, "").otherwise(rest(F.lit(1)))).join(edges, ["node", "step"])
    m, length = F.length("label"), F.length("word")
    below, begins = F.substring(F.col("label"), F.lit(2), m), F.substring("label", 1, 1) == rest(F.lit(1))

    def goes(k: Column, edits: int, fits: Column) -> Column:
        at = F.col("at") + k
        # What must stand below the node is asked of states with an edit alone.
        behind = F.xxhash64(F.substring(F.col("word"), at + 1, length)) if edits else F.lit(0).cast("bigint")
        return F.when((at <= length) & fits, F.struct(at.alias("at"), F.lit(edits).alias("edits"), behind.alias("h")))

    def one(k: Column, after: Column) -> Column:
        """One edit between label and rest; where their first letters differ, it is there, and ``after`` tells if all else is equal."""
        return (F.col("edits") == 0) & F.when(begins, F.levenshtein("label", rest(k), 1) == 1).otherwise(after)

    same = rest(m) == F.col("label")
    tries = F.array(
        goes(m, 0, (F.col("edits") == 0) & begins & same), goes(m, 1, (F.col("edits") == 1) & same),
        goes(m - 1, 1, one(m - 1, below == rest(m - 1))), goes(m, 1, one(m, below == rest(m - 1, 1))), goes(m + 1, 1, one(m + 1, F.col("label") == rest(m, 1))),
    )
    moved = met.select("way", "word", F.explode_outer(tries).alias("s"), "child", *_NEXT).filter("s IS NOT NULL")
    moved = moved.select("way", "word", "s.at", "s.edits", "s.h", F.col("child").alias("node"), *_NEXT)
    over = F.col("at") == length
    # With an edit spent, only the rest as it is may follow; without one, anything that the node has.
    which, bit = _mark(F.col("h"))
    held = reduce(lambda found, k: found.when(which == k, F.col(f"mark{k}")), range(1, MARKS), F.when(which == 0, F.col("mark0"))).bitwiseAND(bit) != 0
    on = F.when(F.col("edits") == 1, ~over & held).otherwise(F.expr(f"(low & ~{END}) <> 0 OR high <> 0"))
    met = (F.col("edits") == 1) & over & F.expr(f"low & {END} <> 0")
    return moved.filter(on | met).select("way", "word", "at", "node", "edits", met.alias("met"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following ``forms(word, form)`` to the last; a form is ``TIMES`` as frequent as its variant at least.

    Each round doubles the way that is followed, so that five do for any counts below 2^63.
    """
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        ahead = now.select(F.col("word").alias("mid"), F.col("root").alias("far"))
        step = stored(now.join(ahead, now["root"] == ahead["mid"], "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per word of the texts: word, form, root, n, n_near, form_n.

    ``form`` is the most frequent neighbour (the smallest of equal ones in code-point order) if it occurs
    ``TIMES`` as often as the word at least, ``root`` the last form of the chain, the word itself without a form.
    Null and empty texts add nothing; repeated rows count each time; other columns are ignored; an empty
    table gives an empty result.
    """
    words = stored(word_counts(docs, id_col, text_col), "words")
    pairs = neighbours(words)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    rated = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("b.less") >= TIMES * F.col("n"), -F.col("b.less")))
    rated = stored(rated.select("word", F.when(F.col("form_n").isNotNull(), F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"), "variants")
    last = roots(rated.filter("form IS NOT NULL"))
    return rated.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
