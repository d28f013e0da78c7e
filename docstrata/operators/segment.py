"""Sections of documents from their ordered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.text import excerpt, heading_norm, is_upper_case, stripped, word_count

MAX_HEADING_WORDS = 6
TITLE_RATIO, HEADING_RATIO, LARGE_RATIO = 2.0, 1.25, 1.15
MIN_UNLABELLED_WORDS = 10
MAX_EXCERPT = 200


def looks_like_heading(text: Column, size: Column, bold: Column, upper: Column, median: Column) -> Column:
    """Typography of a heading: not a sentence, not the title, larger than the body or set apart in capitals."""
    at_least = lambda ratio: (median > 0) & (size >= median * ratio)
    return (
        F.when(stripped(text).rlike(r"[.,;:]$"), False).when(at_least(TITLE_RATIO), False).when(at_least(HEADING_RATIO), True).otherwise(upper & (bold | at_least(LARGE_RATIO)))
    )


def with_measures(lines: DataFrame) -> DataFrame:
    """``lines`` (schema LINES) with words, capitals and the document's median font size.

    Words and capitals that ``layout.lines`` has found are taken.
    """
    measured = "word_count" in lines.columns and "is_upper_case" in lines.columns
    lines = lines.withColumn("text", stripped("text")).withColumn("words", F.col("word_count") if measured else word_count("text")).withColumn("upper", F.col("is_upper_case") if measured else is_upper_case("text"))
    return lines.withColumn("median", F.coalesce(F.median(F.when(F.col("text") != "", F.col("max_font_size"))).over(Window.partitionBy("doc_id")), F.lit(0.0)))


def find_headings(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """``lines`` with ``heading_kind``: a known alias's kind, ``other`` by typography, else null."""
    known = aliases.select(F.col("alias").alias("norm"), F.col("kind").alias("known"))
    candidate = F.col("words").between(1, MAX_HEADING_WORDS)
    rows = with_measures(lines).withColumn("norm", F.when(candidate, heading_norm("text"))).join(known, "norm", "left")
    typographic = looks_like_heading(F.col("text"), F.col("max_font_size"), F.col("is_bold"), F.col("upper"), F.col("median"))
    kind = F.when(candidate, F.coalesce("known", F.when(typographic, F.lit("other"))))
    return rows.withColumn("heading_kind", kind).drop("norm", "known")


def _owned(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lines with the start that owns them: ``start`` (line index, null for the contact block) and its kind."""
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("line_index")
    rows = find_headings(lines, aliases)
    first = F.min(F.when(F.col("heading_kind") != "other", F.col("line_index"))).over(doc)
    rows = rows.withColumn("first", first)
    rows = rows.withColumn("heading_kind", F.when(F.col("line_index") >= F.coalesce("first", F.lit(0)), F.col("heading_kind"))).drop("first")
    # A column that starts without a heading is a section of its own if enough words follow.
    rows = rows.withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("total", F.sum("words").over(doc))
    # Read backwards: a frame that ends with the document would be summed anew for every line.
    after = doc.orderBy(F.desc("line_index")).rowsBetween(Window.unboundedPreceding, -1)
    # The next heading's running sum is the smallest among the headings that follow, since sums only grow.
    words_until = F.coalesce(F.min(F.when(F.col("heading_kind").isNotNull(), F.col("before"))).over(after), F.col("total"))
    unlabelled = F.col("is_column_start") & F.col("heading_kind").isNull() & (words_until - F.col("before") >= MIN_UNLABELLED_WORDS)
    rows = rows.withColumn("start_kind", F.coalesce("heading_kind", F.when(unlabelled, F.lit("other"))))
    start = F.last(F.when(F.col("start_kind").isNotNull(), F.col("line_index")), ignorenulls=True).over(order)
    kind = F.last("start_kind", ignorenulls=True).over(order)
    rows = rows.withColumn("start", start).withColumn("kind", F.coalesce(kind, F.lit("contact")))
    return rows.withColumn("is_heading", F.col("heading_kind").isNotNull()).drop("before", "total")


def sections(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per section of a document, in order.

    Columns: doc_id, section_ord, kind, heading, page, line_start, line_end, excerpt, word_count.  Of a
    kind that returns the first place and heading stay and the words add up; ``other`` never merges.  A
    start without a body has page 1 and lines 0 to 0.
    """
    return sections_with_bodies(lines, aliases).drop("body")


def sections_with_bodies(lines: DataFrame, aliases: DataFrame, facts: Sequence[str] = ()) -> DataFrame:
    """``sections`` with ``body``, the text of lines ``line_start`` to ``line_end``; null without words.

    ``facts`` are columns that all lines of a document share; its sections keep them.
    """
    kept = [F.first(c).alias(c) for c in facts]
    rows = _owned(lines, aliases)
    own_heading = F.coalesce(F.col("is_heading") & (F.col("line_index") == F.col("start")), F.lit(False))
    body = ~own_heading
    own = Window.partitionBy("doc_id", "start", "kind").orderBy("line_index")
    begun = F.max(F.when(body & (F.col("text") != ""), F.lit(1))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("size", F.when(body & begun.isNotNull(), F.length("text") + 1))
    rows = rows.withColumn("at", F.when(F.col("size").isNotNull(), F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # Lines that begin within the excerpt, and a sign for text beyond them: a section of any length gives a short row.
    needed = F.when(F.col("at") < MAX_EXCERPT, F.struct("line_index", F.substring("text", 1, MAX_EXCERPT).alias("text")))
    # Lines have no blanks at their ends, so a line that ends behind the excerpt has a letter there.
    beyond = F.coalesce(F.max(F.when((F.col("at") + F.length("text") > MAX_EXCERPT) & (F.col("text") != ""), F.lit("…"))), F.lit(""))
    shown = F.array_join(F.transform(F.sort_array(F.collect_list(needed)), lambda t: t["text"]), " ")
    built = rows.groupBy("doc_id", "start", "kind").agg(
        F.max(F.when(own_heading, F.col("text"))).alias("heading"),
        F.coalesce(F.min_by("page_number", F.when(body, F.col("line_index"))), F.lit(1)).alias("page"),
        F.coalesce(F.min(F.when(body, F.col("line_index"))), F.lit(0)).alias("line_start"),
        F.coalesce(F.max(F.when(body, F.col("line_index"))), F.lit(0)).alias("line_end"),
        F.coalesce(F.sum(F.when(body, F.col("words"))), F.lit(0)).alias("word_count"),
        # Padded up to the text beyond, so that it counts as longer than an excerpt.
        excerpt(F.when(beyond == "", shown).otherwise(F.concat(F.rpad(shown, MAX_EXCERPT, " "), beyond)), MAX_EXCERPT).alias("excerpt"),
        (F.count_if(body) == 0).alias("bare"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(body, F.struct("line_index", "text")))), lambda t: t["text"]), " ").alias("body"),
        F.max(F.when(F.col("line_index") == 0, F.col("text"))).alias("opening"),
        *kept,
    )
    place = F.coalesce("start", F.lit(-1))
    merge_key = F.when(F.col("kind") == "other", F.concat(F.lit("other:"), place.cast("string"))).otherwise(F.col("kind"))
    one = built.groupBy("doc_id", "kind", merge_key.alias("m")).agg(
        F.min(F.struct(place.alias("place"), "heading", "page", "line_start", "line_end", "excerpt")).alias("f"), F.sum("word_count").alias("word_count"),
        F.min(F.struct(place.alias("place"), "bare", "body")).alias("b"), F.max("opening").alias("opening"), *kept,
    )
    doc = Window.partitionBy("doc_id")
    # Lines 0 to 0 of a start without a body are the document's first line.
    text = F.when(F.col("word_count") > 0, F.when(F.col("b.bare"), F.max("opening").over(doc)).otherwise(F.col("b.body")))
    return one.select(
        "doc_id", (F.row_number().over(doc.orderBy("f.place")) - 1).alias("section_ord"), "kind", "f.heading", "f.page", "f.line_start", "f.line_end", "f.excerpt", "word_count", text.alias("body"), *facts
    )


def missing_sections(found: DataFrame, docs: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, ord, kind) of the expected sections that a document of ``docs`` lacks, in order.

    Every document is expanded by the few expected kinds alone.
    """
    kinds = [(r["ord"], r["kind"]) for r in expected.orderBy("ord").collect()]
    listed = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(k).alias("kind")) for o, k in kinds])
    every = docs.select("doc_id").distinct().select("doc_id", F.inline(listed))
    return every.join(found.select("doc_id", "kind").distinct(), ["doc_id", "kind"], "left_anti").select("doc_id", "ord", "kind")


def joined_bodies(parts: Column) -> Column:
    """The text of a kind from its sections (array of structs with body, in order); empty where none has text."""
    return stripped(F.array_join(F.filter(F.transform(parts, lambda p: p["body"]), lambda b: b != ""), " "))


def section_texts(found: DataFrame) -> DataFrame:
    """``sections_with_bodies`` to (doc_id, section_ord, kind, text): one row per kind that has text."""
    whole = found.filter("body <> ''").groupBy("doc_id", "kind").agg(F.min("section_ord").alias("section_ord"), F.sort_array(F.collect_list(F.struct("section_ord", "body"))).alias("b"))
    return whole.select("doc_id", "section_ord", "kind", joined_bodies(F.col("b")).alias("text"))
