"""Building a skill taxonomy from exported occupation and technology lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.functions.numbering import numbered
from docstrata.functions.text import slug, stripped, words

STRICT_LENGTH, MIN_LENGTH, MAX_WORDS = 2, 2, 5


def usable_name(name: Column) -> Column:
    """Not blank, not a lone sign, at most five words."""
    alone = (F.length(name) < MIN_LENGTH) & ~name.rlike(r"^\p{L}+$")
    return ~alone & (F.size(words(name)) <= MAX_WORDS) & (stripped(name) != "")


def _entries(rows: DataFrame, name: Column, category: Column, default: str, aliases: Column, prefix: str) -> DataFrame:
    rows = rows.select("input_ord", stripped(F.coalesce(name, F.lit(""))).alias("name"), stripped(F.coalesce(category, F.lit(""))).alias("category"), aliases.alias("aliases"))
    rows = rows.filter((F.col("name") != "") & usable_name(F.col("name")))
    return rows.select(
        "input_ord", "name", F.concat(F.lit(prefix + ":"), slug("name")).alias("skill_id"),
        F.when(F.col("category") == "", default).otherwise(F.col("category")).alias("category"),
        F.array_except("aliases", F.array("name")).alias("aliases"), (F.length("name") <= STRICT_LENGTH).alias("strict"),
    )


def from_occupations(rows: DataFrame) -> DataFrame:
    """``rows(input_ord, preferredLabel, skillType, altLabels)``; alternative labels split at line ends and bars."""
    parts = F.transform(F.split(F.coalesce("altLabels", F.lit("")), r"[\r\n|]+"), stripped)
    aliases = F.array_distinct(F.filter(parts, lambda a: (a != "") & usable_name(a)))
    return _entries(rows, F.col("preferredLabel"), F.col("skillType"), "skill", aliases, "esco")


def from_technologies(rows: DataFrame) -> DataFrame:
    """``rows(input_ord, Example, Commodity Title)``."""
    return _entries(rows, F.col("Example"), F.col("Commodity Title"), "Technology", F.array().cast("array<string>"), "onet")


def merge(entries: DataFrame) -> DataFrame:
    """One row per skill id: the first entry's name, category and strictness, and everyone's aliases."""
    first = F.min(F.struct("input_ord", "name", "category", "strict")).alias("f")
    merged = entries.groupBy("skill_id").agg(first, F.sort_array(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
    return merged.select("skill_id", "f.name", "f.category", "f.strict", "aliases", "f.input_ord")


def build(occupations: DataFrame, technologies: DataFrame, limit: int | None = None) -> DataFrame:
    """The taxonomy of both lists: where they share a skill, the occupation list's entry comes first."""
    entries = [from_occupations(occupations), from_technologies(technologies)]
    first, second = (e.withColumn("input_ord", F.struct(F.lit(k).alias("list"), "input_ord")) for k, e in enumerate(entries))
    return ordered(merge(first.unionByName(second)), limit)


def ordered(merged: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries with ``entry_ord`` by category and lower-case name, the first ``limit`` of them.

    Numbers are given range by range, so no task sorts the whole taxonomy.
    """
    rows = numbered(merged, ["category", F.lower("name"), "input_ord"], "entry_ord").withColumn("entry_ord", F.col("entry_ord").cast("int"))
    return rows if limit is None else rows.filter(F.col("entry_ord") < limit)
