"""Suggestions from failed checks, missing sections and skills without evidence, by severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.schemas import SEVERITIES

NAMED = 3


def severity_ordinal(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def unevidenced_subject(names: Column, n: int = NAMED) -> Column:
    """'A, B, C and 4 more'."""
    rest = F.size(names) - n
    more = F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(names, 1, n), ", "), more)


def from_failed_checks(judged: DataFrame, rubric: DataFrame, key: str = "doc_id") -> DataFrame:
    rows = judged.filter("NOT passed").select(key, "check_id").join(rubric, "check_id")
    return rows.select(key, F.lit(0).alias("source_ord"), F.col("check_ord").alias("item_ord"), F.concat(F.lit("ats."), "check_id").alias("id"), "severity", F.col("fix_title").alias("title"), F.col("fix_detail").alias("detail"), F.lit(None).cast("string").alias("section"))


def from_missing_sections(missing: DataFrame, advice: DataFrame, key: str = "doc_id") -> DataFrame:
    rows = missing.select(key, "kind", "ord").join(advice, "kind")
    return rows.select(key, F.lit(1).alias("source_ord"), F.col("ord").alias("item_ord"), F.concat(F.lit("section."), "kind").alias("id"), "severity", "title", "detail", F.col("kind").alias("section"))


def from_unevidenced_skills(skills: DataFrame, key: str = "doc_id") -> DataFrame:
    """At most one suggestion a document, naming the first claimed skills in their order."""
    claimed = skills.filter("evidence = 'claimed'").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("skill_ord", "name"))).alias("c"))
    names = F.transform("c", lambda c: c["name"])
    return claimed.select(
        key, F.lit(2).alias("source_ord"), F.lit(0).alias("item_ord"), F.lit("skills.unevidenced").alias("id"), F.lit("medium").alias("severity"),
        F.concat(F.lit("Show where you used "), unevidenced_subject(names)).alias("title"),
        F.lit("These are listed but appear in no account of work; name each where it was used.").alias("detail"),
        F.lit("skills").alias("section"),
    )


def advise(judged: DataFrame, rubric: DataFrame, missing: DataFrame, advice: DataFrame, skills: DataFrame, key: str = "doc_id") -> DataFrame:
    """All suggestions with their rank: by severity, then checks, sections, skills, each in its order."""
    rows = from_failed_checks(judged, rubric, key).unionByName(from_missing_sections(missing, advice, key)).unionByName(from_unevidenced_skills(skills, key))
    order = Window.partitionBy(key).orderBy(severity_ordinal(F.col("severity")), "source_ord", "item_ord")
    return rows.select(key, F.row_number().over(order).alias("rank"), "id", "severity", "title", "detail", "section")
