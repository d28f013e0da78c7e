"""A weighted rubric of boolean checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.functions.text import rounded


def checks(rows: DataFrame, outcomes: dict[str, Column], rubric: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and check of the rubric: key, check_ord, check_id, label, passed, weight, severity, explanation."""
    flat = F.array(*[F.struct(F.lit(k).alias("check_id"), v.alias("passed")) for k, v in outcomes.items()])
    long = rows.select(key, F.inline(flat))
    explained = F.when(F.col("passed"), F.col("passed_text")).otherwise(F.col("failed_text"))
    return long.join(rubric, "check_id").select(key, "check_ord", "check_id", "label", "passed", "weight", "severity", explained.alias("explanation"))


def score(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, score): earned weight over available weight, in percent with one digit.

    Weights are summed as exact decimals.
    """
    weight = F.col("weight").cast("decimal(18,6)")
    earned, available = F.sum(F.when(F.col("passed"), weight).otherwise(F.lit(0).cast("decimal(18,6)"))), F.sum(weight)
    share = earned.cast("double") / F.nullif(available.cast("double"), F.lit(0.0)) * 100
    return judged.groupBy(key).agg(rounded(share, 1).alias("score"))


def document_outcomes(max_pages: int = 1) -> dict[str, Column]:
    """The six checks over document statistics and section flags."""
    return {
        "machine_readable_text": F.col("character_count") > 0,
        "single_column_layout": F.col("column_count") == 1,
        "no_layout_tables": F.col("table_count") == 0,
        "text_outside_header_footer": ~F.col("text_in_header_footer"),
        "recognisable_section_headings": F.col("headings_recognised"),
        "appropriate_length": F.col("page_count") <= max_pages,
    }


def headings_recognised(sections: Column) -> Column:
    """Of a document's sections (array of structs), something was labelled and nothing of kind ``other`` was."""
    labelled = F.filter(sections, lambda s: s["heading"].isNotNull())
    return (F.size(labelled) > 0) & ~F.exists(labelled, lambda s: s["kind"] == "other")
