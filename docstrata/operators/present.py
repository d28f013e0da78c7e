"""What panels and logs show of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP_FREQUENT = 0.75
SECTION_LABELS = {
    "contact": "Contact", "summary": "Summary", "education": "Education", "experience": "Experience", "skills": "Skills",
    "projects": "Projects", "certifications": "Certifications", "awards": "Awards", "publications": "Publications",
    "languages": "Languages", "interests": "Interests", "references": "References", "other": "Other",
}
SEVERITY_LABELS = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low"}


def score_tone(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def gap_label(importance: Column) -> Column:
    return F.when(importance >= GAP_FREQUENT, "frequent").otherwise("occasional")


def _label(names: dict[str, str], value: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def section_label(kind: Column) -> Column:
    return _label(SECTION_LABELS, kind)


def severity_label(severity: Column) -> Column:
    return _label(SEVERITY_LABELS, severity)


def evidence_counts(skills: DataFrame, key: str = "doc_id") -> DataFrame:
    return skills.groupBy(key).agg(F.count_if(F.col("evidence") == "demonstrated").alias("demonstrated"), F.count_if(F.col("evidence") == "claimed").alias("claimed"))


def check_counts(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    return judged.groupBy(key).agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def job_description(text: Column) -> Column:
    """Trimmed; null if blank."""
    return F.nullif(F.trim(text), F.lit(""))


def normalised_error(status: Column, code: Column, message: Column, known: tuple[str, ...]) -> Column:
    """What a proxy passes on: a known error as it is, anything else as an internal one, no answer as 502."""
    whole = code.isin(*known) & message.isNotNull()
    return F.struct(
        F.when(status.isNull(), 502).otherwise(status).alias("status"),
        F.when(status.isNotNull() & whole, code).otherwise("internal_error").alias("code"),
    )


#: The path that health checks ask for; they are not logged.
HEALTH_PATH = "/v1/health"


def logged_requests(requests: DataFrame, path: str = "path") -> DataFrame:
    """Requests that belong into the log: all but health checks."""
    return requests.filter(~F.col(path).eqNullSafe(F.lit(HEALTH_PATH)))


# The names of the columns are fixed.
def log_shape(result: DataFrame) -> DataFrame:
    """One row of numbers and flags per analysed document, with none of its content."""
    other = lambda labelled: F.size(F.filter("sections", lambda s: (s["kind"] == "other") & (s["heading"].isNotNull() if labelled else s["heading"].isNull())))
    return result.select(
        "doc_id",
        F.col("document.page_count").alias("pages"), F.col("document.word_count").alias("words"), F.col("document.column_count").alias("columns"),
        F.col("document.has_tables").alias("has_tables"), F.col("document.has_images").alias("has_images"),
        F.col("document.text_in_header_footer").alias("running_furniture"), F.size("document.font_families").alias("font_count"),
        F.transform("sections", lambda s: s["kind"]).alias("sections"), "missing_sections",
        other(True).alias("unrecognised_headings"), other(False).alias("unlabelled_blocks"),
        F.size("skills").alias("skills_found"), F.col("ats.score").alias("ats_score"),
        F.transform(F.filter("ats.checks", lambda c: ~c["passed"]), lambda c: c["check_id"]).alias("failed_checks"),
        F.size("fit.predictions").alias("roles_predicted"), "rubric_version",
    )
