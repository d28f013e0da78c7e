"""The whole analysis: styled spans of many documents to one nested result row each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata import schemas
from docstrata.functions import dims
from docstrata.functions.storage import stored
from docstrata.operators import advise, ats, fit, layout, match, segment
from docstrata.operators.report import report_html, report_lines, report_pages


@dataclass
class Dimensions:
    """What the analysis looks things up in; ``longest`` bounds the words of a surface."""

    surfaces: DataFrame
    aliases: DataFrame
    expected: DataFrame
    section_advice: DataFrame
    roles: DataFrame
    rubric: DataFrame
    longest: int = 4

    @classmethod
    def shipped(cls, spark: SparkSession) -> Dimensions:
        return cls(dims.taxonomy(dims.skills_frame(spark)), dims.heading_aliases(spark), dims.expected_sections(spark), dims.section_advice(spark), dims.role_skills(spark), dims.rubric(spark))


def _gathered(rows: DataFrame, key: str, order: str, name: str, fields: list[str]) -> DataFrame:
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *fields)))
    return rows.groupBy(key).agg(F.transform(packed, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


#: What is read of a span, and what a result tells of a section.
SPAN = ["page_number", "line_seq", "span_seq", "text", "size", "bold", "font", "page_width", "page_height", "line_x0", "line_top", "line_x1", "line_bottom"]
SECTION = ["kind", "heading", "page", "line_start", "line_end", "excerpt", "word_count"]


def _dealt(styled: DataFrame) -> DataFrame:
    """Spans dealt by document, as every later step needs them.

    They travel packed: steps that read different columns of them share one shuffle.
    """
    return styled.groupBy("doc_id").agg(F.collect_list(F.struct(*SPAN)).alias("spans")).select("doc_id", F.inline("spans"))


def _documents(raw_spans: DataFrame, raw_pages: DataFrame, d: Dimensions) -> DataFrame:
    """One row per document of ``raw_pages``: statistics, ``sections`` in order and ``texts``, one per kind.

    Texts are shuffled once, with their spans; all else is done where the document lies.
    """
    styled = _dealt(layout.spans(raw_spans))
    ordered = layout.with_line_statistics(layout.reading_order(layout.lines(styled)))
    # Statistics go along with the sections: lines are put in order once.
    found = segment.sections_with_bodies(ordered, d.aliases, list(layout.LINE_STATISTICS))
    kept = [F.first(c).alias(c) for c in layout.LINE_STATISTICS]
    kinds = found.groupBy("doc_id", "kind").agg(F.sort_array(F.collect_list(F.struct("section_ord", *SECTION, "body"))).alias("parts"), *kept)
    told = F.transform("parts", lambda p: F.struct(*[p[f].alias(f) for f in ["section_ord", *SECTION]]))
    written = F.filter("parts", lambda p: p["body"] != "")
    text = F.struct(F.get(written, 0)["section_ord"].alias("section_ord"), "kind", segment.joined_bodies(written).alias("text"))
    gathered = kinds.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list(told))).alias("told"), F.collect_list(F.when(F.size(written) > 0, text)).alias("texts"), *kept)
    sections = F.transform("told", lambda x: F.struct(*[x[f].alias(f) for f in SECTION]))
    told_of_lines = gathered.select("doc_id", sections.alias("sections"), "texts", *layout.LINE_STATISTICS)
    out = layout.page_statistics(raw_pages, styled).join(told_of_lines, "doc_id", "left").fillna(layout.LINE_STATISTICS)
    return out.withColumnRenamed("words_total", "word_count")


def job_requirements(job_descriptions: DataFrame, d: Dimensions) -> DataFrame:
    """``job_descriptions(doc_id, jd_id, text)`` to the skills that each asks for."""
    return match.mention_counts(job_descriptions, d.surfaces, ["doc_id", "jd_id"], d.longest)


def analyze(raw_spans: DataFrame, raw_pages: DataFrame, d: Dimensions, job_descriptions: DataFrame | None = None) -> DataFrame:
    """One row per document of ``raw_pages``: statistics, sections, skills, score, fit, suggestions.

    ``job_descriptions(doc_id, jd_id, text)`` pairs at most one description with a document.
    """
    documents = stored(_documents(raw_spans, raw_pages, d), "documents")
    found = documents.select("doc_id", F.inline("sections"))
    missing = stored(segment.missing_sections(found, documents, d.expected), "missing")
    skills = stored(match.extract_skills(documents.select("doc_id", F.inline("texts")), d.surfaces, d.longest), "skills")
    facts = documents.withColumn("headings_recognised", F.coalesce(ats.headings_recognised(F.col("sections")), F.lit(False)))
    judged = stored(ats.checks(facts, ats.document_outcomes(), d.rubric), "checks")
    scored = ats.score(judged)
    owned = skills.withColumn("tenths", fit.evidence_tenths())
    roles = fit.top_profiles(owned, d.roles)
    tips = advise.advise(judged, d.rubric, missing, d.section_advice, skills)
    out = documents.drop("texts").join(_gathered(missing, "doc_id", "ord", "missing", ["kind"]), "doc_id", "left")
    out = out.join(_gathered(skills, "doc_id", "skill_ord", "skills", ["name", "skill_id", "category", "evidence", "found_in", "confidence"]), "doc_id", "left")
    out = out.join(_gathered(judged, "doc_id", "check_ord", "checks", ["check_id", "label", "passed", "weight", "severity", "explanation"]), "doc_id", "left")
    out = out.join(scored, "doc_id", "left").join(_gathered(roles, "doc_id", "rank", "predictions", ["role", "confidence"]), "doc_id", "left")
    out = out.join(_gathered(tips, "doc_id", "rank", "suggestions", ["id", "severity", "title", "detail", "section"]), "doc_id", "left")
    if job_descriptions is not None:
        names = d.surfaces.select("skill_id", "name").distinct()
        gaps = fit.gap_analysis(owned, job_requirements(job_descriptions, d), names)
        jd = gaps.select("doc_id", F.struct("similarity", "matched_skills", "missing_skills").alias("jd"))
        out = out.join(jd, "doc_id", "left")
    else:
        out = out.withColumn("jd", F.lit(None).cast("struct<similarity:double,matched_skills:array<string>,missing_skills:array<struct<skill:string,importance:double>>>"))
    full = lambda c: F.coalesce(c, F.slice(F.array(F.lit(None).cast(out.schema[c].dataType.elementType)), 1, 0))
    return out.select(
        "doc_id", F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.lit(schemas.RUBRIC_VERSION).alias("rubric_version"), F.lit(schemas.MODEL_VERSION).alias("model_version"),
        F.struct(
            "page_count", "word_count", "column_count", F.lit(True).alias("machine_readable"), (F.col("table_count") > 0).alias("has_tables"),
            (F.col("image_count") > 0).alias("has_images"), "text_in_header_footer", "font_families",
        ).alias("document"),
        full("sections").alias("sections"), F.transform(full("missing"), lambda m: m["kind"]).alias("missing_sections"), full("skills").alias("skills"),
        F.struct("score", F.lit(schemas.RUBRIC_VERSION).alias("rubric_version"), full("checks").alias("checks")).alias("ats"),
        F.struct(full("predictions").alias("predictions"), F.col("jd").alias("job_description")).alias("fit"), full("suggestions").alias("suggestions"),
    )


def with_stamps(result: DataFrame) -> DataFrame:
    """Adds an id and a time to each result, as a service would."""
    return result.withColumn("analysis_id", F.expr("uuid()")).withColumn("created_at", F.current_timestamp())


def with_report(result: DataFrame) -> DataFrame:
    """Adds the report as HTML and as pages of text."""
    lined = result.withColumn("lines", report_lines())
    return lined.withColumn("html", report_html(F.col("lines"))).withColumn("pages", report_pages(F.col("lines"))).drop("lines")
