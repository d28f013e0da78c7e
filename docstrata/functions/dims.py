"""The shipped dimensions as DataFrames, and the taxonomy from other rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docstrata import schemas
from docstrata.functions import seed
from docstrata.functions.text import surface


def small_frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Rows as a local relation, whose size the optimizer knows; rows from Python objects would count as unbounded."""
    kinds = StructType.fromDDL(schema)
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, to_arrow_schema(kinds), strict=True)], kinds.names), kinds)


def taxonomy(skills: DataFrame) -> DataFrame:
    """``skills(skill_id, name, category, strict, aliases, entry_ord)`` to one row per surface.

    A surface that several skills claim belongs to the first of them.  ``cand_ord`` orders surfaces by
    skill, then by surface.
    """
    named = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    forms = F.array_sort(F.array_distinct(F.filter(F.transform(named, surface), lambda s: s != "")))
    rows = skills.select("skill_id", "name", "category", "strict", "entry_ord", F.posexplode(forms).alias("form_ord", "surface"))
    first = Window.partitionBy("surface").orderBy("entry_ord", "form_ord")
    rows = rows.withColumn("k", F.row_number().over(first)).filter("k = 1")
    order = F.col("entry_ord") * 1000 + F.col("form_ord")
    return rows.select("surface", "skill_id", "name", "category", "strict", F.size(F.split("surface", " ")).alias("n_words"), order.cast("int").alias("cand_ord"))


def skills_frame(spark: SparkSession, skills=None) -> DataFrame:
    rows = [(*s[:4], list(s[4]), k) for k, s in enumerate(seed.SKILLS if skills is None else skills)]
    return small_frame(spark, rows, "skill_id string, name string, category string, strict boolean, aliases array<string>, entry_ord int")


def heading_aliases(spark: SparkSession) -> DataFrame:
    """Normalised alias to kind; of a repeated alias the last kind counts."""
    found: dict[str, str] = {}
    for kind, aliases in seed.HEADINGS.items():
        found |= {" ".join("".join(c if c.isalnum() else " " for c in a.lower()).split()): kind for a in aliases}
    return small_frame(spark, list(found.items()), schemas.HEADING_ALIASES)


def expected_sections(spark: SparkSession) -> DataFrame:
    return small_frame(spark, list(enumerate(seed.EXPECTED_SECTIONS)), schemas.EXPECTED_SECTIONS)


ADVICE = {
    "summary": ("Open with a two-line summary", "Say what you do and what you are after before the reader meets the details."),
    "education": ("Give your education its own section", "Name the degree, the institution and the year of completion, past or planned."),
    "experience": ("Give your experience its own section", "Paid, unpaid and part-time work all count; say what you did and what came of it."),
    "skills": ("List your skills in one place", "A short list of tools and languages is what keyword searches look at first."),
    "projects": ("Describe one or two projects", "Where work history is short, finished projects with a link show most."),
    "contact": ("Put your contact details at the top", "Name, e-mail address and telephone number were not found above the first heading."),
}
TEXTS = {
    "machine_readable_text": ("The text can be selected and read.", "No text can be selected in this document.", "Export the document instead of scanning it", "Save the file from the program it was written in."),
    "single_column_layout": ("The text runs in one column.", "The text runs in more than one column.", "Use one column", "Parsers read across columns and mix their lines."),
    "no_layout_tables": ("No table holds text in place.", "Tables hold text in place.", "Write table cells as plain lines", "Cells lose their order when a table is flattened."),
    "text_outside_header_footer": ("Nothing repeats at the edges of the pages.", "Lines repeat at the edges of the pages.", "Move what matters out of headers and footers", "Many parsers skip page edges altogether."),
    "recognisable_section_headings": ("Every heading is a usual one.", "Some headings are not usual ones.", "Use the usual section names", "Plain names such as Education or Skills are recognised everywhere."),
    "appropriate_length": ("The length is right.", "The document is longer than one page.", "Shorten the document to one page", "Keep what fits the position and leave out the rest."),
}


def section_advice(spark: SparkSession) -> DataFrame:
    return small_frame(spark, [(k, seed.MISSING_SEVERITY[k], *v) for k, v in ADVICE.items()], schemas.SECTION_ADVICE)


def rubric(spark: SparkSession) -> DataFrame:
    return small_frame(spark, [(k, *c, *TEXTS[c[0]]) for k, c in enumerate(seed.CHECKS)], schemas.RUBRIC)


def role_skills(spark: SparkSession) -> DataFrame:
    rows = [(role, skill) for role, skills in seed.ROLES.items() for skill in skills]
    return small_frame(spark, rows, schemas.ROLE_SKILLS)


def unknown_skills(roles: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(role, skill_id) of the role skills that no taxonomy entry has; a sound set of dimensions has none."""
    return roles.select("role", "skill_id").join(surfaces.select("skill_id").distinct(), "skill_id", "left_anti").select("role", "skill_id")


# Codes and status numbers are fixed; the wording is ours.
ERRORS = (
    ("file_too_large", 413, "The file is larger than the limit.", "Reduce embedded pictures or export at lower quality."),
    ("unsupported_media_type", 415, "Only PDF files are read.", "Export the document as PDF."),
    ("encrypted_pdf", 422, "The file is locked with a password.", "Save a copy without a password."),
    ("corrupt_pdf", 422, "The file cannot be read as PDF.", "Check that it opens, then export it again."),
    ("too_many_pages", 422, "The document has too many pages.", "Hand in the document alone, without attachments."),
    ("not_machine_readable", 422, "The document holds pictures of text, not text.", "Export it from the program it was written in."),
    ("empty_document", 422, "No text was found.", "Check that this is the right file."),
    ("rate_limited", 429, "Too many requests in a short time.", "Wait and try again."),
    ("internal_error", 500, "Something went wrong.", "Try again later."),
)


def errors(spark: SparkSession) -> DataFrame:
    return small_frame(spark, list(ERRORS), schemas.ERRORS)
