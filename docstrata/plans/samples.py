"""Small documents with boxes, for the whole analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata import schemas

BODY, HEADING, LEADING = 10.0, 13.0, 16.0

_SINGLE = [
    ("Robin Example", 16.0, 90.0), ("robin@example.org  +1 555 0100", BODY, 108.0),
    ("EDUCATION", HEADING, 140.0), ("BSc Computing, courses in algorithms", BODY, 156.0), ("Example University 2021", BODY, 172.0),
    ("EXPERIENCE", HEADING, 188.0), ("Wrote REST APIs in Python with Flask", BODY, 204.0), ("Kept the service running for a year", BODY, 220.0),
    ("PROJECTS", HEADING, 236.0), ("Library app with React and PostgreSQL", BODY, 252.0),
    ("SKILLS", HEADING, 268.0), ("Python, SQL, JavaScript, Git, React", BODY, 284.0),
]
_LEFT = ["SKILLS", "Python", "SQL", "Docker", "LANGUAGES", "English", "German", "French"]
_RIGHT = ["EXPERIENCE", "Built services with FastAPI", "Ran them on Kubernetes", "Mentored two colleagues", "EDUCATION", "BSc Computing", "Example University", "Graduated in 2020"]


def _span(doc: int, page: int, seq: int, text: str, size: float, y: float, x0: float) -> tuple:
    top, bottom, x1 = y - 0.9 * size, y + 0.25 * size, x0 + 0.5 * size * len(text)
    return (doc, page, 612.0, 792.0, seq, 0, text, "Helvetica", 0, size, x0, top, x1, bottom, x0, top, x1, bottom)


def raw_spans(spark: SparkSession) -> DataFrame:
    rows = [_span(1, 1, k, t, s, y, 72.0) for k, (t, s, y) in enumerate(_SINGLE)]
    for side, (x0, texts) in enumerate(((72.0, _LEFT), (340.0, _RIGHT))):
        rows += [_span(2, 1, side * 8 + k, t, HEADING if t.isupper() and len(t) > 3 else BODY, 140.0 + LEADING * k, x0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.RAW_SPANS)


def raw_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1, 612.0, 792.0, 0, 0, 300), (2, 1, 612.0, 792.0, 0, 0, 250)], schemas.RAW_PAGES)


def job_descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1, "We use Python, Docker and Kubernetes; Kubernetes daily."), (2, 1, " ")], "doc_id bigint, jd_id int, text string")


EXPECTED_SQL = """SELECT * FROM (VALUES
    (1, 1, 'contact,education,experience,projects,skills', 100.0::DOUBLE, 'PostgreSQL,Python,REST APIs,Flask,React,SQL,JavaScript,Data structures and algorithms,Git', 'Backend Developer'),
    (2, 2, 'skills,languages,experience,education', 75.0::DOUBLE, 'Kubernetes,FastAPI,SQL,Python,Docker', 'DevOps Engineer')
) AS t(doc_id, columns, sections, score, skills, top_role)"""


def as_spans(lines: DataFrame) -> DataFrame:
    """Plain lines (doc_id, page_number, ln, text) as spans: one column, headings by their capitals."""
    y = F.lit(90.0) + (F.col("ln") % 60) * 11.0
    size = F.when(F.col("text") == F.upper("text"), HEADING).otherwise(BODY)
    x1 = F.lit(72.0) + F.least(F.length("text") * 5.0, F.lit(468.0))
    return lines.select(
        "doc_id", "page_number", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), F.col("ln").cast("int").alias("line_seq"), F.lit(0).alias("span_seq"), "text",
        F.lit("Helvetica").alias("font"), F.lit(0).alias("flags"), size.alias("size"), F.lit(72.0).alias("x0"), (y - 9.0).alias("top"), x1.alias("x1"), (y + 2.5).alias("bottom"),
        F.lit(72.0).alias("line_x0"), (y - 9.0).alias("line_top"), x1.alias("line_x1"), (y + 2.5).alias("line_bottom"),
    )
