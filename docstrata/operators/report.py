"""A report of an analysis result: titled blocks of lines, as an HTML column or as pages of text.

What is shown is one array of ``(block, mark, text)``; HTML and pages are two renderings of it, so they
never differ in content.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docstrata.functions.text import html_escape, percent_half_even

#: Skills of one kind that a report lists at most.
MAX_LISTED = 60
#: Lines of an A4 page of 12 point text inside margins of 48 points.
PAGE_LINES = 62


def _line(block: str, text: Column, mark: Column | str = "") -> Column:
    return F.struct(F.lit(block).alias("block"), (F.lit(mark) if isinstance(mark, str) else mark).alias("mark"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _percent(share: Column) -> Column:
    return F.concat(percent_half_even(share).cast("string"), F.lit(" %"))


def report_lines() -> Column:
    """The lines of a result's report in order: block, mark (a severity, a verdict, a share) and text."""
    c = F.col
    facts = F.array(
        _line("Overview", F.round("ats.score").cast("int"), "score"),
        _line("Overview", c("rubric_version"), "rubric"),
        *[_line("Overview", c(f"document.{name}"), shown) for name, shown in (("page_count", "pages"), ("word_count", "words"), ("column_count", "columns"))],
    )
    advice = F.transform("suggestions", lambda s: _line("Advice", F.concat_ws(" - ", s["title"], s["detail"]), s["severity"]))
    rules = F.transform("ats.checks", lambda k: _line("Rules", F.concat_ws(" - ", k["label"], k["explanation"]), F.when(k["passed"], "met").otherwise("not met")))
    parts = F.concat(
        F.transform("sections", lambda s: _line("Parts", s["kind"], "present")),
        F.transform("missing_sections", lambda kind: _line("Parts", kind, "absent")),
    )

    def skills(evidence: str) -> Column:
        names = F.slice(F.filter("skills", lambda s: s["evidence"] == evidence), 1, MAX_LISTED)
        return F.transform(names, lambda s: _line("Skills", s["name"], evidence))

    roles = F.transform("fit.predictions", lambda p: _line("Roles", p["role"], _percent(p["confidence"])))
    jd = c("fit.job_description")
    nothing = F.slice(facts, 1, 0)
    wanted = F.concat(
        F.array(_line("Position", _percent(jd["similarity"]), "covered")),
        F.transform(jd["matched_skills"], lambda name: _line("Position", name, "has")),
        F.transform(jd["missing_skills"], lambda gap: _line("Position", gap["skill"], "lacks")),
    )
    return F.concat(facts, advice, rules, parts, skills("demonstrated"), skills("claimed"), roles, F.when(jd.isNull(), nothing).otherwise(wanted))


def report_html(lines: Column | None = None) -> Column:
    """The lines as one table, a row each, every text escaped."""
    row = lambda x: F.concat(F.lit("<tr><th>"), html_escape(x["block"]), F.lit("</th><td>"), html_escape(x["mark"]), F.lit("</td><td>"), html_escape(x["text"]), F.lit("</td></tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(report_lines() if lines is None else lines, row), ""), F.lit("</table>"))


def report_pages(lines: Column | None = None, page_lines: int = PAGE_LINES) -> Column:
    """The lines as text, ``page_lines`` to a page; a report has one page at least."""
    shown = F.transform(report_lines() if lines is None else lines, lambda x: F.concat_ws(" | ", x["block"], x["mark"], x["text"]))
    paged = lambda all_lines: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_lines), F.lit(1)) - 1) / page_lines).cast("int")),
        lambda k: F.array_join(F.slice(all_lines, k * page_lines + 1, F.lit(page_lines)), "\n"),
    )
    return F.get(F.transform(F.array(shown), paged), 0)
