"""Sources and sinks: uploads, occupation lists, text records, settings, results."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

import yaml
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docstrata import schemas
from docstrata.functions.numbering import numbered
from docstrata.functions.text import scrubbed, stripped

MEDIA_TYPES = ("application/pdf", "application/x-pdf")
SIGNATURE = bytearray(b"%PDF-")
MAX_JOB_DESCRIPTION = 20_000


@dataclass(frozen=True)
class Settings:
    """Limits, from the environment where set (prefix DOCSTRATA_), else as shipped."""

    max_upload_bytes: int = 5 * 1024 * 1024
    max_page_count: int = 10
    min_characters_per_page: int = 120
    rate_limit_requests: int = 10
    rate_limit_window_seconds: int = 3600
    trusted_proxies: int = 0

    @classmethod
    def from_environment(cls, prefix: str = "DOCSTRATA_") -> Settings:
        given = {f.name: os.environ[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**{k: int(v) for k, v in given.items()})


def read_uploads(spark: SparkSession, path: str, glob: str = "*.pdf", settings: Settings = Settings()) -> DataFrame:
    """(path, content_type, length, content) of the files below ``path``.

    Files above the size limit are listed without their content: filters on the length reach the scan, so
    such a file is never read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    limit = F.lit(settings.max_upload_bytes)
    small = files.filter(F.col("length") <= limit).select("path", "length", "content")
    large = files.filter(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large).select("path", F.lit(MEDIA_TYPES[0]).alias("content_type"), "length", "content")


def upload_error(settings: Settings = Settings(), page_count: Column | None = None, characters: Column | None = None) -> Column:
    """The first error of an upload, in the order in which gates are passed; null if it is accepted.

    Media type, emptiness, size (the limit itself passes), signature; with ``page_count`` and
    ``characters`` also the number of pages and the text in them.
    """
    out = (
        F.when(~F.coalesce(F.col("content_type").isin(*MEDIA_TYPES), F.lit(False)), "unsupported_media_type")
        .when(F.coalesce("length", F.lit(0)) == 0, "empty_document")
        .when(F.col("length") > settings.max_upload_bytes, "file_too_large")
        .when(F.coalesce(F.substring("content", 1, 5) != F.lit(SIGNATURE), F.lit(True)), "unsupported_media_type")
    )
    if page_count is not None:
        out = out.when(page_count > settings.max_page_count, "too_many_pages").when(page_count == 0, "empty_document")
    if characters is not None and page_count is not None:
        out = out.when((characters == 0) | (characters < settings.min_characters_per_page * page_count), "not_machine_readable")
    return out


def with_error(rows: DataFrame, code: str, errors: DataFrame) -> DataFrame:
    """Adds ``error`` (code, message, remediation, status), null where ``code`` is; unknown codes are internal."""
    known = errors.select(F.col("code").alias("e_code"), "status", "message", "remediation")
    listed = [r["e_code"] for r in known.select("e_code").collect()]
    named = F.when(F.col(code).isNull(), None).when(F.col(code).isin(*listed), F.col(code)).otherwise("internal_error")
    joined = rows.withColumn("e_want", named).join(known, F.col("e_want") == F.col("e_code"), "left")
    error = F.when(F.col("e_code").isNotNull(), F.struct(F.col("e_code").alias("code"), "message", "remediation", "status"))
    return joined.withColumn("error", error).drop("e_want", "e_code", "status", "message", "remediation")


def decode_pdfs(uploads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Accepted uploads to (doc_id, error, pages, spans) with a PDF library on the executors, if there is one.

    ``pages`` and ``spans`` are arrays in the shape of RAW_PAGES and RAW_SPANS.
    """

    def run(batches):
        import pandas as pd

        try:
            import pymupdf
        except ImportError as missing:
            raise RuntimeError("decoding PDF files needs the pymupdf library on the executors") from missing
        for batch in batches:
            out = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                pages, spans, error = [], [], None
                try:
                    pdf = pymupdf.open(stream=content, filetype="pdf")
                    if pdf.needs_pass or pdf.is_encrypted:
                        error = "encrypted_pdf"
                    elif not 0 < pdf.page_count <= settings.max_page_count:
                        error = "too_many_pages" if pdf.page_count else "empty_document"
                    else:
                        for number, page in enumerate(pdf, 1):
                            raw = [x for b in page.get_text("dict")["blocks"] if b.get("type") == 0 for x in b.get("lines", ())]
                            for n, line in enumerate(raw):
                                for k, s in enumerate(line.get("spans", ())):
                                    spans.append((doc_id, number, page.rect.width, page.rect.height, n, k, s.get("text", ""), s.get("font", ""), int(s.get("flags", 0)), float(s.get("size", 0)), *map(float, s["bbox"]), *map(float, line["bbox"])))
                            tables = 0
                            if len(raw) <= 300:
                                try:
                                    tables = len(page.find_tables().tables)
                                except Exception:  # noqa: BLE001  a page whose tables cannot be found has none
                                    tables = 0
                            pages.append((doc_id, number, page.rect.width, page.rect.height, len(page.get_images(full=True)), tables, len(page.get_text().strip())))
                except Exception:  # noqa: BLE001  whatever the library cannot open is a corrupt file
                    error = "corrupt_pdf"
                out.append((doc_id, error, pages, spans))
            yield pd.DataFrame(out, columns=["doc_id", "error", "pages", "spans"])

    return uploads.select("doc_id", "content").mapInPandas(run, f"doc_id bigint, error string, pages array<struct<{schemas.RAW_PAGES.replace(' ', ':').replace(',:', ',')}>>, spans array<struct<{schemas.RAW_SPANS.replace(' ', ':').replace(',:', ',')}>>")


def _in_order(rows: DataFrame) -> DataFrame:
    """Adds ``input_ord``: the place of each row, files by path and rows as they stand in the file.

    Spark packs blocks into tasks by size, so row ids alone do not follow the files.  A block is read by one
    task from its begin to its end: file, begin of the block and row id together do.
    """
    source = F.col("_metadata")
    placed = rows.select("*", source["file_path"].alias("_path"), source["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_row"))
    return numbered(placed, ["_path", "_block", "_row"], "input_ord").drop("_path", "_block", "_row")


def read_occupations(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated export with quoted line ends, with the order of its rows.

    Quoted line ends keep a file whole: it is read by one task, several files by several.
    """
    return _in_order(spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8"))


def read_technologies(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated export, with the order of its rows; large files are read in blocks."""
    return _in_order(spark.read.csv(path, header=True, sep="\t", encoding="UTF-8"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a file of JSON records that are not blank."""
    return spark.read.text(path).filter(stripped("value") != "")


def scrub_records(records: DataFrame, field: str = "text") -> DataFrame:
    """Each record with contact details masked in ``field``; its other fields and their order stay.

    Items are parted by ``, `` and names from values by ``: ``, at every depth, and letters stay unescaped.
    A line that is no JSON object fails the job with that line's beginning in the message.
    """
    as_map = F.from_json("value", "map<string,string>")
    old = F.get_json_object("value", f"$.{field}")
    parts = F.transform(F.map_keys(as_map), lambda k: F.struct(k.alias("k")))
    raw = F.from_json("value", "map<string,variant>") if hasattr(F, "parse_json") else as_map
    pieces = F.transform(
        parts,
        lambda p: F.concat(
            F.to_json(F.array(p["k"])).substr(F.lit(2), F.length(F.to_json(F.array(p["k"]))) - 2),
            F.lit(": "),
            F.when(p["k"] == field, _json_string(scrubbed(old))).otherwise(_spaced(F.to_json(F.element_at(raw, p["k"])))),
        ),
    )
    whole = F.concat(F.lit("{"), F.array_join(pieces, ", "), F.lit("}"))
    broken = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))).cast("string")
    return records.select(F.when(as_map.isNull(), broken).otherwise(whole).alias("value"))


def _spaced(json: Column) -> Column:
    """Compact JSON with a blank behind every comma and colon outside strings."""
    parts = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"|[^",:]+|[,:]'), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.isin(",", ":"), F.concat(x, F.lit(" "))).otherwise(x)), "")


def _json_string(x: Column) -> Column:
    whole = F.to_json(F.array(x))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def job_descriptions(rows: DataFrame, most: int = MAX_JOB_DESCRIPTION) -> DataFrame:
    """Descriptions that are not blank and not too long."""
    return rows.filter((F.length("text") <= most) & (stripped("text") != ""))


def write_results(result: DataFrame, path: str) -> None:
    """One JSON object per document."""
    result.write.mode("overwrite").json(path)


def write_results_observed(result: DataFrame, path: str, **counts: Column) -> dict:
    """Writes ``result`` like ``write_results`` and returns the aggregates ``counts`` over it, gathered in the same job."""
    seen = Observation()
    write_results(result.observe(seen, *[c.alias(name) for name, c in counts.items()]), path)
    return seen.get


def write_records(records: DataFrame, path: str) -> None:
    """Lines of JSON as they are."""
    records.select("value").write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Log lines: one JSON object of numbers and flags each, stamped in UTC."""
    stamped = metrics.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    stamped.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def taxonomy_document(entries: DataFrame, source: str, version: str) -> str:
    """A taxonomy as a YAML document, for taxonomies small enough to be read by people."""
    skills = []
    for r in entries.orderBy("entry_ord").toLocalIterator():
        item = {"name": r["name"], "id": r["skill_id"], "category": r["category"]}
        if r["aliases"]:
            item["aliases"] = list(r["aliases"])
        if r["strict"]:
            item["strict"] = True
        skills.append(item)
    return yaml.safe_dump({"source": source, "version": version, "skills": skills}, allow_unicode=True, sort_keys=False)


def schema_document(df: DataFrame) -> str:
    """The schema of a result as JSON."""
    return df.schema.json()
