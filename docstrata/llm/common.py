"""Small helpers that every operator of this folder shares."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions.storage import release, scratch_path, shared_root, stored

__all__ = ["held_out", "read_table", "release", "scratch_path", "shared_root", "ship_package", "stored", "whole_text"]


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table below ``sf_dir``; only these reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def whole_text(column: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(doc_id: str | Column) -> Column:
    """True where crc32 of the id's decimal text leaves 1 modulo 3; a null id is never held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once a session, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_docstrata_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="docstrata-")) / "docstrata.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._docstrata_shipped = True
