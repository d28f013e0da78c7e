"""The corpus pipeline: language, exact copies, near copies, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import stored
from docstrata.llm.exact_dedup import drop_exact_duplicates
from docstrata.llm.langid import detect_languages, train, with_letters
from docstrata.llm.minhash import drop_near_duplicates
from docstrata.llm.packing import pack_documents
from docstrata.llm.secrets import redact

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts too) go; which language the network finds rejects none.

    Where no network can be trained, since no row has a usable label, the same documents go.
    """
    docs = docs.select(*COLUMNS)
    network = train(docs)
    if network is None:
        return with_letters(docs)
    # Only a text without a letter has the score 0, whatever the labels are called.
    return detect_languages(docs, network, keep=COLUMNS).filter("score > 0").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return drop_exact_duplicates(docs).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 or more) the document with the smallest id stays."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials in the texts are masked; every document stays.  A document is a repository, its source the owner."""
    return redact(docs, repo_col="doc_id", owner_col="source").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, a row per piece."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language id", language_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]
#: A trained network and a packing plan have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
