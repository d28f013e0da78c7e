"""Continuous intake: uploads as they arrive, judged at the gates, to results and rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docstrata.sources.files import MEDIA_TYPES, Settings, with_error

_FILES = "path string, modificationTime timestamp, length long, content binary"


def upload_stream(spark: SparkSession, path: str, glob: str = "*.pdf", settings: Settings = Settings(), per_batch: int = 1000) -> DataFrame:
    """The streaming form of ``sources.files.read_uploads``: files as they appear below ``path``.

    Two scans of the folder, since a filter on the length has to stand at the scan: the content of a file above the
    limit is never read.  ``per_batch`` bounds the new files of a batch.  Spark's file scans pass over files of no bytes, so
    these appear neither among results nor among rejects; a table of uploads with a length of 0 is rejected.
    """
    found = lambda: spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    limit = F.lit(settings.max_upload_bytes)
    small = found().filter(F.col("length") <= limit).select("path", "length", "content")
    large = found().filter(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large).select("path", F.lit(MEDIA_TYPES[0]).alias("content_type"), "length", "content")


def intake(
    uploads: DataFrame,
    error: Column,
    errors: DataFrame,
    results: str,
    rejects: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame] = lambda accepted: accepted,
    counted: Callable[[int, dict], None] | None = None,
) -> StreamingQuery:
    """Takes all uploads that have arrived and stops; a later call with the same ``checkpoint`` goes on from there.

    ``error`` is the code of a row's first error, null if it is accepted.  Accepted rows go through ``process`` to
    ``results``; the others go to ``rejects`` with code, message, remediation and status in place of their content.
    A batch overwrites its own partition (``batch``) of both tables: a batch that was cut off, in whichever of the
    two, is taken again with the same rows and neither loses nor repeats one.  ``counted(batch, counts)`` gets
    the numbers of accepted and rejected rows, observed while they are written.
    """

    def take(rows: DataFrame, batch: int) -> None:
        judged = with_error(rows.withColumn("code", error), "code", errors)
        passed, failed = Observation(), Observation()
        # The gates are cheap and the rows are read anew from the files of the batch; nothing is kept in memory.
        good = process(judged.filter("code IS NULL").drop("code", "error").observe(passed, F.count(F.lit(1)).alias("accepted")))
        good.write.mode("overwrite").parquet(f"{results}/batch={batch}")
        bad = judged.filter("code IS NOT NULL").observe(failed, F.count(F.lit(1)).alias("rejected"))
        bad.select(*[c for c in rows.columns if c != "content"], "error.*").write.mode("overwrite").parquet(f"{rejects}/batch={batch}")
        if counted:
            counted(batch, {**passed.get, **failed.get})

    return uploads.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
