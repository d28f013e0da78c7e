"""Exact deduplication over a log-structured merge index of text digests.

The index is a folder of *runs*.  A memtable is at most ``MEMTABLE_ROWS`` rows of a writing task: they are
sorted by digest and flushed as one Parquet file with min/max statistics and a Bloom filter, so point
look-ups skip the files that cannot hold a key.  ``FANOUT`` runs of a level are merged into one run of
the next: entries with one digest fold to the identifier that stays and the number of rows, and the files
of the merged run cover disjoint ranges of digests.

A batch is judged against the merged run.  Digests of two or more rows are its hits, and a bitmap filter
of them goes to all tasks: texts that it excludes never travel.  The others meet the text that stays and
are confirmed byte for byte, a large group in many parts.  Everything is DataFrame functions; there is no
Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import scratch_path, stored, whole_text

KEEP = {"smallest": F.min, "largest": F.max}
#: Entries that one file of a fresh run holds at most.
MEMTABLE_ROWS = 1 << 20
#: Runs of a level that are merged into one of the next.
FANOUT = 8
#: Bits of a filter for each digest in it, and at most: the filter of any number of digests is 8 MiB or less.
BITS_EACH, MOST_BITS = 32, 1 << 26
#: Rows of a group that meet the text that stays in one place.
GROUP_ROWS = 256


class DigestIndex:
    """A log-structured merge index ``digest -> (identifier that stays, rows)`` in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest"):
        self.spark, self.keep = spark, KEEP[keep]
        self.path = path or scratch_path(spark, "lsm")
        self.levels: list[list[str]] = [[]]
        self._runs = 0

    def _flush(self, rows: DataFrame, level: int) -> None:
        run = f"{self.path}/level={level}/run={self._runs}"
        self._runs += 1
        (
            rows.select("digest", "keep_id", "n_rows")
            .sortWithinPartitions("digest")
            .write.option("maxRecordsPerFile", MEMTABLE_ROWS)
            .option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.max.bytes#digest", str(1 << 20))
            .parquet(run)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def insert(self, rows: DataFrame) -> None:
        """Flush ``rows(digest, id)`` as a run; full levels are merged downwards."""
        self._flush(rows.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n_rows")), 0)
        level = 0
        while len(self.levels[level]) >= FANOUT:
            self._merge(self.levels[level], level + 1)
            level += 1

    def _merge(self, runs: list[str], level: int) -> None:
        """Merge runs into one of ``level``: equal digests fold before they travel, files cover ranges."""
        merged = self._folded(self.spark.read.parquet(*runs)).repartitionByRange("digest")
        self._flush(merged, level)
        gone = set(runs)
        self.levels = [[r for r in level_runs if r not in gone] for level_runs in self.levels]
        for run in gone:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _folded(self, entries: DataFrame) -> DataFrame:
        return entries.groupBy("digest").agg(self.keep("keep_id").alias("keep_id"), F.sum("n_rows").alias("n_rows"))

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def compact(self) -> None:
        """Merge every run into one run of a new bottom level."""
        if self.runs():
            self._merge(self.runs(), len(self.levels))

    def entries(self) -> DataFrame:
        """One row per digest over all runs, merged or not."""
        found = self.spark.read.parquet(*self.runs())
        return found if len(self.runs()) == 1 and not self.levels[0] else self._folded(found)

    def get(self, digests: list[bytes]) -> DataFrame:
        """Point look-up; the pushed ``IN`` meets each file's statistics and Bloom filter."""
        found = self.spark.read.parquet(*self.runs()).filter(F.col("digest").isin([F.lit(bytearray(x)) for x in digests]))
        return self._folded(found)


class DigestFilter:
    """A bitmap of digests; it may let others through, and excludes none that it holds."""

    def __init__(self, digests: DataFrame):
        n = digests.count()
        self.bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_EACH * n).bit_length()))
        value = self._value(F.col("digest"))
        by_bucket = digests.groupBy(F.bitmap_bucket_number(value).alias("_bucket"))
        self.table = by_bucket.agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("_bits"))
        self.table = stored(self.table, "filter")

    def _value(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.bits)) + 1

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``rows`` with a ``digest`` that may be in the filter, and the others."""
        value = self._value(F.col("digest"))
        at = F.bitmap_bit_position(value)
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
        # The table is MOST_BITS at most, however many digests it holds.
        probed = rows.withColumn("_bucket", F.bitmap_bucket_number(value)).join(F.broadcast(self.table), "_bucket", "left")
        probed = probed.withColumn("_held", F.coalesce(held, F.lit(False)))
        return tuple(probed.filter(f"_held = {flag}").select(*rows.columns) for flag in ("true", "false"))


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["digest"] == b["digest"])


class _Judged:
    """The verdict on every row, and what is needed to find the rows of groups again."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, keep: str, batches: int):
        self.rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"))
        index = DigestIndex(docs.sparkSession, keep=keep)
        self.digests = stored(self.rows.select("id", text_digest(F.col("body")).alias("digest")), "digests")
        for k in range(batches):
            index.insert(self.digests.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == k))
        index.compact()
        self.entries = index.entries()
        self.filter = DigestFilter(self.entries.filter("n_rows > 1").select("digest"))
        hits, others = self.filter.split(self.digests)
        # Only rows that the filter lets through meet the entries.
        found = stored(hits.join(self.entries, "digest").select("id", "digest", "keep_id", "n_rows"), "hits")
        alone = others.select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n_rows"))
        self.verdicts = found.unionByName(alone)
        clash = self._clashes(found.filter("n_rows > 1"), keep)
        if clash is not None:
            self.verdicts = self.verdicts.join(clash.select("digest").distinct(), "digest", "left_anti").unionByName(clash)

    def _clashes(self, hits: DataFrame, keep: str) -> DataFrame | None:
        """Verdicts for digests that different texts share; None if bytes confirm every hit."""
        may, _ = self.filter.split(self.rows.withColumn("digest", text_digest(F.col("body"))))
        names = hits.dropDuplicates(["id", "digest"])
        bodies = stored(may.join(names, _same_row(may, names)).select(may["id"], may["digest"], "body", "keep_id", "n_rows"), "bodies")
        # A group of many rows meets the text that stays in as many parts as it needs.
        parts = F.ceil(F.col("n_rows") / GROUP_ROWS).cast("int")
        stays = bodies.filter("id <=> keep_id").groupBy("digest", "n_rows").agg(F.min("body").alias("kept_body"))
        stays = stays.select("digest", "kept_body", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        dealt = bodies.withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), parts).cast("int"))
        failed = stored(dealt.join(stays, ["digest", "part"]).filter("body <> kept_body").select("digest"), "failed")
        if failed.isEmpty():
            return None
        exact = bodies.join(failed.distinct(), "digest", "left_semi")
        groups = exact.groupBy("digest", "body").agg(KEEP[keep]("id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))
        return exact.select("id", "digest", "body").join(groups, ["digest", "body"]).select("id", "digest", "keep_id", "n_rows")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", batches: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal; a null text counts as empty, so null and empty texts
    form one group.  ``keep`` says which identifier of a group stays.  Null identifiers lose against
    any other and stay only where a whole group has none.  Rows that repeat an identifier and a text
    stay or go together (they are one document).  An empty table gives an empty result; other columns
    are ignored, whatever their names.  ``batches`` is how many runs the rows arrive in, which changes
    no result.
    """
    return _shaped(_Judged(docs, id_col, text_col, keep, batches).verdicts, id_col)


def _shaped(judged: DataFrame, id_col: str) -> DataFrame:
    return judged.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n_rows").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one stays.

    Rows that the filter of repeated digests excludes stay where they are; the others are found again by
    identifier and digest, and those that were delivered twice are returned once.
    """
    judged = _Judged(docs, "doc_id", "text", keep, 1)
    stays = judged.verdicts.filter("id <=> keep_id").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_digest(whole_text("text")).alias("digest"))
    may, alone = judged.filter.split(marked)
    held, _ = judged.filter.split(stays)
    held = stored(held, "stays")
    found = may.join(held, _same_row(may, held), "left_semi")
    # Whole rows are grouped only where some document was delivered twice.
    if not held.filter("n > 1").isEmpty():
        found = found.dropDuplicates(["id", "digest"])
    return found.unionByName(alone).select("row.*")
