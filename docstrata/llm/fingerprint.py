"""Threshold-scaled document sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range.  Sketches of parts merge by
union, and the shares of common hashes estimate resemblance and containment even between documents of
very unequal lengths, because the fraction, not the size, is fixed.  A text whose hashes all lie above the threshold
keeps its least one, so only texts without words have an empty sketch.  All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import whole_text

WORDS = 5
#: One shingle hash in two is kept.
SCALE = 2
#: Ranges of rows for each shuffle partition.
RANGES = 4
_FIRST = -(2**63)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Distinct 64-bit hashes of the text's runs of ``words`` words; a shorter text is one shingle.

    Words are separated by white space; a text without words has no shingle.
    """
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(F.array(parts), lambda w: _hashes(w, words))[0]


def _hashes(w: Column, words: int) -> Column:
    n = F.size(w)
    run = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)])
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), run)
    none = F.array().cast("array<bigint>")
    return F.when(n == 0, none).otherwise(many)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted hashes below the threshold, or the least hash where none is; empty for a text without words."""
    return _retained(shingle_hashes(text, words), scale)


def _retained(hashes: Column, scale: int) -> Column:
    limit = _FIRST + (2**64 // scale)

    def kept(h: Column) -> Column:
        return F.when(F.array_min(h) < limit, F.filter(h, lambda x: x < limit)).otherwise(F.array_compact(F.array(F.array_min(h))))

    # Bound once: a use outside would hash the text again.
    return F.sort_array(F.array_distinct(F.get(F.transform(F.array(hashes), kept), 0)))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts together (without the shingles that span their border).

    A least hash that stood for a text is dropped where the other text has hashes below the threshold.
    """
    return _retained(F.array_union(a, b), scale)


def resemblance(a: Column, b: Column, same: Column) -> Column:
    """Estimated Jaccard similarity; of two empty sketches 1 if the texts are the ``same``, else 0."""
    common, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(both == 0, same.cast("double")).otherwise(common / F.greatest(both, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; an empty sketch is contained in all."""
    n = F.size(a)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(n, F.lit(1)))


def as_text(hashes: Column) -> Column:
    """Sixteen hex digits a hash, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _cut_points(keys: DataFrame, parts: int) -> list:
    """Real keys that cut the rows into about equal ranges: the least key of each range, ``parts`` at most."""
    ranged = keys.repartitionByRange(parts, "key")
    rows = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("low")).orderBy("low").collect()
    return [r["low"] for r in rows]


def _bucket(key: Column, cuts: list[Column]) -> Column:
    """The number of the range that holds ``key``, by two short scans instead of one long one."""
    step = max(1, math.isqrt(len(cuts)))
    fine = F.array(*[F.array(*cuts[i : i + step]) for i in range(0, len(cuts), step)])
    coarse = F.array(*cuts[::step])
    at = F.size(F.filter(coarse, lambda x: x <= key)) - 1
    return at * step + F.size(F.filter(F.get(fine, at), lambda x: x <= key)) - 1


def with_next(docs: DataFrame, id_col: str, columns: list[str], tie: str) -> DataFrame:
    """Adds ``next_<column>`` of the next row by id; the last row's next is the first row.

    Rows are dealt out by ranges of id and a hash of ``tie``, so neither ids of any type nor very many rows
    of one id (or without one) end in one task.  The first row of each range is also sent to the range
    before it, so a window inside the ranges sees every neighbour.  Rows that share an id follow each other
    by that hash; null ids come first.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("key", F.struct(F.col(id_col).alias("id"), F.xxhash64(tie).alias("tie")))
    # More ranges than tasks, so that ranges of one task even out.
    low = _cut_points(rows.select("key"), RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not low:
        return rows.select(*docs.columns, *[F.col(c).alias(f"next_{c}") for c in columns]).limit(0)
    kind = rows.schema["key"].dataType
    cuts = [F.struct(F.lit(x["id"]).cast(kind["id"].dataType).alias("id"), F.lit(x["tie"]).cast("long").alias("tie")) for x in low]
    bucket = _bucket(F.col("key"), cuts)
    first = F.exists(F.array(*cuts), lambda x: x == F.col("key"))
    rows = rows.withColumn("_at", bucket).withColumn("_first", first)
    before = F.when(F.col("_at") == 0, F.lit(len(cuts) - 1)).otherwise(F.col("_at") - 1)
    seat = lambda at, guest: F.struct(at.alias("b"), F.lit(guest).alias("guest"))
    seats = F.when(F.col("_first"), F.array(seat(F.col("_at"), 0), seat(before, 1))).otherwise(F.array(seat(F.col("_at"), 0)))
    seated = rows.withColumn("seat", F.explode(seats)).select("*", F.col("seat.b").alias("_b"), F.col("seat.guest").alias("_guest")).drop("seat")
    order = Window.partitionBy("_b").orderBy("_guest", "key", tie)
    out = seated.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.filter("_guest = 0").drop("_b", "_guest", "_at", "_first", "key")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """One row per row of ``docs``: sketches of the text and of its edited text, and their likeness.

    The edited text has the last quarter of the code points replaced by the start of the next text.
    Null texts are empty; rows that repeat an id follow each other by a hash of the text; extra columns are ignored.
    An empty table gives an empty result; in a table of one row the next document is the row itself.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"))
    # Sketches are made behind the shuffle: their hashes would be most of its bytes.
    pairs = with_next(rows, "id", ["body"], "body")
    n = F.length("body")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - k), F.substring(F.col("next_body"), F.lit(1), k))
    pairs = pairs.select("id", sketch(F.col("body"), words, scale).alias("prints"), sketch(F.col("next_body"), words, scale).alias("next_prints"), n.cast("long").alias("n_chars"), edited.alias("edited"), (edited == F.col("body")).alias("unedited"), (F.col("body") == F.col("next_body")).alias("repeated"))
    pairs = pairs.withColumn("edited_prints", sketch(F.col("edited"), words, scale))
    return pairs.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("prints")).alias("fingerprint"),
        as_text(F.col("edited_prints")).alias("edited_fingerprint"),
        resemblance(F.col("prints"), F.col("edited_prints"), F.col("unedited")).cast("double").alias("near_edited"),
        resemblance(F.col("prints"), F.col("next_prints"), F.col("repeated")).cast("double").alias("near_next"),
        containment(F.col("prints"), F.col("edited_prints")).cast("double").alias("kept_share"),
    )
