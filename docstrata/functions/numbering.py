"""Running sums and row numbers over a whole table, without a task that reads all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.dims import small_frame
from docstrata.functions.storage import stored
from docstrata.functions.text import col


def running_total(df: DataFrame, value: str | Column, order: Sequence[str | Column], group: Sequence[str] = (), name: str = "before") -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same group that come before, 0 for the first.

    Rows are dealt by range of group and order, so a group of any size lies in as many tasks as it needs.
    Each range is summed by itself; what earlier ranges hold of a range's first group is then added, a number
    for each range at most.  Null groups are a group.  The dealt rows are written, so that ranges stay as they
    are when executors are lost.  Columns ``_range`` and ``_sum`` are taken.
    """
    keys = [F.col(g) for g in group]
    placed = [f"_o{k}" for k in range(len(order))]
    rows = df.withColumns({p: col(o) for p, o in zip(placed, order, strict=True)}).withColumn("_sum", col(value).cast("bigint"))
    dealt = stored(rows.repartitionByRange(*keys, *placed).withColumn("_range", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("_range", *group).orderBy(*placed).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn(name, F.coalesce(F.sum("_sum").over(local), F.lit(0)))
    totals = dealt.groupBy("_range", *group).agg(F.sum("_sum").alias("_sum"))
    if group:
        ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        earlier = totals.withColumn("_ahead", F.sum("_sum").over(ahead)).filter("_ahead > 0").select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "_ahead")
        on = F.col("_range") == F.col("_r")
        for k, g in enumerate(group):
            on &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    else:
        # A row for each range.
        sums, ahead, far = totals.orderBy("_range").collect(), [], 0
        for r in sums:
            ahead.append((r["_range"], far))
            far += r["_sum"] or 0
        earlier, on = small_frame(df.sparkSession, ahead, "_r int, _ahead bigint"), F.col("_range") == F.col("_r")
    # Only a range's first group can have rows before it: ``earlier`` has no more rows than there are ranges.
    out = inside.join(F.broadcast(earlier), on, "left").withColumn(name, (F.col(name) + F.coalesce("_ahead", F.lit(0))).cast("bigint"))
    return out.select(*df.columns, name)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds ``name``: the place of each row in ``order``, from 0, for tables of any size."""
    return running_total(df, F.lit(1), order, name=name)
