"""Sliding-window admission control over a batch of requests.

A request is admitted if fewer than ``limit`` admitted requests of its key lie inside the window before
it; denied requests take no slot, so decisions depend on decisions.  A window function cannot say that;
a fold over each key's requests in order can.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions.storage import stored


def pieces(rows: DataFrame, window_us: int) -> DataFrame:
    """``rows(key, event_id, us)`` with ``piece``: the time of the piece's first request.

    A piece begins where a key has been silent for a window or longer: nothing is live there, so what comes
    before cannot matter, and pieces are judged apart.  Rows are dealt by range of key and time, so a key of any
    size lies in many tasks; a range learns of earlier ones from a row for each key that it begins with.
    Requests without a time have no piece.
    """
    ranged = rows.repartitionByRange("key", "us", "event_id").withColumn("range", F.spark_partition_id())
    dealt = stored(ranged, "requests")
    inside = Window.partitionBy("range", "key").orderBy("us", "event_id")
    silent = F.col("us") - F.lag("us").over(inside) >= window_us
    dealt = dealt.withColumn("opened", F.when(silent, F.col("us"))).withColumn("opened", F.max("opened").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = dealt.groupBy("range", "key").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max("opened").alias("opened"))
    ranges = Window.partitionBy("key").orderBy("range")
    # Of the ranges before, the last one with a time: a range may hold requests without one alone.
    before = F.max("last").over(ranges.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("opens", F.when(before.isNull() | (F.col("first") - before >= window_us), F.col("first")))
    begun = F.max(F.coalesce("opened", "opens")).over(ranges.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("enters", F.coalesce("opens", begun)).withColumn("before", before)
    # A range has one key at most that began before it, so this side has a row for each range at most.
    entered = ends.filter("before IS NOT NULL").select(F.col("range").alias("e_range"), F.col("key").alias("e_key"), "enters")
    out = dealt.join(F.broadcast(entered), (F.col("range") == F.col("e_range")) & F.col("key").eqNullSafe(F.col("e_key")), "left")
    piece = F.coalesce("opened", "enters", F.min("us").over(Window.partitionBy("range", "key")))
    return out.select("key", "event_id", "us", F.when(F.col("us").isNotNull(), piece).alias("piece"))


def admit(requests: DataFrame, limit: int, window_us: int, key: str = "key", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """One row per request: key, event, us, admitted, wait_us (null if admitted).

    Requests of a key are taken by time, then by ``event``.  A request exactly one window old has
    expired.  With ``limit`` of 0 or less everything is admitted; so is a request without a time, which takes no
    slot.  A key's requests are cut where it was silent for a window (``pieces``); the pieces are dealt to tasks and
    sorted there, and a task keeps the live requests (``limit`` at most) of the piece that it reads.  Requests that
    follow each other within a window form a chain of decisions: such a piece stays in one task, however long.
    """
    rows = requests.select(F.col(key).alias("key"), F.col(event).alias("event_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    if limit <= 0:
        out = rows.select("key", "event_id", "us", F.lit(True).alias("admitted"), F.lit(None).cast("long").alias("wait_us"))
        return out.withColumnRenamed("key", key).withColumnRenamed("event_id", event)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = pieces(rows, window_us).repartition("key", "piece").sortWithinPartitions("key", "piece", "us", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        now, live = (none, none), deque()
        for batch in batches:
            admitted, wait = [], []
            for k, piece, us in zip(batch["key"].tolist(), batch["piece"].tolist(), batch["us"].tolist(), strict=True):
                if us != us:
                    admitted.append(True)
                    wait.append(None)
                    continue
                if (k, piece) != now:
                    now, live = (k, piece), deque()
                while live and live[0] <= us - window_us:
                    live.popleft()
                if len(live) >= limit:
                    admitted.append(False)
                    wait.append(live[0] + window_us - us)
                else:
                    live.append(us)
                    admitted.append(True)
                    wait.append(None)
            yield batch.drop(columns="piece").assign(us=batch["us"].astype("Int64"), admitted=admitted, wait_us=pd.array(wait, dtype="Int64"))

    out = dealt.mapInPandas(run, f"key {kinds['key']}, event_id {kinds['event_id']}, us bigint, admitted boolean, wait_us bigint")
    return out.withColumnRenamed("key", key).withColumnRenamed("event_id", event)
