"""Sliding-window admission control over a stream, with the live requests of each key as state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from docstrata.functions.storage import scratch_path
from docstrata.operators.admission import admit

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def admit_any(requests: DataFrame, limit: int, window_us: int, key: str = "key", ts: str = "ts", event: str = "event_id", lateness: str = "0 seconds") -> DataFrame:
    """The limiter that suits the table: with shared state for a stream, a fold for a batch."""
    if requests.isStreaming:
        return admit_stream(requests, limit, window_us, key, ts, event, lateness)
    return admit(requests, limit, window_us, key, ts, event)


def _limiter(limit: int, window_us: int, ttl_ms: int | None) -> StatefulProcessor:
    # Defined here, so that it travels to the workers by value.
    class Limiter(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.live = handle.getListState("live", "us bigint", ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            data = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
            known = [r[0] for r in self.live.get()] if limit > 0 and self.live.exists() else []
            live, fresh, admitted, wait = deque(known), [], [], []
            for us in data["us"].tolist():
                if limit <= 0 or us != us:
                    admitted.append(True)
                    wait.append(None)
                    continue
                while live and live[0] <= us - window_us:
                    live.popleft()
                if len(live) >= limit:
                    admitted.append(False)
                    wait.append(live[0] + window_us - int(us))
                else:
                    live.append(int(us))
                    fresh.append((int(us),))
                    admitted.append(True)
                    wait.append(None)
            if fresh and len(live) == len(known) + len(fresh):
                self.live.appendList(fresh)
            elif fresh or len(live) < len(known):
                self.live.put([(us,) for us in live])
            # A key with state has a timer already, which looks again when it fires.
            if fresh and not known and ttl_ms is None:
                self._wake(live, timerValues)
            yield pd.DataFrame({"key": [key[0]] * len(data), "event_id": data["event_id"].tolist(), "us": data["us"].astype("Int64").tolist(), "admitted": admitted, "wait_us": pd.array(wait, dtype="Int64")})

        def _wake(self, live, timerValues) -> None:
            expires = (max(live) + window_us) // 1000 + 1
            self.handle.registerTimer(max(expires, timerValues.getCurrentWatermarkInMs() + 1))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            live = [r[0] for r in self.live.get()] if self.live.exists() else []
            if live and max(live) + window_us > timerValues.getCurrentWatermarkInMs() * 1000:
                self._wake(live, timerValues)
            else:
                self.live.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Limiter()


def admit_stream(requests: DataFrame, limit: int, window_us: int, key: str = "key", ts: str = "ts", event: str = "event_id", lateness: str = "0 seconds", ttl_ms: int | None = None) -> DataFrame:
    """The streaming form of ``operators.admission.admit``: a row per request as it arrives.

    Within a batch the requests of a key are taken by time, then by ``event``; a request that arrives
    late is judged when it arrives.  A key's state is the list of its admitted requests inside the window
    (``limit`` at most).  A batch appends to it and rewrites it only where requests have expired.  It goes by a timer,
    one for each key, when the watermark has passed the newest of them by a window; with ``ttl_ms`` it goes by
    the clock instead, that long after its last change: that suits live traffic, where ``ttl_ms`` covers the window.
    Requests without a time are admitted and take no slot.  Such state needs the RocksDB store, which this sets for
    the session.
    """
    requests.sparkSession.conf.set(PROVIDER, ROCKSDB)
    rows = requests.select(F.col(key).alias("key"), F.col(event).alias("event_id"), F.col(ts).cast("timestamp").alias("at"))
    if ttl_ms is None:
        rows = rows.withWatermark("at", lateness)
    rows = rows.withColumn("us", F.unix_micros("at"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.groupBy("key").transformWithStateInPandas(
        _limiter(limit, window_us, ttl_ms), f"key {kinds['key']}, event_id {kinds['event_id']}, us bigint, admitted boolean, wait_us bigint", "append", "EventTime" if ttl_ms is None else "ProcessingTime"
    )
    return out.withColumnRenamed("key", key).withColumnRenamed("event_id", event)


def replay(requests: DataFrame, limit: int, window_us: int, key: str = "key", ts: str = "ts", event: str = "event_id", parts: int = 3) -> DataFrame:
    """What the stream decides on a table whose requests arrive in ``parts`` stretches of time.

    Each stretch is handed over as files, and a query with the same checkpoint takes what has come and stops: the state
    of the keys lives in the checkpoint alone in between.  The rows are those of ``admit``.
    """
    spark: SparkSession = requests.sparkSession
    rows = requests.select(key, event, F.col(ts).cast("timestamp").alias(ts))
    inbox, state, outbox = (scratch_path(spark, f"replay-{name}") for name in ("inbox", "state", "outbox"))
    ends = rows.select(F.min(F.unix_micros(ts)).alias("low"), F.max(F.unix_micros(ts)).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    stretch = F.coalesce(F.floor((F.unix_micros(ts) - low) * parts / (high - low + 1)), F.lit(0))
    for k in range(parts):
        rows.filter(stretch == k).write.mode("append").parquet(inbox)
        arrived = spark.readStream.schema(rows.schema).parquet(inbox)
        judged = admit_stream(arrived, limit, window_us, key, ts, event)
        judged.writeStream.format("parquet").option("path", outbox).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(judged.schema).parquet(outbox)
