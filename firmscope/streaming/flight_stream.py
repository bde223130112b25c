"""F1–F3 and F5 as one stateful stream: lookup, fill, expiry, and waiters sharing one flight.

Per key, the state is when the flight under way, or the one that filled the entry, took off. A request at
time t computes if there is no entry and no flight; it waits if t is before the flight lands; else it is a
hit until the entry, filled on landing, has run out. A hit or a wait doesn't prolong anything. Keys are dealt to
buckets by a hash; a bucket's keys and their take-offs are one value in the state store (RocksDB), so that a call
takes thousands of keys at once. Keys whose entry has run out leave with the bucket's next rows, or when its
timer in event time goes off, so only keys with a live entry take room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.shipping import ship_by_value
from .cache_stream import BUCKETS, STATE_SCHEMA, BucketBatch, bucket_of

ship_by_value(__name__)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                    T.StructField("outcome", T.StringType())])


def outcomes(times: np.ndarray, took_off: int | None, flight_us: int, ttl_us: int) -> tuple[np.ndarray, int | None]:
    """``compute``, ``wait`` or ``hit`` for the requests of one key in order of time, and the last take-off. Goes from
    one computing request to the next by binary search."""
    out = np.full(len(times), "hit", dtype=object)
    at = 0
    while at < len(times):
        if took_off is None or times[at] >= took_off + flight_us + ttl_us:
            out[at], took_off = "compute", int(times[at])
            at += 1
        lands, ends = np.searchsorted(times, (took_off + flight_us, took_off + flight_us + ttl_us))
        out[at:max(at, lands)] = "wait"
        at = max(at, int(ends))
    return out, took_off


class Flights(StatefulProcessor):
    def __init__(self, flight_us: int, ttl_us: int):
        self.flight_us, self.span_us = flight_us, flight_us + ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flights", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [r for r in rows if len(r)]
        if not frames:
            return
        keys, took_off = map(list, self.state.get()) if self.state.exists() else ([], [])
        b = BucketBatch(frames, keys, took_off, self.span_us)
        now = b.live(self.span_us, timerValues.getCurrentWatermarkInMs())
        if now != (keys, took_off):
            if keys:
                self.handle.deleteTimer(self._ends_ms(took_off))
            if now[0]:
                self.state.update(now)
                self.handle.registerTimer(self._ends_ms(now[1]))
            elif keys:
                self.state.clear()
        waits = b.timed & (b.times < b.in_force + self.flight_us)
        out = np.where(b.filled | ~b.has_fill, "compute", np.where(waits, "wait", "hit")).astype(object)
        yield pd.DataFrame({"key": b.rows["key"].to_numpy(), "event_id": b.rows["event_id"].to_numpy(), "ts": b.rows["ts"].to_numpy(), "outcome": out})

    def _ends_ms(self, took_off: list[int]) -> int:
        return (max(took_off) + self.span_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def flights_stream(requests: DataFrame, key: str, ts: str, id_col: str, flight_seconds: int, ttl_seconds: int, watermark_delay: str,
                   buckets: int = BUCKETS) -> DataFrame:
    """``(key, event_id, ts, outcome)`` for a streaming ``requests``. Requests later than the watermark are dropped by
    Spark; those within it are taken in order of time inside each micro-batch. The session must keep
    streaming state in RocksDB (``keep_state_in_rocksdb``)."""
    r = requests.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"))
    flights = Flights(int(flight_seconds) * 1_000_000, int(ttl_seconds) * 1_000_000)
    return r.withWatermark("ts", watermark_delay).withColumn("_bucket", bucket_of("key", buckets)).groupBy("_bucket").transformWithStateInPandas(flights, OUT, "Append", "EventTime")


def keep_state_in_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
