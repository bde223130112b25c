"""F4/F5 on a stream of requests.

F4: the only state is each key's last fill time. Keys are dealt to buckets by a hash, and a bucket's keys and fill
times are one state value (``applyInPandasWithState``), so that a call folds thousands of keys at once. Within a
micro-batch a key's rows are sorted by (ts, id) and folded: hit iff ts < fill + ttl, otherwise the row
refills. A key leaves its bucket once the watermark passes fill + ttl (event time) — from then on any request
would be a miss anyway, so dropping it loses nothing. Rows older than the watermark are late and dropped by
Spark (late-data policy: the watermark delay, default = ttl).

F5: ``dropDuplicatesWithinWatermark`` keeps the first request of every key within the
watermark delay — the requests that have to be computed; the rest share their result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.shipping import ship_by_value
from ..operators.cache import fills_of_keys

ship_by_value(__name__)

OUT_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("event_id", T.LongType()),
                           T.StructField("ts", T.TimestampType()), T.StructField("cache_hit", T.BooleanType())])
STATE_SCHEMA = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("fill_us", T.ArrayType(T.LongType()))])
BUCKETS = 1024  # of keys; a bucket's rows of a micro-batch and its live keys are in memory at once, so scale with the load


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class BucketBatch:
    """A bucket's rows of a micro-batch in order of (key, time, id), and its keys with the time each last filled."""

    def __init__(self, frames: list[pd.DataFrame], keys: list, fills: list[int], ttl_us: int):
        rows = pd.concat(frames)
        codes, names = pd.factorize(pd.Series([*keys, *rows["key"]], dtype=object), use_na_sentinel=False)
        rows["_code"] = codes[len(keys):]
        self.rows = rows.sort_values(["_code", "ts", "event_id"], kind="mergesort")
        self.names = [k if isinstance(k, str) else None for k in names]
        self.before, self.known = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        self.before[codes[:len(keys)]], self.known[codes[:len(keys)]] = fills, True
        code, timed = self.rows["_code"].to_numpy(), self.rows["ts"].notna().to_numpy()
        self.times = self.rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        self.filled, self.in_force = np.zeros(len(code), bool), self.before[code]
        self.filled[timed], self.in_force[timed], self.last = fills_of_keys(code[timed], self.times[timed], self.before, self.known, ttl_us)
        self.known[code[timed]] = True
        self.has_fill, self.timed = self.known[code], timed  # a row without a time fills nothing

    def live(self, ttl_us: int, watermark_ms: int) -> tuple[list, list[int]]:
        """The keys, and their fills, that have not run out by the watermark."""
        at = np.flatnonzero(self.known & (self.last + ttl_us > watermark_ms * 1000))
        return [self.names[i] for i in at], [int(x) for x in self.last[at]]


def ttl_hits_stream(requests: DataFrame, key: str, ts: str, id_col: str, ttl_seconds: int,
                    watermark_delay: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Streaming F4: ``requests`` is a streaming DataFrame; returns (key, event_id, ts, cache_hit)."""
    ttl_us = int(ttl_seconds) * 1_000_000
    delay = watermark_delay or f"{int(ttl_seconds)} seconds"
    r = (requests.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("long").alias("event_id"),
                         F.col(ts).cast("timestamp").alias("ts"))
         .withWatermark("ts", delay).withColumn("_bucket", bucket_of("key", buckets)))

    def fold(_, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        b = BucketBatch(frames, *(state.get if state.exists else ([], [])), ttl_us)
        keys, fills = b.live(ttl_us, state.getCurrentWatermarkMs())
        if keys:
            state.update((keys, fills))
            state.setTimeoutTimestamp(-(-(max(fills) + ttl_us) // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": b.rows["key"].to_numpy(), "event_id": b.rows["event_id"].to_numpy(), "ts": b.rows["ts"].to_numpy(),
                            "cache_hit": ~b.filled & b.has_fill})

    return r.groupBy("_bucket").applyInPandasWithState(fold, OUT_SCHEMA, STATE_SCHEMA, "append",
                                                       GroupStateTimeout.EventTimeTimeout)


def collapse_stream(requests: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Streaming F5: the first request per key within the watermark delay."""
    return requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) \
        .dropDuplicatesWithinWatermark([key])
