"""Registered streaming queries. Each runs a Structured Streaming job to completion
(availableNow trigger, checkpoints and sinks in the shared checkpoint folder) over files
Spark derives from the given tables, then returns the sink table. They use the same
oracles as their batch twins: stream result = batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.company_csv import CSV_COLUMNS, part_as_company_rows
from ..sources.tables import events_utc, read_table
from ..streaming.cache_stream import collapse_stream, ttl_hits_stream
from ..streaming.flight_stream import flights_stream, keep_state_in_rocksdb
from ..streaming.ingest_stream import current_companies, start_ingest_stream
from .q_ingest import CLEAN
from .q_intent import _ttl_sql
from .registry import register

N_CHUNKS = 4


def _write_in_order(chunks, path_of, fmt_write):
    """Write chunks as separate jobs, oldest first, so file modification times follow
    their order (the file source picks the oldest files first)."""
    for i, df in enumerate(chunks):
        fmt_write(df, path_of(i))


@register("a2_stream_ingest_last_wins", f"""SELECT natural_key AS company_id, name, domain, industry, locality,
  country, size_range, year_founded FROM (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY ordinal DESC)
  AS r FROM ({CLEAN}) WHERE natural_key IS NOT NULL AND natural_key <> '') WHERE r = 1""")
def a2_stream_ingest(spark, sf_dir):
    """A2/A4: the company CSV arrives as 4 files in key order, one micro-batch each;
    every batch is appended to a change log; the current table keeps the last version."""
    lo, hi = read_table(spark, sf_dir, "part").agg(F.min("p_partkey"), F.max("p_partkey")).first()
    width = (hi - lo) // N_CHUNKS + 1
    src = shared_path(spark, "stream-src")
    k = F.col("p_partkey")
    chunks = [part_as_company_rows(spark, sf_dir, (k >= lo + i * width) & (k < lo + (i + 1) * width))
              for i in range(N_CHUNKS)]
    _write_in_order(chunks, lambda i: f"{src}/c{i}",
                    lambda df, p: df.coalesce(1).write.option("header", True).option("emptyValue", "").csv(p))
    files_glob = f"{src}/c*"
    target, ckpt = shared_path(spark, "stream-target"), shared_path(spark, "stream-ckpt")
    q = start_ingest_stream(spark, files_glob, CSV_COLUMNS, target, ckpt, max_files_per_trigger=1, embed_dim=None)
    q.awaitTermination()
    cur = current_companies(spark, target)
    return cur.select("company_id", "name", "domain", "industry", "locality", "country", "size_range", "year_founded")


def _events_by_week(spark, sf_dir):
    ev = events_utc(spark, sf_dir)
    lo = ev.agg(F.min("ts")).first()[0]
    src = shared_path(spark, "events-src")
    week = F.floor((F.unix_seconds("ts") - F.lit(int(lo.timestamp()))) / F.lit(7 * 86400)).cast("int")
    ev = ev.withColumn("_week", week)
    n = ev.agg(F.max("_week")).first()[0]
    chunks = [ev.where(F.col("_week") == i).drop("_week") for i in range(n + 1)]
    _write_in_order(chunks, lambda i: f"{src}/w{i:03d}", lambda df, p: df.repartition(1).write.parquet(p))
    return src, ev.drop("_week").schema


@register("f4_ttl_hits_stream", _ttl_sql(86400))
def f4_stream(spark, sf_dir):
    """F4 streaming: events arrive week by week; one state value (last fill) per key."""
    src, schema = _events_by_week(spark, sf_dir)
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/w*")
         .withColumn("k", F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))))
    out, ckpt = shared_path(spark, "ttl-stream-out"), shared_path(spark, "ttl-stream-ckpt")
    labelled = ttl_hits_stream(s, "k", "ts", "event_id", 86400, watermark_delay="1 day")
    q = (labelled.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "cache_hit")


@register("f5_single_flight_stream", """SELECT event_type, count(*) AS n_first FROM (
  SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events)
  WHERE r = 1 GROUP BY event_type""")
def f5_stream(spark, sf_dir):
    """F5 streaming: first request per (user, event type) key within a 60-day watermark
    (longer than the log, so every key is computed exactly once)."""
    src, schema = _events_by_week(spark, sf_dir)
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/w*")
         .withColumn("k", F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))))
    out, ckpt = shared_path(spark, "collapse-out"), shared_path(spark, "collapse-ckpt")
    firsts = collapse_stream(s, "k", "ts", "60 days")
    q = (firsts.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_first"))


FLIGHT, ENTRY = 6 * 3600, 86400

FLIGHTS_SQL = f"""WITH RECURSIVE ev AS (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
chain(user_id, rn, off, outcome) AS (
  SELECT user_id, rn, ts, 'compute' FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, CASE WHEN e.ts < c.off + INTERVAL {FLIGHT + ENTRY} SECOND THEN c.off ELSE e.ts END,
    CASE WHEN e.ts >= c.off + INTERVAL {FLIGHT + ENTRY} SECOND THEN 'compute' WHEN e.ts < c.off + INTERVAL {FLIGHT} SECOND THEN 'wait' ELSE 'hit' END
  FROM chain c JOIN ev e ON e.user_id = c.user_id AND e.rn = c.rn + 1)
SELECT ev.event_id, chain.outcome FROM ev JOIN chain USING (user_id, rn)"""


@register("f5_flights_stream", FLIGHTS_SQL)
def f5_flights(spark, sf_dir):
    """F1-F3 and F5 on a stream: each user's requests are computed, wait for a flight of six hours under way, or are
    served for a day after it; events arrive week by week."""
    src, schema = _events_by_week(spark, sf_dir)
    keep_state_in_rocksdb(spark)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/w*")
    out, ckpt = shared_path(spark, "flights-out"), shared_path(spark, "flights-ckpt")
    done = flights_stream(s, "user_id", "ts", "event_id", FLIGHT, ENTRY, "1 day")
    q = (done.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select("event_id", "outcome")
