"""Registered tag and reporting queries: suppliers as companies with tag requests from
``events`` (company = user_id, tag = event_type, order = event_id); the request log is
``events`` (endpoint = event_type, latency = value, ok = event_type <> 'error')."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.metrics import (canonical_endpoints, compare_runs, endpoint_stats, latency_sketches, read_stats_csv, report_lines,
                                 to_stats_csv_frame, window_stats, write_stats_csv)
from ..operators.search import SearchRequest, search
from ..operators.tags import add_tags, all_tags
from ..operators.sizing import bounded_broadcast
from ..session import materialize, shared_path
from ..sources.tables import events_utc, read_table
from .registry import register

_cache: dict = {}


def suppliers(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.col("s_suppkey").cast("string").alias("company_id"), F.lower("s_name").alias("name"),
        F.lit("").alias("domain"), F.lit("").alias("industry"), F.lit("").alias("locality"),
        F.lower("n_name").alias("country"), F.lit(None).cast("string").alias("size_range"),
        F.lit(None).cast("int").alias("year_founded"), F.array().cast("array<string>").alias("tags"))


def tag_requests(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("company_id"),
                     F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("tag"),  # padded: trimmed on add
                     F.col("event_id").alias("seq"))


def tagged(spark, sf_dir):
    return add_tags(suppliers(spark, sf_dir), tag_requests(spark, sf_dir))


SUP_SQL = "SELECT CAST(s_suppkey AS VARCHAR) AS company_id FROM supplier"
REQ_SQL = "SELECT CAST(user_id AS VARCHAR) AS company_id, event_type AS tag, event_id AS seq FROM events"
TAGS_SQL = f"""WITH s AS ({SUP_SQL}), r AS ({REQ_SQL}),
f AS (SELECT company_id, tag, min(seq) AS seq FROM r WHERE company_id IN (SELECT company_id FROM s) GROUP BY ALL),
t AS (SELECT company_id, string_agg(tag, ',' ORDER BY seq) AS tags_joined, count(*) AS n_tags FROM f GROUP BY ALL)
SELECT s.company_id, coalesce(t.tags_joined, '') AS tags_joined, coalesce(t.n_tags, 0) AS n_tags
FROM s LEFT JOIN t USING (company_id)"""


@register("h1_add_tags", TAGS_SQL)
def h1_add(spark, sf_dir):
    """Tag requests applied in order, trimmed, appended only if absent."""
    co, _ = tagged(spark, sf_dir)
    return co.select("company_id", F.array_join("tags", ",").alias("tags_joined"),
                     F.size("tags").cast("long").alias("n_tags"))


@register("h3_unknown_company_rejects", f"""WITH s AS ({SUP_SQL}), r AS ({REQ_SQL})
SELECT company_id, tag, seq FROM r WHERE company_id NOT IN (SELECT company_id FROM s)""")
def h3_rejects(spark, sf_dir):
    """H3: requests for companies that do not exist (the 404 case)."""
    _, rej = tagged(spark, sf_dir)
    return rej.select("company_id", "tag", "seq")


@register("h2_all_tags", f"""WITH s AS ({SUP_SQL}), r AS ({REQ_SQL}),
f AS (SELECT DISTINCT company_id, tag FROM r WHERE company_id IN (SELECT company_id FROM s))
SELECT tag, count(*) AS doc_count FROM f GROUP BY tag ORDER BY doc_count DESC, tag LIMIT 1000""")
def h2_all(spark, sf_dir):
    """Most frequent tags (top 1,000 by document count, then tag)."""
    co, _ = tagged(spark, sf_dir)
    return all_tags(co)


@register("c5_has_all_tags", f"""WITH s AS ({SUP_SQL}), r AS ({REQ_SQL}),
f AS (SELECT DISTINCT company_id, tag FROM r WHERE company_id IN (SELECT company_id FROM s)),
c AS (SELECT company_id FROM f WHERE tag IN ('click', 'purchase') GROUP BY company_id HAVING count(*) = 2)
SELECT company_id, CAST(row_number() OVER (ORDER BY company_id) AS INTEGER) AS rank
FROM (SELECT company_id FROM c ORDER BY company_id LIMIT 50)""")
def c5_tags(spark, sf_dir):
    """Companies carrying all requested tags (AND of exact tag terms), first 50 by id."""
    co, _ = tagged(spark, sf_dir)
    return search(co, SearchRequest(tags=["click", "purchase"], size=50)).select("company_id", "rank")


def _log(spark, sf_dir):
    ev = events_utc(spark, sf_dir)
    return ev.select(F.col("event_type").alias("endpoint"), "ts", F.col("value").alias("latency"),
                     (F.col("event_type") != "error").alias("ok"))


def _stats_sql(where: str) -> str:
    return f"""WITH l AS (SELECT event_type AS endpoint, ts, value AS latency, event_type <> 'error' AS ok FROM events
  WHERE {where}),
sp AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed FROM l)
SELECT endpoint, count(*) AS request_count, count(*) FILTER (WHERE NOT ok) AS failure_count,
  coalesce(round(avg(latency) FILTER (WHERE ok), 9), 0.0) AS avg_latency,
  coalesce(min(latency) FILTER (WHERE ok), 0.0) AS min_latency,
  coalesce(max(latency) FILTER (WHERE ok), 0.0) AS max_latency,
  count(*) / any_value(sp.elapsed) AS requests_per_s,
  count(*) FILTER (WHERE NOT ok) / any_value(sp.elapsed) AS failures_per_s,
  coalesce(round(quantile_cont(latency, 0.5) FILTER (WHERE ok), 9), 0.0) AS p50,
  coalesce(round(quantile_cont(latency, 0.95) FILTER (WHERE ok), 9), 0.0) AS p95,
  coalesce(round(quantile_cont(latency, 0.99) FILTER (WHERE ok), 9), 0.0) AS p99,
  coalesce(round(quantile_cont(latency, 0.999) FILTER (WHERE ok), 9), 0.0) AS p999
FROM l, sp GROUP BY endpoint"""


@register("i1_i2_endpoint_stats", _stats_sql("TRUE"))
def i1_stats(spark, sf_dir):
    """Per-endpoint counts, latency stats over successes (0 if none), rates, exact percentiles."""
    return endpoint_stats(_log(spark, sf_dir))


WINDOW = ("2024-01-05 06:30:00", "2024-01-21 18:00:00")


@register("i1_sketch_windows", f"""SELECT event_type AS endpoint, count(*) AS request_count, count(*) FILTER (WHERE event_type = 'error') AS failure_count,
  round(avg(value) FILTER (WHERE event_type <> 'error'), 9) AS avg_latency, min(value) FILTER (WHERE event_type <> 'error') AS min_latency,
  max(value) FILTER (WHERE event_type <> 'error') AS max_latency, CASE WHEN event_type <> 'error' THEN TRUE END AS ranks_within_1_percent
FROM events WHERE ts >= TIMESTAMP '{WINDOW[0]}' AND ts < TIMESTAMP '{WINDOW[1]}' GROUP BY event_type""")
def i1_sketches(spark, sf_dir):
    """I1/I2 of a window from stored per-minute sketches: exact counts, averages and extremes, and percentiles whose
    ranks among the window's latencies are at most 1 % off."""
    log = _log(spark, sf_dir)
    start, end = (F.to_timestamp(F.lit(t)) for t in WINDOW)
    stats = materialize(window_stats(materialize(latency_sketches(log), "sketches"), start, end), "window-stats")
    some = log.where((F.col("ts") >= start) & (F.col("ts") < end) & F.col("ok")).join(bounded_broadcast(stats.select("endpoint", "p50", "p95", "p99", "p999"), 100_000), "endpoint")
    ok = F.lit(True)
    for p, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999")):
        n = F.count(F.lit(1))
        ok = ok & (F.count_if(F.col("latency") <= F.col(c)) >= (p - 0.01) * n) & (F.count_if(F.col("latency") < F.col(c)) <= (p + 0.01) * n)
    ranks = some.groupBy("endpoint").agg(ok.alias("ranks_within_1_percent"))
    return stats.drop("p50", "p95", "p99", "p999").join(ranks, "endpoint", "left")


SPLIT = "2024-01-16 00:00:00"


def _halves_compared(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cache:
        log = _log(spark, sf_dir)
        paths = []
        for cond in (F.col("ts") < F.to_timestamp(F.lit(SPLIT)), F.col("ts") >= F.to_timestamp(F.lit(SPLIT))):
            path = shared_path(spark, "perf-stats")
            write_stats_csv(to_stats_csv_frame(endpoint_stats(log.where(cond))), path)  # A16 write
            paths.append(path)
        _cache[key] = paths
    base, cur = [canonical_endpoints(read_stats_csv(spark, p)) for p in _cache[key]]  # A16 read, I3
    return compare_runs(base, cur)


I4_SQL = f"""WITH b AS ({_stats_sql(f"ts < TIMESTAMP '{SPLIT}'")}), c AS ({_stats_sql(f"ts >= TIMESTAMP '{SPLIT}'")})
SELECT b.endpoint AS name, b.requests_per_s AS base_rps, coalesce(c.requests_per_s, 0.0) AS cur_rps,
  CASE WHEN b.requests_per_s > 0 THEN (coalesce(c.requests_per_s, 0.0) - b.requests_per_s) / b.requests_per_s * 100
  END AS rps_delta_pct,
  b.avg_latency AS base_lat, coalesce(c.avg_latency, 0.0) AS cur_lat,
  CASE WHEN b.avg_latency > 0 THEN (b.avg_latency - coalesce(c.avg_latency, 0.0)) / b.avg_latency * 100
  END AS latency_delta_pct
FROM b LEFT JOIN c USING (endpoint)"""


@register("i3_i4_a16_compare_runs", I4_SQL)
def i4_compare(spark, sf_dir):
    """Stats of the two halves of the month written as perf-stats CSV, read back
    by header name, canonicalised, and compared (left join on the baseline)."""
    return _halves_compared(spark, sf_dir)


I5_SQL = f"""WITH c AS ({I4_SQL})
SELECT name, '| ' || name || ' | ' || printf('%.2f', base_rps) || ' | ' || printf('%.2f', cur_rps) || ' | **+'
  || coalesce(printf('%.1f', rps_delta_pct) || '%', 'N/A') || '** | ' || printf('%.2f', base_lat) || ' | '
  || printf('%.2f', cur_lat) || ' | **-' || coalesce(printf('%.1f', latency_delta_pct) || '%', 'N/A') || '** |' AS line
FROM c"""


@register("i5_report_lines", I5_SQL)
def i5_report(spark, sf_dir):
    """One formatted report row per endpoint."""
    return report_lines(_halves_compared(spark, sf_dir))
