"""Latency / throughput reporting over a request log.

Request log: ``(endpoint, ts, latency, ok)``. Statistics are one ``groupBy(endpoint)``
with partial aggregation; the elapsed time of the whole log is a one-row aggregate
joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .sizing import attach_scalars, bounded_broadcast

# Fixed values that must equal the reference: endpoint name canonicalisation and the
# row names that are dropped.
ENDPOINT_NAMES = {
    "/api/v2/search": "/api/v2/Standard",
    "/api/v2/search/intelligent (Semantic)": "/api/v2/Semantic",
    "/api/v2/search/intelligent (Agentic)": "/api/v2/Agentic",
}
DROPPED_NAMES = ("Aggregated", "")

PERCENTILES = (0.5, 0.95, 0.99, 0.999)


def exact_percentiles(df: DataFrame, group: str, value: str, ps=PERCENTILES,
                      names=("p50", "p95", "p99", "p999")) -> DataFrame:
    """Exact percentiles with linear interpolation (same definition as ``percentile`` /
    ``quantile_cont``), computed without putting any group in one task or buffer.

    1. rows are counted per (group, value) — a partial aggregation;
    2. those counts are range-partitioned on (group, value), so a group holding a third of
       all values spans many tasks; inside each slice a running count per group gives
       local ranks;
    3. per (slice, group) totals — one small row per slice — become offsets through a
       window over that small table, broadcast back: global rank = offset + local rank;
    4. each percentile picks the values at ranks floor/ceil((n-1)p) with an equi-join on
       the group and a rank-range condition.
    """
    spark = df.sparkSession
    vc = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = (vc.repartitionByRange(parts, group, value).sortWithinPartitions(group, value)
              .withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", group).orderBy(value).rowsBetween(Window.unboundedPreceding,
                                                                          Window.currentRow)
    # written once: range bounds are sampled, so running the exchange twice may slice differently
    sliced = materialize(sliced.withColumn("_lhi", F.sum("_c").over(local)), "percentile-slices")
    totals = sliced.groupBy("_pid", group).agg(F.sum("_c").alias("_t"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    cum = (sliced.join(bounded_broadcast(offsets, 1_000_000), ["_pid", group])  # one row per (slice, group)
           .select(group, value, (F.col("_off") + F.col("_lhi")).alias("_hi"), "_c"))
    cum = cum.withColumn("_lo", F.col("_hi") - F.col("_c"))
    n = totals.groupBy(group).agg(F.sum("_t").alias("_n"))
    targets = n.select(group, "_n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"))
                                                        for i, p in enumerate(ps)])).alias("_q"))
    targets = targets.select(group, "_q.i", ((F.col("_n") - 1) * F.col("_q.p")).alias("_h"))
    ranks = targets.select(group, "i", "_h", F.floor("_h").alias("_r"), F.lit(0).alias("_side")).unionByName(
        targets.select(group, "i", "_h", F.ceil("_h").alias("_r"), F.lit(1).alias("_side")))
    c = cum.select(F.col(group).alias("_g"), F.col(value).alias("_v"), "_lo", "_hi")
    ranks = bounded_broadcast(ranks, 1_000_000)  # 2 rows per group and percentile
    picked = ranks.join(c, (ranks[group] == c["_g"]) & (ranks["_r"] >= c["_lo"]) & (ranks["_r"] < c["_hi"]))
    per = picked.groupBy(group, "i", "_h").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_v0"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_v1"))
    val = F.col("_v0") + (F.col("_h") - F.floor("_h")) * (F.col("_v1") - F.col("_v0"))
    return per.groupBy(group).agg(*[F.max(F.when(F.col("i") == i, val)).alias(nm) for i, nm in enumerate(names)])


def endpoint_stats(log: DataFrame, exact: bool = True, elapsed: float | None = None) -> DataFrame:
    """Per endpoint request/failure counts, latency avg/min/max/percentiles over
    successful requests (0 when none succeeded), requests/s and failures/s over the
    log's elapsed time: ``elapsed`` seconds, by default last ts − first ts (NULL rates if that is 0).

    ``exact=True`` uses ``exact_percentiles`` (distributed, exact); ``exact=False`` uses
    ``percentile_approx`` (one bounded sketch per endpoint, no extra shuffle).
    """
    measured = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    span = log.agg((measured if elapsed is None else F.lit(float(elapsed))).alias("elapsed"))
    ok_lat = F.when(F.col("ok"), F.col("latency"))
    aggs = [F.count(F.lit(1)).alias("request_count"), F.count_if(~F.col("ok")).alias("failure_count"),
            F.avg(ok_lat).alias("avg_latency"), F.min(ok_lat).alias("min_latency"),
            F.max(ok_lat).alias("max_latency")]
    names = ("p50", "p95", "p99", "p999")
    if exact:
        g = log.groupBy("endpoint").agg(*aggs)
        pct = exact_percentiles(log.where(F.col("ok")), "endpoint", "latency", PERCENTILES, names)
        g = g.join(pct, "endpoint", "left")
    else:
        approx = F.percentile_approx(ok_lat, list(PERCENTILES), 10000).cast("array<double>")
        g = log.groupBy("endpoint").agg(*aggs, approx.alias("_p")).select(
            "*", *[F.col("_p")[i].alias(n) for i, n in enumerate(names)]).drop("_p")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    # averages and interpolated percentiles are reported rounded to 9 decimals, so the
    # result does not depend on the order in which a cluster happened to add values
    r9 = lambda c: F.round(c, 9)
    return attach_scalars(g, span).select(
        "endpoint", "request_count", "failure_count",
        z(r9(F.col("avg_latency"))).alias("avg_latency"),
        z(F.col("min_latency").cast("double")).alias("min_latency"),
        z(F.col("max_latency").cast("double")).alias("max_latency"),
        F.try_divide(F.col("request_count"), F.col("elapsed")).alias("requests_per_s"),
        F.try_divide(F.col("failure_count"), F.col("elapsed")).alias("failures_per_s"),
        *[z(r9(F.col(n))).alias(n) for n in names])


SKETCH_K = 800  # KLL parameter: ranks within 0.5 % or so, some kilobytes a sketch


def latency_sketches(log: DataFrame, ok_only: bool = True) -> DataFrame:
    """One mergeable row for each endpoint and minute, ``(endpoint, minute, request_count, failure_count, total, min_latency,
    max_latency, sketch)``: counts, sums and a KLL sketch of latencies. Stored, they answer for any window of
    minutes without the log, and minutes may be added as they come."""
    lat = F.when(F.col("ok"), F.col("latency")) if ok_only else F.col("latency")
    return (log.withColumn("minute", F.date_trunc("minute", "ts")).groupBy("endpoint", "minute")
            .agg(F.count(F.lit(1)).alias("request_count"), F.count_if(~F.col("ok")).alias("failure_count"), F.sum(lat).alias("total"),
                 F.min(lat).alias("min_latency"), F.max(lat).alias("max_latency"), F.kll_sketch_agg_double(lat.cast("double"), SKETCH_K).alias("sketch")))


def window_stats(sketches: DataFrame, start=None, end=None, ps=PERCENTILES, names=("p50", "p95", "p99", "p999")) -> DataFrame:
    """I1/I2 from stored minutes, ``start`` (inclusive) to ``end`` (exclusive): per endpoint counts, average, extremes and
    approximate percentiles (NULL without a successful request). Only the window's minutes are read and merged."""
    s = sketches
    if start is not None:
        s = s.where(F.col("minute") >= F.lit(start))
    if end is not None:
        s = s.where(F.col("minute") < F.lit(end))
    g = s.groupBy("endpoint").agg(F.sum("request_count").alias("request_count"), F.sum("failure_count").alias("failure_count"), F.sum("total").alias("_total"),
                                  F.min("min_latency").alias("min_latency"), F.max("max_latency").alias("max_latency"), F.kll_merge_agg_double("sketch").alias("_s"))
    some = F.col("_n") > 0
    return (g.withColumn("_n", F.kll_sketch_get_n_double("_s"))
            .select("endpoint", "request_count", "failure_count", F.round(F.try_divide(F.col("_total"), F.col("_n")), 9).alias("avg_latency"), "min_latency", "max_latency",
                    *[F.when(some, F.kll_sketch_get_quantile_double("_s", F.lit(p))).alias(n) for p, n in zip(ps, names)]))


def to_stats_csv_frame(stats: DataFrame, method: str = "POST") -> DataFrame:
    """The 14-column perf-stats layout (median column = p50)."""
    return stats.select(F.lit(method).alias("Type"), F.col("endpoint").alias("Name"),
                        F.col("request_count").alias("Request Count"), F.col("failure_count").alias("Failure Count"),
                        F.col("p50").alias("Median Response Time"), F.col("avg_latency").alias("Average Response Time"),
                        F.col("min_latency").alias("Min Response Time"),
                        F.col("max_latency").alias("Max Response Time"),
                        F.col("requests_per_s").alias("Requests/s"), F.col("failures_per_s").alias("Failures/s"),
                        F.col("p50").alias("50%"), F.col("p95").alias("95%"), F.col("p99").alias("99%"),
                        F.col("p999").alias("99.9%"))


def write_stats_csv(stats_csv: DataFrame, path: str) -> None:
    stats_csv.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_stats_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a perf-stats CSV by header name (column order differs between files)."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    dbl = lambda c: F.expr(f"try_cast(`{c}` as double)")
    return df.select(F.col("Name").alias("name"), dbl("Requests/s").alias("requests_per_s"),
                     dbl("Average Response Time").alias("avg_latency"), dbl("Failures/s").alias("failures_per_s"))


def canonical_endpoints(stats: DataFrame, name: str = "name") -> DataFrame:
    """Map long endpoint names to short ones and drop the totals / blank rows. Of several rows with one
    short name the last one read stays."""
    m = F.create_map(*[x for kv in ENDPOINT_NAMES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    n = F.coalesce(F.col(name), F.lit(""))
    rows = (stats.withColumn("_at", F.monotonically_increasing_id()).withColumn(name, F.coalesce(F.element_at(m, n), n))
            .where(~F.col(name).isin(*DROPPED_NAMES)))
    last = rows.groupBy(name).agg(F.max_by(F.struct(*[c for c in stats.columns if c != name]), "_at").alias("_r"))
    return last.select(name, "_r.*").select(*stats.columns)


def compare_runs(base: DataFrame, current: DataFrame) -> DataFrame:
    """I4: baseline rows left-joined to the current run by endpoint name; a missing
    current value is 0; deltas in percent (rounded only when printed), NULL (N/A) when
    the baseline value is 0."""
    b = base.select("name", F.col("requests_per_s").alias("base_rps"), F.col("avg_latency").alias("base_lat"))
    c = current.select("name", F.col("requests_per_s").alias("cur_rps"), F.col("avg_latency").alias("cur_lat"))
    j = b.join(c, "name", "left").fillna(0.0, ["cur_rps", "cur_lat"])
    return j.select(
        "name", "base_rps", "cur_rps",
        F.when(F.col("base_rps") > 0, (F.col("cur_rps") - F.col("base_rps")) / F.col("base_rps") * 100)
        .alias("rps_delta_pct"),
        "base_lat", "cur_lat",
        F.when(F.col("base_lat") > 0, (F.col("base_lat") - F.col("cur_lat")) / F.col("base_lat") * 100)
        .alias("latency_delta_pct"))


def _fmt(c, digits: int):
    # format_number rounds half-even on the exact binary value (like Python's format);
    # drop its grouping separators
    return F.regexp_replace(F.format_number(c, digits), ",", "")


def report_lines(cmp: DataFrame) -> DataFrame:
    """One markdown table row per endpoint, as the reference's report prints it."""
    pct = lambda c: F.coalesce(F.concat(_fmt(F.col(c), 1), F.lit("%")), F.lit("N/A"))
    line = F.concat(F.lit("| "), F.col("name"), F.lit(" | "), _fmt(F.col("base_rps"), 2), F.lit(" | "),
                    _fmt(F.col("cur_rps"), 2), F.lit(" | **+"), pct("rps_delta_pct"), F.lit("** | "),
                    _fmt(F.col("base_lat"), 2), F.lit(" | "), _fmt(F.col("cur_lat"), 2), F.lit(" | **-"),
                    pct("latency_delta_pct"), F.lit("** |"))
    return cmp.select("name", line.alias("line"))

