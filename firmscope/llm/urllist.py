"""URL filter by dated lists: a temporal join.

A list is a log of dated entries: at a time, a pattern (a host, or a host with the first part of
its path) is added or removed. A pattern's entries in order of time give validity intervals, half
open; an entry that nothing ends has none (null). A capture is tested against the patterns its URL matches (its host, each parent domain of at
least two labels, and the same with the first path part), as of its fetch time.

The as-of join is an equi-join on pattern and ``SLICE``-long slice of time, with the interval as the
remaining condition: a capture lies in one slice, and an interval is put into those of its slices that
captures of its pattern lie in, so a long interval costs no more rows than it has such slices. A pattern's
intervals don't overlap, so a capture meets one at most for each of its patterns, and a host with very
many captures is spread over the slices (and split further by adaptive skew joins). Functions of
DataFrames only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a slice of the join.
SLICE = 30 * 86400
IPV4 = r"^[0-9]+(\.[0-9]+){3}$"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and closing dots; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def first_path_part(url: Column) -> Column:
    part = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*/([^/?#]+)", 1)
    return F.when(part != "", part)


def patterns_of(host: Column, part: Column) -> Column:
    """The patterns that match: host and parent domains (an address of numbers has none), each alone and with the first
    path part."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.when((n < 2) | host.rlike(IPV4), F.array(host)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))
    with_part = F.when(part.isNotNull(), F.transform(domains, lambda d: F.concat(d, F.lit("/"), part))).otherwise(F.array().cast("array<string>"))
    return F.concat(domains, with_part)


def intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, valid_from, valid_to)`` from ``(pattern, at, action)``, ``at`` in epoch seconds, action
    ``add`` or ``remove``. Of entries at one time a removal counts; adding what is listed, or removing what
    isn't, changes nothing. Entries with a null are left out. The last interval of a pattern still listed has no end."""
    log = entries.where("pattern is not null and at is not null and action is not null")
    log = log.groupBy("pattern", "at").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("off"))
    order = Window.partitionBy("pattern").orderBy("at")
    log = log.withColumn("was", F.lag("off").over(order)).where((F.coalesce("was", F.lit(1)) != F.col("off")))
    log = log.withColumn("valid_to", F.lead("at").over(order))
    return log.where("off = 0").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(page_id, url, fetched)`` with ``host``, ``blocked``, and of the most specific pattern listed
    at the fetch time (the longest; ties to the smaller) ``pattern``, ``valid_from`` and ``valid_to``.

    A null or relative URL, or a null time, matches nothing and is not blocked. Rows alike in all three
    columns are judged together and each stay. An empty list blocks nothing; no captures, no rows.
    """
    c = captures.select("page_id", "url", F.col("fetched").cast("long").alias("fetched"))
    c = c.groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("host", host_of(F.col("url")))
    tested = c.withColumn("pattern", F.explode_outer(patterns_of(F.col("host"), first_path_part(F.col("url")))))
    tested = tested.withColumn("slice", F.floor(F.col("fetched") / SLICE))
    valid = intervals(entries).withColumnRenamed("pattern", "listed")
    touched = tested.where("pattern is not null and slice is not null").select(F.col("pattern").alias("listed"), F.col("slice").alias("in_slice")).distinct()
    first, last = F.floor(F.col("valid_from") / SLICE), F.floor((F.col("valid_to") - 1) / SLICE)
    valid = touched.join(valid, "listed").where((F.col("in_slice") >= first) & (F.col("valid_to").isNull() | (F.col("in_slice") <= last)))
    meets = ((F.col("pattern") == F.col("listed")) & (F.col("slice") == F.col("in_slice")) & (F.col("fetched") >= F.col("valid_from"))
             & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    hit = F.struct(F.length("listed").alias("l"), F.col("listed").alias("pattern"), "valid_from", "valid_to")
    found = tested.join(valid, meets, "left").select("page_id", "url", "fetched", "host", "n", F.when(F.col("listed").isNotNull(), hit).alias("hit"))
    # the longest pattern; two of one length can't both match one URL but as domain and as domain with path
    best = found.groupBy("page_id", "url", "fetched", "host", "n").agg(F.max("hit").alias("hit"))
    out = best.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    return out.select("page_id", "url", "fetched", "host", F.col("hit").isNotNull().alias("blocked"), "hit.pattern", "hit.valid_from", "hit.valid_to")


# The registered query: pages have no fetch times and no lists come with them, so both are derived
# from the pages by plain arithmetic. Captures are spread over 2024; a host whose smallest page id is
# 0 modulo 3 is listed at a time given by that id, taken off 90 days later and listed again after 30 more;
# the first path part of a host's smallest page is listed for good if that id is 1 modulo 5.
START, YEAR = 1704067200, 366 * 86400


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(START) + F.pmod(F.col("page_id") * 7919 * 61, F.lit(YEAR))).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    hosts = (pages.select("page_id", host_of(F.col("url")).alias("host"), first_path_part(F.col("url")).alias("part")).where("host is not null and page_id is not null")
             .groupBy("host").agg(F.min(F.struct("page_id", "part")).alias("m")).select("host", "m.page_id", "m.part"))
    at = F.lit(START) + F.pmod(F.col("page_id") * 104729, F.lit(YEAR))
    domain = (hosts.where(F.pmod("page_id", F.lit(3)) == 0)
              .select(F.col("host").alias("pattern"), F.explode(F.array(F.struct(at.alias("at"), F.lit("add").alias("action")),
                                                                        F.struct((at + 90 * 86400).alias("at"), F.lit("remove").alias("action")),
                                                                        F.struct((at + 120 * 86400).alias("at"), F.lit("add").alias("action")))).alias("e")))
    path = (hosts.where((F.pmod("page_id", F.lit(5)) == 1) & F.col("part").isNotNull())
            .select(F.concat("host", F.lit("/"), "part").alias("pattern"), F.struct(at.alias("at"), F.lit("add").alias("action")).alias("e")))
    return domain.union(path).select("pattern", "e.at", "e.action")


def op5_rows(pages: DataFrame) -> DataFrame:
    return filter_captures(captures_of(pages), entries_of(pages))


OP5_SQL = f"""
WITH p AS (
  SELECT page_id, url, {START} + ((page_id * 7919 * 61) % {YEAR}) AS fetched,
    nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#\\\\]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '\\.+$', ''), '') AS host,
    nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#\\\\]*/([^/?#]+)', 1), '') AS part
  FROM pages),
h AS (SELECT host, min(page_id) AS page_id, arg_min(part, page_id) AS part FROM (SELECT host, page_id, coalesce(part, '') AS part FROM p WHERE host IS NOT NULL) GROUP BY host),
log AS (
  SELECT host AS pattern, {START} + ((page_id * 104729) % {YEAR}) + d AS tm, act FROM h, (VALUES (0, 'add'), ({90 * 86400}, 'remove'), ({120 * 86400}, 'add')) t(d, act) WHERE page_id % 3 = 0
  UNION ALL
  SELECT host || '/' || part, {START} + ((page_id * 104729) % {YEAR}), 'add' FROM h WHERE page_id % 5 = 1 AND part <> ''),
iv AS (SELECT pattern, tm AS valid_from, lead(tm) OVER (PARTITION BY pattern ORDER BY tm) AS valid_to, act FROM log),
pat AS (
  SELECT page_id, d AS pattern FROM (SELECT page_id, unnest(CASE WHEN len(l) < 2 OR regexp_matches(host, '{IPV4}') THEN [host] ELSE list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.')) END) AS d
    FROM (SELECT page_id, host, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL))),
both_ AS (SELECT page_id, pattern FROM pat UNION ALL SELECT pat.page_id, pattern || '/' || part FROM pat JOIN p USING (page_id) WHERE part IS NOT NULL),
hit AS (
  SELECT p.page_id, iv.pattern, valid_from, valid_to, row_number() OVER (PARTITION BY p.page_id ORDER BY length(iv.pattern) DESC, iv.pattern DESC) AS i
  FROM p JOIN both_ USING (page_id) JOIN iv ON iv.pattern = both_.pattern AND act = 'add' AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to))
SELECT p.page_id, p.url, p.fetched, p.host, hit.pattern IS NOT NULL AS blocked, hit.pattern, hit.valid_from, hit.valid_to
FROM p LEFT JOIN hit ON hit.page_id = p.page_id AND hit.i = 1
"""
