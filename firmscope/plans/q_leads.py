"""Registered lead-synthesis queries: evidence from ``pages`` (queries = URL hosts),
model answers derived from ``part``, tasks from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import raw_cache_key
from ..operators.cache import CACHE_SCHEMA, EVIDENCE_TTL_SECONDS, cache_fill, cache_lookup
from ..operators.leads import (NO_NEWS, PROMPT_HEAD, PROMPT_QUERY, PROMPT_TAIL, SEARCH_UNAVAILABLE, TASK_NAME,
                               context_with_fallback, dead_letters, dispatch_records, evidence_context,
                               explode_leads, parse_leads, prompt, synthesize, task_status)
from ..sources.tables import read_table
from .q_intent import E5_SQL, _resolved
from .registry import register
from .sqlparts import sql_type_ok, sql_whole

HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def _sq(s: str) -> str:
    """Python string → DuckDB literal (newlines kept as characters)."""
    return "'" + s.replace("'", "''") + "'"


def _evidence(spark, sf_dir):
    """Evidence rows: one per page; query = URL host, rank = page_id, content = the whole page."""
    p = read_table(spark, sf_dir, "pages")
    return p.select(F.regexp_extract("url", HOST_RE, 1).alias("query_id"), F.col("page_id").alias("rank"), "url",
                    F.col("html").alias("content"))


def _host_queries(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return (p.select(F.regexp_extract("url", HOST_RE, 1).alias("query_id")).distinct()
            .withColumn("query", F.concat(F.lit("news about "), F.col("query_id")))
            .withColumn("failed", F.col("query_id").endswith(".net")))


EVID_SQL = f"""SELECT regexp_extract(url, '{HOST_RE}', 1) AS query_id, page_id AS rank, url,
  html AS content FROM pages"""

G1_SQL = f"""WITH e AS ({EVID_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS rn FROM e)
SELECT query_id, string_agg('Source: ' || coalesce(url, '') || chr(10) || 'Snippet: ' || coalesce(content, ''),
  chr(10) || chr(10) ORDER BY rn) AS context FROM r WHERE rn <= 3 GROUP BY query_id"""


@register("g1_evidence_context", G1_SQL)
def g1_context(spark, sf_dir):
    """G1: top-3 evidence snippets per query joined into one context text."""
    return evidence_context(_evidence(spark, sf_dir))


HOSTS_SQL = f"""SELECT DISTINCT regexp_extract(url, '{HOST_RE}', 1) AS query_id FROM pages"""

G2_SQL = f"""WITH h AS ({HOSTS_SQL}), c AS ({G1_SQL})
SELECT h.query_id, CASE WHEN ends_with(h.query_id, '.net') THEN {_sq(SEARCH_UNAVAILABLE)}
  ELSE coalesce(c.context, {_sq(NO_NEWS)}) END AS context,
  {_sq(PROMPT_HEAD)} || CASE WHEN ends_with(h.query_id, '.net') THEN {_sq(SEARCH_UNAVAILABLE)}
  ELSE coalesce(c.context, {_sq(NO_NEWS)}) END || {_sq(PROMPT_QUERY)} || 'news about ' || h.query_id
  || {_sq(PROMPT_TAIL)} AS prompt
FROM h LEFT JOIN c USING (query_id)"""


@register("g2_b18_context_fallback_prompt", G2_SQL)
def g2_fallback(spark, sf_dir):
    """No evidence → no-news sentence, failed search → unavailable sentence;
    then the prompt text around context and query."""
    q = _host_queries(spark, sf_dir)
    c = context_with_fallback(q, evidence_context(_evidence(spark, sf_dir)), "failed")
    return c.select("query_id", "context", prompt("context", "query").alias("prompt"))


def _payloads(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    lead1 = F.concat(F.lit('{"name": "'), F.col("p_name"), F.lit('", "industry": "'), F.col("p_type"),
                     F.lit('", "domain": "'), F.lower("p_brand"), F.lit('", "year_founded": '),
                     (F.lit(1950) + F.col("p_size")).cast("string"),
                     F.when(k % 13 == 0, '.0').when(k % 17 == 0, '.5').when(k % 19 == 0, ', "locality": null')
                     .when(k % 23 == 0, ', "name2": 1, "size_range": 5').when(k % 29 == 0, ', "domain2": null, "locality": "x"').otherwise(""), F.lit("}"))
    lead2 = F.when(k % 11 == 0, F.concat(F.lit('{"name": "'), F.col("p_name"), F.lit(' two"}'))).otherwise(
        F.concat(F.lit('{"name": "'), F.col("p_name"), F.lit(' two", "industry": "'), F.col("p_type"),
                 F.lit('", "country": "us", "size_range": "11-50"}')))
    full = F.concat(F.lit('{"summary": "'), F.col("p_name"), F.lit(' summary", "leads": ['), lead1, F.lit(", "),
                    lead2, F.lit("]}"))
    payload = F.when(k % 7 == 0, F.substring(full, 1, 30)).otherwise(full)
    return p.select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("query"), payload.alias("payload"))


PAYLOAD_SQL = """SELECT p_partkey AS task_id, p_name AS query, CASE WHEN p_partkey % 7 = 0 THEN left(payload_full, 30)
  ELSE payload_full END AS payload FROM (SELECT *, '{"summary": "' || p_name || ' summary", "leads": [' ||
  '{"name": "' || p_name || '", "industry": "' || p_type || '", "domain": "' || lower(p_brand)
  || '", "year_founded": ' || CAST(1950 + p_size AS VARCHAR) || CASE WHEN p_partkey % 13 = 0 THEN '.0' WHEN p_partkey % 17 = 0 THEN '.5'
  WHEN p_partkey % 19 = 0 THEN ', "locality": null' WHEN p_partkey % 23 = 0 THEN ', "name2": 1, "size_range": 5'
  WHEN p_partkey % 29 = 0 THEN ', "domain2": null, "locality": "x"' ELSE '' END || '}, ' ||
  CASE WHEN p_partkey % 11 = 0 THEN '{"name": "' || p_name || ' two"}'
  ELSE '{"name": "' || p_name || ' two", "industry": "' || p_type || '", "country": "us", "size_range": "11-50"}' END
  || ']}' AS payload_full FROM part)"""

_LEAD_OK = " AND ".join(
    [sql_type_ok("x", "$.name", "text"), sql_type_ok("x", "$.industry", "text")]
    + [f"(json_type(x, '$.{f}') IS NULL OR json_type(x, '$.{f}') = 'NULL' OR {sql_type_ok('x', f'$.{f}', k)})" for f, k in (("domain", "text"), ("year_founded", "whole"))]
    + [f"(json_type(x, '$.{f}') IS NULL OR {sql_type_ok('x', f'$.{f}', 'text')})" for f in ("locality", "country", "size_range")])

VALID_SQL = ("CASE WHEN coalesce(json_valid(payload), false) THEN json_type(payload) = 'OBJECT' "
             f"AND {sql_type_ok('payload', '$.summary', 'text')} AND coalesce(json_type(payload, '$.leads') = 'ARRAY', false) "
             f"AND coalesce(list_bool_and(list_transform(CAST(json_extract(payload, '$.leads[*]') AS JSON[]), lambda x: {_LEAD_OK})), true) ELSE false END")

G34_SQL = f"""WITH p AS ({PAYLOAD_SQL}), v AS (SELECT *, {VALID_SQL} AS valid FROM p),
e AS (SELECT v.task_id, v.payload, pos FROM v, LATERAL (SELECT unnest(range(CAST(json_array_length(v.payload, '$.leads') AS BIGINT)))
      AS pos) WHERE v.valid),
l AS (SELECT task_id, CAST(pos AS INTEGER) AS pos, json_extract(payload, '$.leads[' || pos || ']') AS lead,
      json_extract_string(payload, '$.summary') AS summary FROM e)
SELECT task_id, pos, md5(CAST(task_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR)) AS lead_id,
  json_extract_string(lead, '$.name') AS name, json_extract_string(lead, '$.industry') AS industry,
  json_extract_string(lead, '$.domain') AS domain, coalesce(json_extract_string(lead, '$.locality'), '') AS locality,
  coalesce(json_extract_string(lead, '$.country'), '') AS country,
  {sql_whole('lead', '$.year_founded')} AS year_founded,
  coalesce(json_extract_string(lead, '$.size_range'), 'Unknown') AS size_range, summary FROM l"""


@register("g3_g4_g5_explode_leads", G34_SQL)
def g34_leads(spark, sf_dir):
    """Validated model answers → one row per lead with defaults and a stable id."""
    return explode_leads(parse_leads(_payloads(spark, sf_dir)))


G6_SQL = f"""WITH p AS ({PAYLOAD_SQL}), v AS (SELECT *, {VALID_SQL} AS valid FROM p)
SELECT CAST(task_id AS VARCHAR) AS task_id, {_sq(TASK_NAME)} AS task_name, '["' || query || '"]' AS args,
  '{{}}' AS kwargs, CASE WHEN payload IS NULL THEN 'empty model response'
  WHEN NOT coalesce(json_valid(payload), false) THEN 'invalid JSON'
  ELSE 'validation error: a field is missing or of another type' END AS exception, CAST(NULL AS VARCHAR) AS traceback
FROM v WHERE NOT valid"""


@register("g6_dead_letters", G6_SQL)
def g6_dead(spark, sf_dir):
    """Failed answers to the dead-letter table with task id, name, args, kwargs, exception."""
    return dead_letters(parse_leads(_payloads(spark, sf_dir)))


G7_SQL = """SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING'
  WHEN 'P' THEN 'failed' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderstatus = 'F' THEN 'leads for ' || o_orderpriority
    WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'revoked: ' || o_orderpriority
    WHEN o_orderstatus = 'P' THEN 'error: ' || o_orderpriority END AS result FROM orders"""


@register("g7_task_status", G7_SQL)
def g7_status(spark, sf_dir):
    """Task state → PENDING / SUCCESS + result / 'failed' + error text."""
    o = read_table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    tasks = o.select(F.col("o_orderkey").alias("task_id"),
                     F.when(st == "F", "SUCCESS").when(st == "O", "PENDING")
                     .when((st == "P") & (F.col("o_orderkey") % 2 == 0), "REVOKED").when(st == "P", "FAILURE")
                     .otherwise(st).alias("state"),
                     F.when(st == "F", F.concat(F.lit("leads for "), F.col("o_orderpriority")))
                     .when((st == "P") & (F.col("o_orderkey") % 2 == 0), F.concat(F.lit("revoked: "), F.col("o_orderpriority")))
                     .when(st == "P", F.concat(F.lit("error: "), F.col("o_orderpriority"))).alias("result"))
    return task_status(tasks)


G9_SQL = f"""WITH r AS ({E5_SQL}), q AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations
  WHERE role = 'user')
SELECT md5('task:' || CAST(r.query_id AS VARCHAR)) AS task_id, r.query_id, q.query, 'processing' AS status
FROM r JOIN q USING (query_id) WHERE r.requires_agent"""


@register("g9_dispatch_records", G9_SQL)
def g9_dispatch(spark, sf_dir):
    """One 'processing' task per query routed to the agentic branch."""
    return dispatch_records(_resolved(spark, sf_dir))


@register("g8_leads_replace_results", f"""WITH r AS (SELECT * FROM ({__import__('firmscope.plans.q_retrieval',
    fromlist=['D14_SQL']).D14_SQL})), l AS (SELECT * FROM ({G34_SQL}))
SELECT query_id, origin, count(*) AS n_items FROM (
  SELECT query_id, 'search' AS origin FROM r WHERE query_id NOT IN (SELECT task_id FROM l)
  UNION ALL SELECT task_id AS query_id, 'leads' AS origin FROM l WHERE task_id IN (SELECT item_id FROM benchmark))
GROUP BY ALL""")
def g8_replace(spark, sf_dir):
    """Per benchmark query, its synthesized leads (task id = query id) replace the
    search results when there are any; otherwise the search results stay."""
    from ..operators.leads import leads_replace_results
    from .q_retrieval import d14_two_stage
    res = d14_two_stage(spark, sf_dir).select("query_id", "doc_id")
    ids = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    leads = explode_leads(parse_leads(_payloads(spark, sf_dir))).select(F.col("task_id").alias("query_id"),
                                                                        "lead_id")
    leads = leads.join(ids, "query_id", "left_semi")
    out = leads_replace_results(res, leads)
    return out.groupBy("query_id", "origin").agg(F.count(F.lit(1)).alias("n_items"))


_F3_NOW = "2024-01-02 00:00:00"

F3_SQL = f"""WITH h AS ({HOSTS_SQL}),
c AS (SELECT 'news_cache:' || md5('news about ' || query_id) AS key, CASE WHEN ends_with(query_id, '.org') THEN '' ELSE 'old news of ' || query_id END AS value,
  TIMESTAMP '{_F3_NOW}' - to_hours(CAST(length(query_id) % 24 AS INTEGER)) AS filled_at FROM h WHERE NOT ends_with(query_id, '.net'))
SELECT h.query_id, CASE WHEN c.value <> '' THEN c.value END AS cached_value, coalesce(c.value <> '', false) AS cache_hit
FROM h LEFT JOIN c ON c.key = 'news_cache:' || md5('news about ' || h.query_id) AND TIMESTAMP '{_F3_NOW}' >= c.filled_at
  AND TIMESTAMP '{_F3_NOW}' < c.filled_at + INTERVAL 12 HOUR"""


@register("f3_evidence_cache", F3_SQL)
def f3_evidence(spark, sf_dir):
    """evidence texts set and got on the raw query's key; plain text, 12 h, an empty text is a miss."""
    q = _host_queries(spark, sf_dir).select("query_id", "query")
    now = F.to_timestamp(F.lit(_F3_NOW))
    host = F.col("query_id")
    e = q.where(~host.endswith(".net")).select(
        raw_cache_key("news_cache:", "query").alias("key"), F.when(host.endswith(".org"), "").otherwise(F.concat(F.lit("old news of "), host)).alias("value"),
        (now - F.make_interval(hours=(F.length(host) % 24).cast("int"))).alias("filled_at"))
    table = cache_fill(spark.createDataFrame([], CACHE_SCHEMA), e, EVIDENCE_TTL_SECONDS)
    got = cache_lookup(q, table, raw_cache_key("news_cache:", "query"), now, json_values=False)
    return got.select("query_id", "cached_value", "cache_hit")


# the agentic queries' tasks; evidence: page p is a source for the turns of conversation p / 4; the search fails for
# every 13th conversation; answers by the query's id: one lead, two, none at all, cut off, a lead without industry
JOB_SQL = f"""WITH t AS ({G9_SQL}),
e AS (SELECT t.query_id, page_id AS rank, url, html AS content FROM pages JOIN t ON page_id // 4 = t.query_id // 1000),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS rn FROM e),
c AS (SELECT query_id, string_agg('Source: ' || coalesce(url, '') || chr(10) || 'Snippet: ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY rn) AS context
      FROM r WHERE rn <= 3 GROUP BY query_id),
x AS (SELECT t.*, CASE WHEN (t.query_id // 1000) % 13 = 5 THEN {_sq(SEARCH_UNAVAILABLE)} ELSE coalesce(c.context, {_sq(NO_NEWS)}) END AS context FROM t LEFT JOIN c USING (query_id)),
n AS (SELECT *, length({_sq(PROMPT_HEAD)} || context || {_sq(PROMPT_QUERY)} || query || {_sq(PROMPT_TAIL)}) AS n FROM x),
l AS (SELECT *, {{'name': 'company ' || n, 'industry': 'web', 'domain': NULL::VARCHAR, 'locality': '', 'country': '', 'year_founded': NULL::INTEGER, 'size_range': 'Unknown', 'id': md5(task_id || ':0')}} AS one,
             {{'name': 'second', 'industry': 'news', 'domain': 'b.example', 'locality': '', 'country': '', 'year_founded': 1990, 'size_range': 'Unknown', 'id': md5(task_id || ':1')}} AS two FROM n)
SELECT task_id, CASE WHEN n % 5 IN (2, 3, 4) THEN 'failed' ELSE 'SUCCESS' END AS status,
  CASE n % 5 WHEN 2 THEN 'empty model response' WHEN 3 THEN 'invalid JSON' WHEN 4 THEN 'validation error: a field is missing or of another type'
    ELSE CAST(to_json({{'summary': n || ' characters read', 'raw_markdown': context, 'leads': CASE n % 5 WHEN 0 THEN [one] ELSE [one, two] END}}) AS VARCHAR) END AS result,
  CASE n % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_leads, n % 5 IN (2, 3, 4) AS dead FROM l"""


@register("g1_g7_synthesis_job", JOB_SQL)
def synthesis_job(spark, sf_dir):
    """G1–G7 chained over the dispatched tasks: evidence, context, prompt, answers, leads or dead letters, task results."""
    tasks = dispatch_records(_resolved(spark, sf_dir))
    conv = tasks.select("query_id", F.expr("query_id div 1000").alias("conv"))
    pages = read_table(spark, sf_dir, "pages").select(F.expr("page_id div 4").alias("conv"), F.col("page_id").alias("rank"), "url", F.col("html").alias("content"))
    failed = conv.where(F.col("conv") % 13 == 5).select("query_id")

    def complete(asked):
        n = F.length("prompt")
        first = F.concat(F.lit('{"summary": "'), n, F.lit(' characters read", "leads": [{"name": "company '), n)
        one, two = F.lit('", "industry": "web"}'), F.lit(', {"name": "second", "industry": "news", "domain": "b.example", "year_founded": 1990}')
        answer = (F.when(n % 5 == 0, F.concat(first, one, F.lit("]}"))).when(n % 5 == 1, F.concat(first, one, two, F.lit("]}")))
                  .when(n % 5 == 3, first).when(n % 5 == 4, F.concat(first, F.lit('"}]}'))))
        return asked.withColumn("payload", answer)

    job = synthesize(tasks, conv.join(pages, "conv").drop("conv"), complete, failed)
    leads = job.leads.groupBy("task_id").agg(F.count(F.lit(1)).cast("int").alias("n_leads"))
    dead = job.dead.select("task_id", F.lit(True).alias("dead"))
    out = task_status(job.results).join(leads, "task_id", "left").join(dead, "task_id", "left")
    return out.select("task_id", "status", "result", F.coalesce("n_leads", F.lit(0)).alias("n_leads"), F.coalesce("dead", F.lit(False)).alias("dead"))
