"""Reusable DuckDB SQL fragments for the oracle queries (same semantics as the Spark code)."""

from __future__ import annotations

TOKENS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def tokens(x: str) -> str:
    return TOKENS.format(x=x)


def bm25_ctes(prefix: str, corpus_sql: str, id_col: str, text_col: str) -> str:
    """CTEs ``{p}_post(doc_id, term, tf, dl)``, ``{p}_df(term, df)``, ``{p}_cs(n_docs, avgdl)``."""
    p = prefix
    return f"""
{p}_tok AS (SELECT {id_col} AS doc_id, unnest({tokens(text_col)}) AS term FROM ({corpus_sql})),
{p}_dl AS (SELECT doc_id, count(*) AS dl FROM {p}_tok GROUP BY doc_id),
{p}_post AS (SELECT t.doc_id, t.term, count(*) AS tf, any_value(d.dl) AS dl
             FROM {p}_tok t JOIN {p}_dl d USING (doc_id) GROUP BY t.doc_id, t.term),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_post GROUP BY term),
{p}_cs AS (SELECT count(*) AS n_docs, sum(dl)::DOUBLE / count(*) AS avgdl FROM {p}_dl)"""


def qterms_cte(name: str, queries_sql: str, qid: str, text: str) -> str:
    return f"""
{name} AS (SELECT query_id, term, count(*) AS qtf FROM
           (SELECT {qid} AS query_id, unnest({tokens(text)}) AS term FROM ({queries_sql})) GROUP BY ALL)"""


def bm25_terms_cte(name: str, prefix: str, qterms: str, boost: float) -> str:
    """``name(query_id, doc_id, term, score)`` — per matched term contribution."""
    p = prefix
    return f"""
{name} AS (SELECT q.query_id, po.doc_id, q.term,
      {boost} * q.qtf * ln(1 + (cs.n_docs - d.df + 0.5) / (d.df + 0.5))
      * (po.tf / (po.tf + 1.2 * (0.25 + 0.75 * po.dl / cs.avgdl))) AS score
    FROM {qterms} q JOIN {p}_post po ON po.term = q.term JOIN {p}_df d ON d.term = q.term CROSS JOIN {p}_cs cs)"""


def py_strip(x: str) -> str:
    from ..functions.text import PY_WHITESPACE
    return f"regexp_replace({x}, '^{PY_WHITESPACE}+|{PY_WHITESPACE}+$', '', 'g')"


def size_bucket(x: str) -> str:
    from ..functions.buckets import SIZE_BUCKETS
    parts = [f"WHEN {x} <= {u} THEN '{lab}'" for u, lab in SIZE_BUCKETS if u is not None]
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(parts)} ELSE '{SIZE_BUCKETS[-1][1]}' END"


def titled(x: str) -> str:
    """A capital for each run of letters, the rest small."""
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '\\p{{L}}+|[^\\p{{L}}]+'), "
            f"lambda w: upper(left(w, 1)) || substr(w, 2)), '')")


PART_COMPANIES = f"""SELECT CAST(p_partkey AS VARCHAR) AS company_id, lower(p_name) AS name, lower(p_brand) AS domain,
  lower(p_type) AS industry, '' AS locality, '' AS country, {size_bucket('p_size * 300')} AS size_range,
  CAST(1950 + p_partkey % 75 AS INTEGER) AS year_founded FROM part"""

CUSTOMER_COMPANIES = f"""SELECT CAST(c_custkey AS VARCHAR) AS company_id, lower(c_name) AS name, '' AS domain,
  lower(c_mktsegment) AS industry, '' AS locality, lower(n_name) AS country,
  {size_bucket('CAST(floor(abs(c_acctbal)) AS INTEGER)')} AS size_range,
  CAST(1900 + c_custkey % 120 AS INTEGER) AS year_founded
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

def sql_type_ok(doc: str, path: str, kind: str) -> str:
    """DuckDB: does the JSON value at ``path`` of ``doc`` have the type (text, whole, boolean)."""
    t, s = f"json_type({doc}, '{path}')", f"json_extract_string({doc}, '{path}')"
    if kind == "text":
        return f"coalesce({t} = 'VARCHAR', false)"
    if kind == "whole":
        return (f"coalesce({t} IN ('BIGINT', 'UBIGINT', 'BOOLEAN') OR ({t} = 'DOUBLE' AND try_cast({s} AS DOUBLE) % 1 = 0) "
                f"OR ({t} = 'VARCHAR' AND regexp_full_match(trim({s}), '[+-]?[0-9]+(\\.0+)?')), false)")
    return (f"coalesce({t} = 'BOOLEAN' OR ({t} IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND try_cast({s} AS DOUBLE) IN (0, 1)) "
            f"OR ({t} = 'VARCHAR' AND lower({s}) IN ('true', 't', 'yes', 'y', 'on', '1', 'false', 'f', 'no', 'n', 'off', '0')), false)")


def sql_whole(doc: str, path: str) -> str:
    """DuckDB: the whole number at ``path``."""
    s = f"json_extract_string({doc}, '{path}')"
    return f"CASE {s} WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE CAST(try_cast(trim({s}) AS DOUBLE) AS INTEGER) END"
