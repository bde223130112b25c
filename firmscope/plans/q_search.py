"""Registered structured-search queries: A9, C1–C4, C6, C8–C10, C13 on the company
stand-ins (part; customer ⋈ nation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import search_clustered, write_clustered
from ..operators.search import SearchRequest, batch_search, deterministic_responses, name_index, search
from ..sources.tables import companies_from_customer, companies_from_part, read_table
from .registry import register
from .sqlparts import CUSTOMER_COMPANIES, PART_COMPANIES, bm25_ctes, bm25_terms_cte, qterms_cte

OUT = ["company_id", "name", "industry", "size_range", "country", "year_founded", "score", "rank"]


def _filter_sql(base: str, where: str, offset: int, size: int) -> str:
    return f"""SELECT company_id, name, industry, size_range, country, year_founded, NULL::DOUBLE AS score,
  CAST(row_number() OVER (ORDER BY company_id) AS INTEGER) AS rank
FROM (SELECT * FROM ({base}) WHERE {where} ORDER BY company_id LIMIT {size} OFFSET {offset})"""


def _name_sql(base: str, name: str, where: str, offset: int, size: int) -> str:
    return f"""WITH co AS ({base}),
{bm25_ctes('nm', 'SELECT * FROM co', 'company_id', 'name')},
{qterms_cte('qt', f"SELECT 0 AS qid, '{name}' AS q", 'qid', 'q')},
{bm25_terms_cte('st', 'nm', 'qt', 1.0)},
sc AS (SELECT doc_id AS company_id, round(sum(score), 6) AS score FROM st GROUP BY ALL),
hits AS (SELECT co.*, sc.score FROM co JOIN sc USING (company_id) WHERE {where}
         ORDER BY score DESC, company_id LIMIT {size} OFFSET {offset})
SELECT company_id, name, industry, size_range, country, year_founded, score,
  CAST(row_number() OVER (ORDER BY score DESC, company_id) AS INTEGER) AS rank FROM hits"""


_indexes: dict = {}


def _name_index(spark, sf_dir, table, companies):
    """Name index per (session, table), written once with term-bucketed postings: a
    single request then reads only the buckets of its terms."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _indexes:
        _indexes[key] = name_index(companies, materialize=True)
    return _indexes[key]


def _run(companies, req, spark=None, sf_dir=None, table=None):
    idx = _name_index(spark, sf_dir, table, companies) if req.name and spark is not None else None
    return search(companies, req, idx).select(*OUT)


@register("a9_match_all_page", _filter_sql(PART_COMPANIES, "TRUE", 0, 10))
def a9_match_all(spark, sf_dir):
    """No criteria → all companies, first page by id."""
    return _run(companies_from_part(spark, sf_dir), SearchRequest())


@register("c1_name_match", _name_sql(PART_COMPANIES, "Red Widget", "TRUE", 0, 10))
def c1_name_match(spark, sf_dir):
    """BM25 match on the name field (stats over all companies), score desc then id."""
    return _run(companies_from_part(spark, sf_dir), SearchRequest(name="Red Widget"), spark, sf_dir, "part")


@register("c2_industry_filter", _filter_sql(PART_COMPANIES, "industry = 'economy'", 0, 10))
def c2_industry(spark, sf_dir):
    """Industry equals the lower-cased argument."""
    return _run(companies_from_part(spark, sf_dir), SearchRequest(industry="ECONOMY"))


@register("c3_size_range_filter", _filter_sql(PART_COMPANIES, "size_range = '5001-10000'", 10, 10))
def c3_size(spark, sf_dir):
    """Size range equals; second page."""
    return _run(companies_from_part(spark, sf_dir), SearchRequest(size_range="5001-10000", page=2))


@register("c4_country_filter", _filter_sql(CUSTOMER_COMPANIES, "country = 'nation_7'", 0, 10))
def c4_country(spark, sf_dir):
    """C4: country equals (customer ⋈ nation)."""
    return _run(companies_from_customer(spark, sf_dir), SearchRequest(country="NATION_7"))


@register("c6_year_range", _filter_sql(PART_COMPANIES, "year_founded >= 1990 AND year_founded <= 2000", 0, 10))
def c6_year_range(spark, sf_dir):
    """Inclusive year range."""
    return _run(companies_from_part(spark, sf_dir), SearchRequest(year_from=1990, year_to=2000))


@register("c6_year_to_only", _filter_sql(PART_COMPANIES, "year_founded <= 1960", 0, 10))
def c6_year_to_only(spark, sf_dir):
    """One-sided bound; year_from=0 is falsy, so no lower bound."""
    return _run(companies_from_part(spark, sf_dir), SearchRequest(year_from=0, year_to=1960))


@register("c8_pagination", _filter_sql(PART_COMPANIES, "industry = 'promo'", 40, 20))
def c8_pagination(spark, sf_dir):
    """Page 3 of size 20 → offset 40."""
    return _run(companies_from_part(spark, sf_dir), SearchRequest(industry="promo", page=3, size=20))


@register("c10_country_and_industry",
          _filter_sql(CUSTOMER_COMPANIES, "country = 'nation_3' AND industry = 'building'", 0, 10))
def c10_multi(spark, sf_dir):
    """Conjunction of two equality terms."""
    return _run(companies_from_customer(spark, sf_dir), SearchRequest(country="Nation_3", industry="Building"))


@register("c1_name_and_filters", _name_sql(CUSTOMER_COMPANIES, "Customer 000000042",
                                           "country = 'nation_2' AND year_founded >= 1950", 0, 10))
def c1_name_and_filters(spark, sf_dir):
    """C1+C4+C6: scored name match inside filters (filters do not change BM25 stats)."""
    return _run(companies_from_customer(spark, sf_dir),
                SearchRequest(name="Customer 000000042", country="NATION_2", year_from=1950), spark, sf_dir, "customer")


@register("c13_empty_result", _name_sql(PART_COMPANIES, "zzzznonexistent9999", "TRUE", 0, 10))
def c13_empty(spark, sf_dir):
    """No match → empty result with the same schema."""
    return _run(companies_from_part(spark, sf_dir), SearchRequest(name="zzzznonexistent9999"), spark, sf_dir, "part")


def _requests(spark, sf_dir):
    """Batch requests derived from nation / region: country-only (page 1 and 2), country +
    industry + year, and name requests."""
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    cols = ["request_id", "name", "industry", "size_range", "country", "year_from", "year_to", "tags", "page",
            "size"]
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    tags = F.lit(None).cast("array<string>")
    a = n.select(F.col("n_nationkey").cast("long").alias("request_id"), none_s.alias("name"),
                 none_s.alias("industry"), none_s.alias("size_range"), F.col("n_name").alias("country"),
                 none_i.alias("year_from"), none_i.alias("year_to"), tags.alias("tags"),
                 F.lit(1).alias("page"), F.lit(5).alias("size"))
    b = a.withColumn("request_id", F.col("request_id") + 100).withColumn("page", F.lit(2))
    c = n.select((F.col("n_nationkey") + 200).cast("long").alias("request_id"), none_s.alias("name"),
                 F.lit("MACHINERY").alias("industry"), none_s.alias("size_range"), F.col("n_name").alias("country"),
                 (F.lit(1950) + F.col("n_regionkey") * 10).cast("int").alias("year_from"), none_i.alias("year_to"),
                 tags.alias("tags"), F.lit(1).alias("page"), F.lit(5).alias("size"))
    d = r.select((F.col("r_regionkey") + 300).cast("long").alias("request_id"),
                 F.concat(F.lit("customer "), F.lpad(F.col("r_regionkey").cast("string"), 9, "0")).alias("name"),
                 none_s.alias("industry"), none_s.alias("size_range"), none_s.alias("country"),
                 none_i.alias("year_from"), none_i.alias("year_to"), tags.alias("tags"),
                 F.lit(1).alias("page"), F.lit(5).alias("size"))
    return a.select(*cols).unionByName(b.select(*cols)).unionByName(c.select(*cols)).unionByName(d.select(*cols))


C9_SQL = f"""WITH co AS ({CUSTOMER_COMPANIES}),
req AS (
  SELECT CAST(n_nationkey AS BIGINT) AS request_id, NULL AS name, NULL AS industry, n_name AS country,
         NULL::INTEGER AS year_from, 1 AS page, 5 AS size FROM nation
  UNION ALL SELECT n_nationkey + 100, NULL, NULL, n_name, NULL, 2, 5 FROM nation
  UNION ALL SELECT n_nationkey + 200, NULL, 'MACHINERY', n_name, CAST(1950 + n_regionkey * 10 AS INTEGER), 1, 5
            FROM nation
  UNION ALL SELECT r_regionkey + 300, 'customer ' || lpad(CAST(r_regionkey AS VARCHAR), 9, '0'), NULL, NULL, NULL,
            1, 5 FROM region),
{bm25_ctes('nm', 'SELECT * FROM co', 'company_id', 'name')},
{qterms_cte('qt', "SELECT * FROM req WHERE name IS NOT NULL AND name <> ''", 'request_id', 'name')},
{bm25_terms_cte('st', 'nm', 'qt', 1.0)},
sc AS (SELECT query_id AS request_id, doc_id AS company_id, round(sum(score), 6) AS score FROM st GROUP BY ALL),
j AS (SELECT r.request_id, r.page, r.size, co.*, sc.score
      FROM req r JOIN co ON (r.industry IS NULL OR co.industry = lower(r.industry))
                        AND (r.country IS NULL OR co.country = lower(r.country))
                        AND (coalesce(r.year_from, 0) = 0 OR co.year_founded >= r.year_from)
      LEFT JOIN sc ON sc.request_id = r.request_id AND sc.company_id = co.company_id
      WHERE r.name IS NULL OR sc.score IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, company_id) AS rn FROM j)
SELECT request_id, CAST(rn - (page - 1) * size AS INTEGER) AS rank, company_id, name, industry, country,
       year_founded, score
FROM rk WHERE rn > (page - 1) * size AND rn <= page * size"""


@register("c9_batch_search", C9_SQL)
def c9_batch(spark, sf_dir):
    """85 requests (filters, paging, name scoring) answered in one plan."""
    co = companies_from_customer(spark, sf_dir)
    res = batch_search(co, _requests(spark, sf_dir), _name_index(spark, sf_dir, "customer", co))
    return res.select("request_id", "rank", "company_id", "name", "industry", "country", "year_founded", "score")


def order_requests(spark, sf_dir):
    """One request per order: the ordering customer's segment as industry filter, page
    1–3 of size 10, and urgent orders add a founding-year lower bound."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    none_s = F.lit(None).cast("string")
    return j.select(F.col("o_orderkey").alias("request_id"), none_s.alias("name"),
                    F.col("c_mktsegment").alias("industry"), none_s.alias("size_range"), none_s.alias("country"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1990)).cast("int").alias("year_from"),
                    F.lit(None).cast("int").alias("year_to"), F.lit(None).cast("array<string>").alias("tags"),
                    (F.col("o_orderkey") % 3 + 1).cast("int").alias("page"), F.lit(10).alias("size"))


C9_ORDERS_SQL = f"""WITH co AS ({CUSTOMER_COMPANIES}),
req AS (SELECT o_orderkey AS request_id, c_mktsegment AS industry,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 1990 END AS year_from,
        CAST(o_orderkey % 3 + 1 AS INTEGER) AS page, 10 AS size
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
j AS (SELECT r.request_id, r.page, r.size, co.company_id FROM req r JOIN co
      ON (r.industry IS NULL OR co.industry = lower(r.industry))
     AND (coalesce(r.year_from, 0) = 0 OR co.year_founded >= r.year_from)),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY company_id) AS rn FROM j)
SELECT request_id, CAST(rn - (page - 1) * size AS INTEGER) AS rank, company_id
FROM rk WHERE rn > (page - 1) * size AND rn <= page * size"""


@register("c9_batch_search_per_order", C9_ORDERS_SQL)
def c9_orders(spark, sf_dir):
    """C9 at volume: one structured-search request per order, answered in one plan
    (identical filter sets collapse; equality-only sets are cut per key before the join)."""
    co = companies_from_customer(spark, sf_dir)
    return batch_search(co, order_requests(spark, sf_dir)).select("request_id", "rank", "company_id")


def customer_requests(spark, sf_dir):
    """Two requests per customer, all distinct: its number as a name with a lower year bound, and a range of
    founding years alone; every seventh of the latter with the customer's segment."""
    c = read_table(spark, sf_dir, "customer")
    k, none_s, none_i = F.col("c_custkey"), F.lit(None).cast("string"), F.lit(None).cast("int")
    tags = F.lit(None).cast("array<string>").alias("tags")
    by_name = c.select((k * 2).alias("request_id"), F.regexp_extract("c_name", "[0-9]+", 0).alias("name"), none_s.alias("industry"),
                       none_s.alias("size_range"), none_s.alias("country"), F.lit(1910).alias("year_from"), none_i.alias("year_to"), tags,
                       F.lit(1).alias("page"), F.lit(10).alias("size"))
    start = (F.lit(1900) + k % 120).cast("int")
    by_year = c.select((k * 2 + 1).alias("request_id"), none_s.alias("name"), F.when(k % 7 == 0, F.col("c_mktsegment")).alias("industry"),
                       none_s.alias("size_range"), none_s.alias("country"), start.alias("year_from"),
                       (start + (k % 37).cast("int")).alias("year_to"), tags, (k % 2 + 1).cast("int").alias("page"), F.lit(5).alias("size"))
    return by_name.unionByName(by_year)


C9_CUSTOMERS_SQL = f"""WITH co AS ({CUSTOMER_COMPANIES}),
req AS (SELECT c_custkey * 2 AS request_id, regexp_extract(c_name, '[0-9]+') AS name, NULL AS industry, 1910 AS year_from, NULL::INTEGER AS year_to,
          1 AS page, 10 AS size FROM customer
        UNION ALL SELECT c_custkey * 2 + 1, NULL, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment END, CAST(1900 + c_custkey % 120 AS INTEGER),
          CAST(1900 + c_custkey % 120 + c_custkey % 37 AS INTEGER), CAST(c_custkey % 2 + 1 AS INTEGER), 5 FROM customer),
{bm25_ctes('nm', 'SELECT * FROM co', 'company_id', 'name')},
{qterms_cte('qt', "SELECT * FROM req WHERE name IS NOT NULL AND name <> ''", 'request_id', 'name')},
{bm25_terms_cte('st', 'nm', 'qt', 1.0)},
sc AS (SELECT query_id AS request_id, doc_id AS company_id, round(sum(score), 6) AS score FROM st GROUP BY ALL),
j AS (SELECT r.request_id, r.page, r.size, co.company_id, sc.score FROM sc JOIN req r USING (request_id) JOIN co ON co.company_id = sc.company_id
      WHERE co.year_founded >= r.year_from
      UNION ALL SELECT r.request_id, r.page, r.size, co.company_id, NULL FROM req r JOIN co
        ON co.year_founded BETWEEN r.year_from AND r.year_to AND (r.industry IS NULL OR co.industry = lower(r.industry)) WHERE r.name IS NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, company_id) AS rn FROM j)
SELECT request_id, CAST(rn - (page - 1) * size AS INTEGER) AS rank, company_id, score
FROM rk WHERE rn > (page - 1) * size AND rn <= page * size"""


@register("c9_batch_search_per_customer", C9_CUSTOMERS_SQL)
def c9_customers(spark, sf_dir):
    """C9 with as many filter sets as requests: one name request and one year request per customer."""
    co = companies_from_customer(spark, sf_dir)
    res = batch_search(co, customer_requests(spark, sf_dir), _name_index(spark, sf_dir, "customer", co))
    return res.select("request_id", "rank", "company_id", "score")


#: customers as companies with up to three tags; none at all for every seventh, a NULL among them for every eleventh
TAGGED_SQL = f"""SELECT co.*, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ['nat' || c_nationkey % 5, NULL]
  ELSE ['seg:' || lower(c_mktsegment), 'nat' || c_nationkey % 5, 'mod' || c_custkey % 3] END AS tags
  FROM ({CUSTOMER_COMPANIES}) co JOIN customer ON co.company_id = CAST(c_custkey AS VARCHAR)"""


def _tagged_companies(spark, sf_dir):
    co = companies_from_customer(spark, sf_dir).drop("tags")
    c = read_table(spark, sf_dir, "customer")
    k, nat = F.col("c_custkey"), F.concat(F.lit("nat"), (F.col("c_nationkey") % 5).cast("string"))
    full = F.array(F.concat(F.lit("seg:"), F.lower("c_mktsegment")), nat, F.concat(F.lit("mod"), (k % 3).cast("string")))
    tags = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.array(nat, F.lit(None).cast("string"))).otherwise(full)
    return co.join(c.select(k.cast("string").alias("company_id"), tags.alias("tags")), "company_id")


def _tag_requests(spark, sf_dir):
    """Two requests per nation, one per supplier: one, two or three tags, alone and with segment, country, years, a name, pages."""
    n, s = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "supplier")
    none_s, none_i, k, i = F.lit(None).cast("string"), F.lit(None).cast("int"), F.col("n_nationkey"), F.col("s_suppkey")
    nat, mod = F.concat(F.lit("nat"), (k % 5).cast("string")), F.concat(F.lit("mod"), (k % 3).cast("string"))
    a = n.select(k.cast("long").alias("request_id"), none_s.alias("name"), none_s.alias("industry"), none_s.alias("size_range"), none_s.alias("country"),
                 none_i.alias("year_from"), none_i.alias("year_to"), F.when(k % 2 == 0, F.array(nat)).otherwise(F.array(nat, mod, nat)).alias("tags"),
                 (k % 4 + 1).cast("int").alias("page"), F.lit(7).alias("size"))
    b = n.select((k + 100).cast("long").alias("request_id"), F.when(k % 3 == 0, F.lit("customer 000000007")).alias("name"), F.when(k % 3 == 1, F.lit("BUILDING")).alias("industry"),
                 none_s.alias("size_range"), F.when(k % 3 == 2, F.col("n_name")).alias("country"), F.when(k % 2 == 0, F.lit(1950)).alias("year_from"), none_i.alias("year_to"),
                 F.array(mod).alias("tags"), F.lit(1).alias("page"), F.lit(5).alias("size"))
    c = s.select((i + 1000).alias("request_id"), none_s.alias("name"), none_s.alias("industry"), none_s.alias("size_range"), none_s.alias("country"), none_i.alias("year_from"),
                 none_i.alias("year_to"), F.array(F.concat(F.lit("nat"), (i % 6).cast("string")), F.when(i % 9 == 0, F.lit(None).cast("string")).otherwise(F.lit("seg:machinery"))).alias("tags"),
                 F.lit(2).alias("page"), F.lit(3).alias("size"))
    return a.unionByName(b).unionByName(c)


C9_TAGS_SQL = f"""WITH co AS ({TAGGED_SQL}),
req AS (SELECT CAST(n_nationkey AS BIGINT) AS request_id, NULL AS name, NULL AS industry, NULL AS country, NULL::INTEGER AS year_from,
          CASE WHEN n_nationkey % 2 = 0 THEN ['nat' || n_nationkey % 5] ELSE ['nat' || n_nationkey % 5, 'mod' || n_nationkey % 3] END AS want, CAST(n_nationkey % 4 + 1 AS INTEGER) AS page, 7 AS size FROM nation
        UNION ALL SELECT n_nationkey + 100, CASE WHEN n_nationkey % 3 = 0 THEN 'customer 000000007' END, CASE WHEN n_nationkey % 3 = 1 THEN 'building' END,
          CASE WHEN n_nationkey % 3 = 2 THEN lower(n_name) END, CASE WHEN n_nationkey % 2 = 0 THEN 1950 END, ['mod' || n_nationkey % 3], 1, 5 FROM nation
        UNION ALL SELECT s_suppkey + 1000, NULL, NULL, NULL, NULL, ['nat' || s_suppkey % 6, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'seg:machinery' END], 2, 3 FROM supplier),
{bm25_ctes('nm', 'SELECT * FROM co', 'company_id', 'name')},
{qterms_cte('qt', "SELECT * FROM req WHERE name IS NOT NULL", 'request_id', 'name')},
{bm25_terms_cte('st', 'nm', 'qt', 1.0)},
sc AS (SELECT query_id AS request_id, doc_id AS company_id, round(sum(score), 6) AS score FROM st GROUP BY ALL),
j AS (SELECT r.request_id, r.page, r.size, co.company_id, sc.score FROM req r JOIN co
      ON len(list_filter(r.want, lambda t: t IS NULL)) = 0 AND co.tags IS NOT NULL AND len(list_filter(r.want, lambda t: NOT list_contains(list_filter(co.tags, lambda x: x IS NOT NULL), t))) = 0
        AND (r.industry IS NULL OR co.industry = r.industry) AND (r.country IS NULL OR co.country = r.country) AND (r.year_from IS NULL OR co.year_founded >= r.year_from)
      LEFT JOIN sc ON sc.request_id = r.request_id AND sc.company_id = co.company_id WHERE r.name IS NULL OR sc.score IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, company_id) AS rn FROM j)
SELECT request_id, CAST(rn - (page - 1) * size AS INTEGER) AS rank, company_id, score FROM rk WHERE rn > (page - 1) * size AND rn <= page * size"""


@register("c9_batch_search_tags", C9_TAGS_SQL)
def c9_tags(spark, sf_dir):
    """Requests for one to three tags, alone and with names, fields, years and pages, over companies some of which
    have no tags or a NULL among them."""
    return batch_search(_tagged_companies(spark, sf_dir), _tag_requests(spark, sf_dir)).select("request_id", "rank", "company_id", "score")


@register("c9_responses", f"""WITH p AS ({C9_TAGS_SQL}), r AS (SELECT n_nationkey AS request_id FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation UNION ALL SELECT s_suppkey + 1000 FROM supplier)
SELECT r.request_id, coalesce(string_agg(p.company_id || ':' || co.industry, ',' ORDER BY p.rank), '') AS results, 'Deterministic' AS route, 0 AS n_scores
FROM r LEFT JOIN p USING (request_id) LEFT JOIN ({CUSTOMER_COMPANIES}) co USING (company_id) GROUP BY r.request_id""")
def c9_responses(spark, sf_dir):
    """The responses of the tagged requests, with results and deterministic diagnostics, requests that find nothing included."""
    requests = _tag_requests(spark, sf_dir)
    out = deterministic_responses(requests, batch_search(_tagged_companies(spark, sf_dir), requests))
    line = F.transform("results", lambda c: F.concat_ws(":", c["company_id"], c["industry"]))
    return out.select("request_id", F.array_join(line, ",").alias("results"), "diagnostics.route", F.size("diagnostics.scores").alias("n_scores"))


CLUSTERED = {0: (dict(country="Nation_3", industry="Building"), "country = 'nation_3' AND industry = 'building'"),
             1: (dict(country="NATION_11", year_from=1960, year_to=1999, page=2, size=5), "country = 'nation_11' AND year_founded >= 1960 AND year_founded <= 1999"),
             2: (dict(industry="machinery", size_range="5001-10000", year_from=1990, size=20), "industry = 'machinery' AND size_range = '5001-10000' AND year_founded >= 1990"),
             3: (dict(industry="no such"), "industry = 'no such'")}


@register("c10_clustered_table", f"WITH co AS ({CUSTOMER_COMPANIES})" + " UNION ALL ".join(
    f"""SELECT {k} AS request, company_id, name, rank, TRUE AS few_files FROM ({_filter_sql('SELECT * FROM co', where, (r.get('page', 1) - 1) * r.get('size', 10), r.get('size', 10))})"""
    for k, (r, where) in CLUSTERED.items()))
def c10_clustered(spark, sf_dir):
    """C2–C4/C6/C7/C10 over the table clustered on a space-filling curve; ``few_files``: at most 30 % of the files were read."""
    table = write_clustered(companies_from_customer(spark, sf_dir), 64)
    n = table.years.count()
    parts = []
    for k, (r, _) in CLUSTERED.items():
        req = SearchRequest(**r)
        few = table.files(req).count() <= 0.3 * n
        parts.append(search_clustered(table, req).select(F.lit(k).alias("request"), "company_id", "name", "rank", F.lit(few).alias("few_files")))
    return reduce(DataFrame.unionByName, parts)
