"""Registered ingest and projection queries: A1, A3–A5, A8, A10–A12, B1, B6, B8–B11,
B13, D10, D11 (the CSV is derived from ``part`` by Spark; see sources.company_csv)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.buckets import size_bucket
from ..functions.text import (display_founded, display_location, display_tags, embed_text, highlight,
                              normalise_all_strings, query_cache_key, raw_cache_key, title_case)
from ..operators.keyed import create_keyed
from ..operators.sizing import attach_scalars, spread
from ..operators.ingest import (clean_companies, delete, embed_with, lookup, quarantined, query_vectors, read_company_csv, upsert, with_ordinal,
                                with_hashed_embedding)
from ..session import materialize, shared_path
from ..sources.company_csv import company_csv_path
from ..sources.tables import companies_from_customer, companies_from_part, read_table, user_queries
from .registry import register
from .sqlparts import CUSTOMER_COMPANIES, PART_COMPANIES, titled, py_strip, size_bucket as sql_bucket, tokens

# the CSV rows as DuckDB derives them from part (same rules as sources.company_csv)
CSV_ROWS = f"""SELECT CAST(p_partkey AS VARCHAR) AS "_c0", {titled('p_name')} AS name,
  CASE WHEN p_size < 3 THEN NULL ELSE lower(replace(p_brand, '#', '')) || '.com' END AS domain,
  CASE WHEN p_size > 45 THEN NULL WHEN p_size = 13 THEN 'abc'
       ELSE CAST(1950 + p_partkey % 75 AS VARCHAR) || '.0' END AS "year founded",
  p_type AS industry, {sql_bucket('p_size * 300')} AS "size range",
  'City ' || CAST(p_size AS VARCHAR) || ', State' AS locality, 'United States' AS country, CAST(NULL AS VARCHAR) AS "linkedin url",
  CAST(p_size * 300 AS VARCHAR) AS "current employee estimate",
  CAST(p_size * 450 AS VARCHAR) AS "total employee estimate", p_partkey AS _ord FROM part"""

CLEAN = f"""SELECT CAST(row_number() OVER (ORDER BY _ord) - 1 AS BIGINT) AS ordinal,
  coalesce(domain, lower(name)) AS natural_key, lower(name) AS name, coalesce(domain, '') AS domain,
  lower(industry) AS industry, lower(locality) AS locality, lower(country) AS country,
  "size range" AS size_range, TRY_CAST(TRY_CAST("year founded" AS DOUBLE) AS INTEGER) AS year_founded
FROM ({CSV_ROWS})"""

DOC_COLS = ["company_id", "name", "domain", "industry", "locality", "country", "size_range", "year_founded"]


def _raw(spark, sf_dir):
    return read_company_csv(spark, company_csv_path(spark, sf_dir))


@register("a1_tolerant_csv_scan", f"""SELECT * EXCLUDE (_ord) FROM ({CSV_ROWS})""")
def a1_csv_scan(spark, sf_dir):
    """A1: header CSV read as strings; blank header → _c0; empty cells → NULL."""
    return _raw(spark, sf_dir).drop("_file", "_block", "_mid")


@register("a1_quoted_line_breaks", """SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS ordinal, CAST(p_partkey AS VARCHAR) AS id,
  CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) || chr(10) || 'said "two", of ' || p_brand ELSE '"' || chr(10) || repeat(p_name || ',' || chr(10), 1 + CAST(p_partkey % 40 AS INTEGER)) END AS name,
  p_type AS industry FROM part""")
def a1_line_breaks(spark, sf_dir):
    """A1/A5: quoted cells with line breaks, quotes and commas, each file read in many splits; records and their numbers."""
    p, k = read_table(spark, sf_dir, "part"), F.col("p_partkey")
    name = (F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat("p_name", F.lit('\n\nsaid "two", of '), "p_brand"))
            .otherwise(F.concat(F.lit('"\n'), F.expr("repeat(concat(p_name, ',\n'), cast(1 + p_partkey % 40 as int))"))))
    path = shared_path(spark, "quoted-csv")
    p.orderBy("p_partkey").select(k.cast("string").alias("id"), name.alias("name"), F.col("p_type").alias("industry")).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    conf, key = spark.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(key)
    conf.set(key, "16384")
    try:
        rows = materialize(with_ordinal(read_company_csv(spark, path, multi_line=True), "ordinal").select("ordinal", "id", "name", "industry"), "quoted-rows")
    finally:
        conf.set(key, before)
    return rows


@register("a3_ingest_row_limit", f"""SELECT CAST(ordinal AS VARCHAR) AS company_id, name, domain, industry, locality,
  country, size_range, year_founded FROM ({CLEAN}) WHERE ordinal < 1000""")
def a3_limit(spark, sf_dir):
    """Ordinal ids in file order, exactly the first 1,000 rows, from the leading files that hold them."""
    raw = read_company_csv(spark, company_csv_path(spark, sf_dir), rows=1000)
    return clean_companies(raw, id_mode="ordinal", limit=1000, embed_dim=None).select(*DOC_COLS)


@register("a5_ordinal_ids", f"""SELECT CAST(ordinal AS VARCHAR) AS company_id, name, domain, industry, locality,
  country, size_range, year_founded FROM ({CLEAN})""")
def a5_ordinal(spark, sf_dir):
    """A5: dense running ids over the whole file (distributed offsets per file split)."""
    return clean_companies(_raw(spark, sf_dir), id_mode="ordinal", embed_dim=None).select(*DOC_COLS)


@register("a4_natural_key_last_wins", f"""SELECT natural_key AS company_id, name, domain, industry, locality, country,
  size_range, year_founded FROM (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY ordinal DESC) AS r
  FROM ({CLEAN}) WHERE natural_key IS NOT NULL AND natural_key <> '') WHERE r = 1""")
def a4_natural(spark, sf_dir):
    """id = domain else name; a later row with the same id replaces the earlier."""
    return clean_companies(_raw(spark, sf_dir), id_mode="natural", embed_dim=None).select(*DOC_COLS)


@register("a8_count_and_head", """SELECT (SELECT count(*) FROM part) AS n_rows, CAST(p_partkey AS VARCHAR) AS
  company_id FROM part ORDER BY p_partkey LIMIT 5""")
def a8_count_head(spark, sf_dir):
    """Row count of the table next to its first five ids."""
    co = companies_from_part(spark, sf_dir)
    n = co.agg(F.count(F.lit(1)).alias("n_rows"))
    head = co.orderBy(F.col("company_id").cast("long")).limit(5).select("company_id")
    return attach_scalars(head, n).select("n_rows", "company_id")


@register("a10_lookup_many_ids", f"""SELECT company_id, name, industry FROM ({PART_COMPANIES})
  WHERE company_id IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity >= 49)""")
def a10_lookup(spark, sf_dir):
    """A10: lookup of many ids — parts ordered in quantity >= 49 — as a semi join."""
    ids = read_table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= 49).select(
        F.col("l_partkey").cast("string").alias("company_id"))
    return lookup(companies_from_part(spark, sf_dir), ids).select("company_id", "name", "industry")


A12_SQL = f"""WITH co AS ({PART_COMPANIES}),
upd AS (SELECT CAST(p_partkey AS VARCHAR) AS company_id, upper(p_name) AS name FROM part WHERE p_size = 50),
del AS (SELECT CAST(p_partkey AS VARCHAR) AS company_id FROM part WHERE p_size = 1)
SELECT co.company_id, coalesce(upd.name, co.name) AS name FROM co LEFT JOIN upd USING (company_id)
WHERE co.company_id NOT IN (SELECT company_id FROM del)"""


@register("a12_put_and_delete", A12_SQL)
def a12_put_delete(spark, sf_dir):
    """Upsert changed documents (size 50 renamed) and delete others (size 1) by id."""
    p = read_table(spark, sf_dir, "part")
    co = companies_from_part(spark, sf_dir).select("company_id", "name")
    upd = p.where(F.col("p_size") == 50).select(F.col("p_partkey").cast("string").alias("company_id"),
                                                F.upper("p_name").alias("name"))
    dels = p.where(F.col("p_size") == 1).select(F.col("p_partkey").cast("string").alias("company_id"))
    return delete(upsert(co, upd), dels)


@register("a12_keyed_table", A12_SQL)
def a12_keyed(spark, sf_dir):
    """A4/A12 on the stored table in buckets of the key: three changes, each of which writes the buckets of its keys only."""
    p = read_table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string").alias("company_id")
    table = create_keyed(companies_from_part(spark, sf_dir).select("company_id", "name"), 32)
    table = table.upsert(p.where("p_size = 50 and p_partkey % 2 = 0").select(key, F.upper("p_name").alias("name")))
    table = table.upsert(p.where("p_size = 50 and p_partkey % 2 = 1").select(key, F.upper("p_name").alias("name")))
    return table.delete(p.where("p_size = 1").select(key)).rows()


@register("b1_normalise_strings", """SELECT c_custkey, coalesce(lower(c_name), '') AS c_name, c_nationkey, c_acctbal,
  coalesce(lower(c_mktsegment), '') AS c_mktsegment FROM customer""")
def b1_normalise(spark, sf_dir):
    """B1: every string column lower-cased, NULL → ''."""
    return normalise_all_strings(read_table(spark, sf_dir, "customer"))


@register("b6_embed_text", f"""SELECT company_id, {py_strip("concat_ws(' ', name, industry, locality)")} AS text
  FROM ({CUSTOMER_COMPANIES})""")
def b6_embed_text(spark, sf_dir):
    """B6: '{name} {industry} {locality}', stripped."""
    co = companies_from_customer(spark, sf_dir)
    return co.select("company_id", embed_text().alias("text"))


@register("b8_size_bucket", f"""SELECT p_partkey, p_size * 300 AS employees, {sql_bucket('p_size * 300')} AS size_range
  FROM part""")
def b8_size_bucket(spark, sf_dir):
    """Employee count → size bucket label."""
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", (F.col("p_size") * 300).alias("employees"),
                    size_bucket(F.col("p_size") * 300).alias("size_range"))


@register("b9_b10_cache_keys", f"""SELECT conv_id * 1000 + turn AS query_id,
  'intent:' || md5(lower({py_strip('text')})) AS intent_key, 'search:' || md5(lower({py_strip('text')})) AS search_key,
  'news_cache:' || md5(text) AS news_key FROM conversations WHERE role = 'user'""")
def b9_keys(spark, sf_dir):
    """Normalised query hash keys and the raw evidence-cache key."""
    q = user_queries(spark, sf_dir)
    return q.select("query_id", query_cache_key("intent:", "query").alias("intent_key"),
                    query_cache_key("search:", "query").alias("search_key"),
                    raw_cache_key("news_cache:", "query").alias("news_key"))


@register("b11_highlight", f"""SELECT company_id, CASE WHEN name IS NULL OR name = '' THEN 'Unknown'
  ELSE regexp_replace(name, '(?i)(\\QRing\\E)', '**\\1**', 'g') END AS highlighted FROM ({PART_COMPANIES})""")
def b11_highlight(spark, sf_dir):
    """Case-insensitive literal highlight of 'Ring' in company names."""
    co = companies_from_part(spark, sf_dir)
    return co.select("company_id", highlight("name", F.lit("Ring")).alias("highlighted"))


ODD_NAME_SQL = "'3m ' || c_name || ' o''' || c_mktsegment || ' x-ray'"


@register("b12_title_case", f"""SELECT CAST(c_custkey AS VARCHAR) AS company_id, {titled(ODD_NAME_SQL)} AS title
  FROM customer""")
def b12_title(spark, sf_dir):
    """Title-cased names, with digits, apostrophes and hyphens inside words."""
    co = companies_from_customer(spark, sf_dir)
    odd = F.concat(F.lit("3m "), F.col("name"), F.lit(" o'"), F.col("industry"), F.lit(" x-ray"))
    return co.select("company_id", title_case(odd).alias("title"))


@register("b13_display_lines", f"""SELECT company_id, locality || ', ' || country AS location,
  'Founded: ' || coalesce(CAST(year_founded AS VARCHAR), 'None') || ' | Size: ' || coalesce(size_range, 'None')
  AS founded, CASE WHEN CAST(company_id AS BIGINT) % 3 = 0 THEN '' ELSE '`' || industry || '`, `' || country || '`' END AS tag_line
  FROM ({CUSTOMER_COMPANIES})""")
def b13_display(spark, sf_dir):
    """Display lines of a result card; every third company has no tags, the others two."""
    co = companies_from_customer(spark, sf_dir)
    co = co.withColumn("tags", F.when(F.col("company_id").cast("long") % 3 != 0, F.array("industry", "country")))
    return co.select("company_id", display_location().alias("location"), display_founded().alias("founded"),
                     display_tags().alias("tag_line"))


def _hashed_sql(text_sql: str, key: str, src: str, dim: int = 64) -> str:
    return f"""WITH t AS (SELECT {key} AS id, {tokens(text_sql)} AS toks FROM ({src})),
s AS (SELECT id, list_transform(toks, lambda w: CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS INTEGER))
      AS slots FROM t),
c AS (SELECT id, list_transform(range({dim}), lambda i: CAST(len(list_filter(slots, lambda s: s = i)) AS DOUBLE))
      AS counts FROM s),
n AS (SELECT id, counts, sqrt(list_sum(list_transform(counts, lambda x: x * x))) AS norm FROM c)
SELECT id AS {key}, list_transform(counts, lambda x: CAST(CASE WHEN norm > 0 THEN x / norm ELSE 0.0 END AS FLOAT))
  AS embedding FROM n"""


@register("d10_hashed_embedding", _hashed_sql(py_strip("concat_ws(' ', name, industry, locality)"), "company_id",
                                              CUSTOMER_COMPANIES))
def d10_embed(spark, sf_dir):
    """Built-in hashed bag-of-tokens encoder on the company embed text (64 dims)."""
    co = spread(companies_from_customer(spark, sf_dir))
    return with_hashed_embedding(co, embed_text(), "embedding", 64).select("company_id", "embedding")


@register("d11_query_embedding", _hashed_sql("text", "item_id", "SELECT * FROM benchmark"))
def d11_query_embed(spark, sf_dir):
    """The same encoder on whole query texts (benchmark items)."""
    b = read_table(spark, sf_dir, "benchmark")
    return with_hashed_embedding(b, "text", "embedding", 64).select("item_id", "embedding")


@register("a6_a7_a14_write_and_compact", f"""SELECT company_id, name, domain, industry, locality, country, size_range,
  year_founded FROM ({PART_COMPANIES})""")
def a14_compact(spark, sf_dir):
    """Conform to the declared schema, bulk-write as Parquet, then compact into
    range-partitioned files sorted by id; the content is unchanged."""
    from ..operators.ingest import compact, write_companies
    from ..session import shared_path
    co = companies_from_part(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    src, dst = shared_path(spark, "companies"), shared_path(spark, "companies-compacted")
    write_companies(co, src)
    return compact(spark, src, dst, files=4).select(*DOC_COLS)


@register("b2_selective_lower", """SELECT p_partkey, p_name, p_brand, lower(p_type) AS p_type, p_size FROM part""")
def b2_selective(spark, sf_dir):
    """B2: only the named columns are lower-cased (the worker ingester's rule)."""
    from ..functions.text import lower_columns
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return lower_columns(p, ["p_type"])


@register("b3_generator_layout_ingest", f"""SELECT natural_key AS company_id, name, domain, industry, locality,
  country, size_range, year_founded FROM (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY ordinal DESC)
  AS r FROM ({CLEAN}) WHERE natural_key IS NOT NULL AND natural_key <> '') WHERE r = 1""")
def b3_aliases(spark, sf_dir):
    """The same rows in the synthetic generator's layout (``year_founded``,
    ``size_range`` spelled with underscores, no row-number column) ingest identically."""
    from ..session import shared_path
    from ..sources.company_csv import part_as_company_rows
    rows = part_as_company_rows(spark, sf_dir).drop("").withColumnsRenamed(
        {"year founded": "year_founded", "size range": "size_range"})
    path = shared_path(spark, "generator-layout-csv")
    rows.write.option("header", True).option("emptyValue", "").csv(path)
    return clean_companies(read_company_csv(spark, path), id_mode="natural", embed_dim=None).select(*DOC_COLS)


@register("a13_drop_table", f"""SELECT company_id, name, domain, industry, locality, country, size_range, year_founded
  FROM ({PART_COMPANIES}) WHERE false""")
def a13_drop(spark, sf_dir):
    """A written company table replaced by an empty one with the same schema."""
    from ..operators.ingest import drop_table, write_companies
    from ..session import shared_path
    path = shared_path(spark, "companies-dropped")
    write_companies(companies_from_part(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>")), path)
    drop_table(spark, path)
    return spark.read.parquet(path).select(*DOC_COLS)


@register("d9_d10_embedding_failures", f"""SELECT 'company' AS kind, company_id AS id, contains(name, '7') AS failed FROM ({CUSTOMER_COMPANIES})
UNION ALL SELECT 'query', CAST(item_id AS VARCHAR), contains(text, 'ing') FROM benchmark""")
def d9_failures(spark, sf_dir):
    """An encoder that raises on some texts: such companies are set apart, such queries get the zero vector."""
    def make_model(word):
        def make():
            def encode(texts):
                if texts.str.contains(word).any():
                    raise RuntimeError("can't encode")
                return texts.map(lambda t: [1.0, float(len(t))])
            return encode
        return make

    co = embed_with(spread(companies_from_customer(spark, sf_dir)), "name", make_model("7"), failures="null")
    good, bad = quarantined(co)
    q = query_vectors(read_table(spark, sf_dir, "benchmark"), "text", make_model("ing"), 2)
    rows = [d.select(F.lit("company").alias("kind"), F.col("company_id").alias("id"), F.lit(f).alias("failed")) for d, f in ((good, False), (bad, True))]
    asked = q.select(F.lit("query").alias("kind"), F.col("item_id").cast("string").alias("id"), (F.col("vector")[0] == 0).alias("failed"))
    return rows[0].unionByName(rows[1]).unionByName(asked)
