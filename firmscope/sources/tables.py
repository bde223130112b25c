"""Readers for the driver's Parquet tables and the stand-ins that map them onto the
objects of the company-search data model (SURVEY §7.3). Every stand-in is a plain
projection/join of the given tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import size_bucket
from ..session import table_path

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def companies_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical company rows from ``part``: id=p_partkey, name=p_name, domain=p_brand,
    industry=lower(p_type), size from p_size*300, year 1950 + p_partkey % 75."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("company_id"),
        F.lower("p_name").alias("name"),
        F.lower("p_brand").alias("domain"),
        F.lower("p_type").alias("industry"),
        F.lit("").alias("locality"),
        F.lit("").alias("country"),
        size_bucket(F.col("p_size") * 300).alias("size_range"),
        (F.lit(1950) + F.col("p_partkey") % 75).cast("int").alias("year_founded"),
        F.array().cast("array<string>").alias("tags"),
    )


def companies_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with a country: customer ⋈ nation (nation is a 25-row dimension table)."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").cast("string").alias("company_id"),
        F.lower("c_name").alias("name"),
        F.lit("").alias("domain"),
        F.lower("c_mktsegment").alias("industry"),
        F.lit("").alias("locality"),
        F.lower("n_name").alias("country"),
        size_bucket(F.floor(F.abs("c_acctbal")).cast("int")).alias("size_range"),
        (F.lit(1900) + F.col("c_custkey") % 120).cast("int").alias("year_founded"),
        F.array().cast("array<string>").alias("tags"),
    )


def search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable corpus: documents LEFT JOIN embeddings ON doc_id = vec_id;
    name=text, industry=source, country=lang, locality=''."""
    t = search_texts(spark, sf_dir)
    e = read_table(spark, sf_dir, "embeddings")
    return t.join(e, t.doc_id == e.vec_id, "left").select(*t.columns, "embedding")


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search corpus without vectors."""
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("name"), F.col("source").alias("industry"), F.lit("").alias("locality"),
        F.col("lang").alias("country"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: benchmark items (whole text); vector = embeddings row with vec_id = item_id."""
    b = read_table(spark, sf_dir, "benchmark")
    e = read_table(spark, sf_dir, "embeddings")
    return b.join(e, b.item_id == e.vec_id, "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("vector"))


def user_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query log: user turns of ``conversations``; query_id = conv_id * 1000 + turn."""
    c = read_table(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def events_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ts`` as a TIMESTAMP (the file stores TIMESTAMP_NTZ; session is UTC)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))
