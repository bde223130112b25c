"""A company CSV in the reference's file layout, derived from ``part`` by Spark.

Used to exercise the CSV ingest path (A1–A5) on data that grows with the given tables.
Layout: a blank first header (upstream row number), reference column names with spaces,
upper-case industry, quoted localities with commas, some unknown or unparsable years,
repeated domains (later rows replace earlier ones) and rows keyed by name only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import size_bucket
from ..session import shared_path
from .tables import read_table

_written: dict = {}

CSV_COLUMNS = ["", "name", "domain", "year founded", "industry", "size range", "locality", "country",
               "linkedin url", "current employee estimate", "total employee estimate"]


def part_as_company_rows(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    """The CSV rows (all strings) in p_partkey order; ``where`` filters ``part`` first."""
    p = read_table(spark, sf_dir, "part")
    if where is not None:
        p = p.where(where)
    year = (F.when(F.col("p_size") > 45, F.lit(""))
            .when(F.col("p_size") == 13, F.lit("abc"))
            .otherwise(F.concat((F.lit(1950) + F.col("p_partkey") % 75).cast("string"), F.lit(".0"))))
    return p.orderBy("p_partkey").select(
        F.col("p_partkey").cast("string").alias(""),
        F.initcap("p_name").alias("name"),
        F.when(F.col("p_size") < 3, F.lit("")).otherwise(
            F.concat(F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(".com"))).alias("domain"),
        year.alias("year founded"),
        F.col("p_type").alias("industry"),
        size_bucket(F.col("p_size") * 300).alias("size range"),
        F.concat(F.lit("City "), F.col("p_size").cast("string"), F.lit(", State")).alias("locality"),
        F.lit("United States").alias("country"),
        F.lit("").alias("linkedin url"),
        (F.col("p_size") * 300).cast("string").alias("current employee estimate"),
        (F.col("p_size") * 450).cast("string").alias("total employee estimate"))


def company_csv_path(spark: SparkSession, sf_dir: str) -> str:
    """Write the derived CSV once per session into the shared folder (sorted by range, so
    the files' names are in p_partkey order) and return its path."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = shared_path(spark, "company-csv")
        (part_as_company_rows(spark, sf_dir).write.mode("overwrite")
         .option("header", True).option("emptyValue", "").csv(path))
        _written[key] = path
    return _written[key]
