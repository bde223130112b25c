"""Tags on company documents.

``add_tags`` applies a whole table of tag requests ``(company_id, tag, seq)``: per
company the new tags are appended in request order, each only if absent (the
reference's scripted update, applied set-at-a-time). Requests are first reduced to
(company, tag, first seq) with a partial aggregation, so a company that receives a
third of all requests still ships only its distinct tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

MAX_TAG_BUCKETS = 1000  # fixed value: size of the reference's tag listing


def add_tags(companies: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (updated companies, rejected requests for unknown companies)."""
    req = requests.withColumn("tag", py_strip("tag"))  # B17
    ids = companies.select("company_id")
    rejected = req.join(ids, "company_id", "left_anti")  # H3: not found
    firsts = (req.join(ids, "company_id", "left_semi")
              .groupBy("company_id", "tag").agg(F.min("seq").alias("seq")))
    new = (firsts.groupBy("company_id")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tag"))), lambda s: s["tag"]).alias("_new")))
    old = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    merged = F.concat(old, F.filter(F.col("_new"), lambda t: ~F.coalesce(F.array_contains(old, t), F.lit(False))))
    updated = (companies.join(new, "company_id", "left")
               .withColumn("tags", F.when(F.col("_new").isNull(), F.col("tags")).otherwise(merged))
               .drop("_new"))
    return updated, rejected


def all_tags(companies: DataFrame, size: int = MAX_TAG_BUCKETS) -> DataFrame:
    """The ``size`` most frequent tags (documents per tag desc, then tag)."""
    return (companies.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("doc_count"))
            .orderBy(F.col("doc_count").desc(), F.col("tag").asc()).limit(size))
