"""Companies by sets of tags and field values, as bitmaps.

Companies are numbered in the order of their ids. For each facet value (a tag, an industry, a size range, a
country) and each bucket of 32,768 numbers there is one bitmap of the companies that have it. A request's
facets meet by an aggregated AND for each bucket, which costs a few kilobytes a bucket however many companies
share a tag; counts of set bits then tell which buckets a page needs, and only those are spelled out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .sizing import bounded_broadcast

FIELDS = ("industry", "size_range", "country")
BITS = 32_768  # numbers in a bucket, fixed by Spark's bitmap functions


@dataclass
class FacetIndex:
    numbered: DataFrame  # pos (1 for the smallest id) and the companies' columns
    bitmaps: DataFrame  # facet, value, bucket, bits


def numbered_by(df: DataFrame, order: str, name: str = "numbered", slices: int | None = None) -> DataFrame:
    """``df`` with ``pos``: 1, 2, ... in the order of a column, ranges of it side by side. Rows are written once, a row
    knows its place in its slice, and slices are set off by their row counts (a row for each slice)."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_mid", F.monotonically_increasing_id())
    d = materialize(d, name).withColumn("_slice", F.shiftright("_mid", 33))
    sizes = d.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return d.join(bounded_broadcast(offsets, 100_000), "_slice").withColumn("pos", F.col("_off") + place + 1).select("pos", *df.columns)


def build_facet_index(companies: DataFrame, key: str = "company_id") -> FacetIndex:
    """NULL tags, NULL elements and NULL fields have no bitmap; a tag that a company repeats counts once."""
    numbered = numbered_by(companies, key, "facet-numbers")
    tags = F.transform(F.array_distinct(F.array_compact(F.coalesce("tags", F.array().cast("array<string>")))),
                       lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value")))
    fields = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in FIELDS])
    each = numbered.select("pos", F.explode(F.concat(tags, fields)).alias("x")).select("pos", "x.facet", "x.value").where(F.col("value").isNotNull())
    bitmaps = (each.groupBy("facet", "value", F.bitmap_bucket_number("pos").alias("bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bits")))
    return FacetIndex(numbered, materialize(bitmaps, "facet-bitmaps"))


def facet_hits(index: FacetIndex, asked: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """``(fs_id, pos)`` of the companies that have all of a request's facets. ``asked``: fs_id, ``facets
    array<struct<facet, value>>`` (distinct, none of them NULL), ``need`` (the first so many are enough; NULL: all)."""
    a = asked.select("fs_id", "need", F.size("facets").alias("_facets"), F.explode("facets").alias("x")).select("fs_id", "need", "_facets", "x.facet", "x.value")
    met = (index.bitmaps.join(bounded_broadcast(a, max_broadcast), ["facet", "value"]).groupBy("fs_id", "bucket")
           .agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_met"), F.first("_facets").alias("_facets"), F.first("need").alias("need"))
           .where(F.col("_met") == F.col("_facets")).withColumn("_hits", F.bitmap_count("bits")).where("_hits > 0"))
    before = Window.partitionBy("fs_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    needed = (met.withColumn("_before", F.coalesce(F.sum("_hits").over(before), F.lit(0)))
              .where(F.col("need").isNull() | (F.col("_before") < F.col("need"))).select("fs_id", "bucket", "bits"))
    used = needed.select("fs_id", "bucket", "bits", F.explode(F.expr(f"filter(sequence(0, {BITS // 8 - 1}), i -> substring(bits, i + 1, 1) <> X'00')")).alias("byte"))
    value = F.expr("cast(conv(hex(substring(bits, byte + 1, 1)), 16, 10) as int)")
    bits = used.select("fs_id", "bucket", "byte", value.alias("v")).select(
        "fs_id", "bucket", "byte", F.explode(F.expr("filter(sequence(0, 7), b -> (v & shiftleft(1, b)) <> 0)")).alias("bit"))
    return bits.select("fs_id", ((F.col("bucket") - 1) * BITS + F.col("byte") * 8 + F.col("bit") + 1).alias("pos"))
