"""C2–C8 over a table laid out for its filters: a company table clustered on a space-filling curve.

Rows are ordered by the interleaved bits of where their industry, country, size range and founding year lie
among all rows (equal-depth buckets, so that a value held by a third of the rows takes as much room and no
more), cut into files of equal size by range. Beside the files stand two small tables: which hash slots of a column's
values occur in a file (a one-hash Bloom filter, one row a set slot), and the founding years it spans.
A request reads the files that these tables can't rule out. Its answer is the plain table's: files are left out
only where no row of theirs can match.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_path
from .search import EQ_FIELDS, SearchRequest, search
from .textindex import TextIndex

#: Columns of the curve, the leading one first; buckets of a column are 2 ** BITS.
CURVE = ("industry", "country", "size_range", "year_founded")
BITS = 5
#: Hash slots of a column's values in the table beside the files.
SLOTS = 4096


def _number(column: str) -> Column:
    return F.col(column).cast("long") if column == "year_founded" else F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def _slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SLOTS)).cast("int")


def curve_place(companies: DataFrame, columns: tuple[str, ...] = CURVE) -> Column:
    """The place of a row on the curve. One pass over the table finds the bounds of the buckets (2 ** BITS - 1
    numbers a column)."""
    shares = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    bounds = companies.agg(*[F.percentile_approx(_number(c), shares, 2000).alias(c) for c in columns]).first()
    buckets = [reduce(lambda a, b: a + b, [F.when(_number(c) > F.lit(x), 1).otherwise(0) for x in bounds[c] or []], F.lit(0)) for c in columns]
    bits = [F.shiftright(b, at).bitwiseAND(F.lit(1)) for at in reversed(range(BITS)) for b in buckets]
    return reduce(lambda z, bit: z * 2 + bit, bits, F.lit(0))


@dataclass
class ClusteredCompanies:
    """A clustered table, its slots ``(file, field, slot)`` and its years ``(file, first, last)``, one row a file."""
    rows: DataFrame
    slots: DataFrame
    years: DataFrame

    def files(self, req: SearchRequest) -> DataFrame:
        """``(file)``: those that may hold a company that meets the request's fields and years."""
        found = self.years
        if req.year_from:
            found = found.where(F.col("last") >= F.lit(int(req.year_from)))
        if req.year_to:
            found = found.where(F.col("first") <= F.lit(int(req.year_to)))
        for f in EQ_FIELDS:
            if value := getattr(req, f):
                held = self.slots.where((F.col("field") == f) & (F.col("slot") == _slot(F.lit(value.lower()))))
                found = found.join(held.select("file"), "file", "left_semi")
        return found.select("file")

    def read(self, req: SearchRequest) -> DataFrame:
        """The rows of these files. Only their names pass through the driver, which lists files for a scan anyway."""
        names = [unquote(r["file"]) for r in self.files(req).collect()]
        if not names:
            return self.rows.where(F.lit(False))
        return self.rows.sparkSession.read.schema(self.rows.schema).parquet(*names)


def write_clustered(companies: DataFrame, files: int, path: str | None = None) -> ClusteredCompanies:
    """Write ``companies`` in ``files`` files along the curve (an id's Bloom filter in each, for lookups by id) and the tables beside
    them. NULL and empty fields share a bucket; a NULL field sets no slot, a file without years has none to offer.
    Rows of one place on the curve are told apart by their id, so they may fill several files."""
    spark = companies.sparkSession
    path = path or shared_path(spark, "companies-clustered")
    (companies.withColumn("__place", curve_place(companies)).repartitionByRange(files, "__place", "company_id")
     .sortWithinPartitions("__place", "company_id").drop("__place").write
     .option("parquet.bloom.filter.enabled#company_id", "true").mode("overwrite").parquet(path))
    rows = spark.read.schema(companies.schema).parquet(path)
    named = rows.select(F.col("_metadata.file_path").alias("file"), *EQ_FIELDS, "year_founded")
    held = named.select("file", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), _slot(F.col(f))).alias("slot"))
                                                    for f in EQ_FIELDS])).alias("s"))
    slots = materialize(held.where("s.slot is not null").select("file", "s.*").distinct(), "companies-slots")
    years = materialize(named.groupBy("file").agg(F.min("year_founded").alias("first"), F.max("year_founded").alias("last")), "companies-years")
    return ClusteredCompanies(rows, slots, years)


def search_clustered(table: ClusteredCompanies, req: SearchRequest, index: TextIndex | None = None) -> DataFrame:
    """``search`` over the files that can hold matches. A name request needs its ``index``: the statistics of
    names are those of the whole table."""
    if req.name and index is None:
        raise ValueError("a name request needs the index of the whole table")
    return search(table.read(req), req, index)
