"""A4/A10/A12 on a stored table that is not rewritten: rows lie in buckets of their key, a change writes its buckets anew.

``path/v=<version>/kb=<bucket>/`` holds a bucket as a version left it; the manifest (one row a bucket and change, a folder
beside the table) says which version of each bucket counts. An upsert or a delete reads the buckets that its keys fall into,
writes them under a new version and then adds to the manifest, which is the commit: until then, and for
readers that opened the table before, the earlier buckets stay as they were. Other buckets are neither read nor
written. A change that fails half way leaves files that no manifest names; its repetition writes over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path
from .sizing import bounded_broadcast


@dataclass(frozen=True)
class KeyedTable:
    """A version of the table. ``live``: the version of each bucket (as many numbers as buckets, whatever the rows)."""
    spark: SparkSession
    path: str
    key: str
    buckets: int
    schema: T.StructType
    version: int
    live: dict[int, int]

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, buckets) -> DataFrame:
        paths = [f"{self.path}/v={self.live[b]}/kb={b}" for b in sorted(buckets) if b in self.live]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows(self) -> DataFrame:
        return self._read(self.live)

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._bucket(F.col(self.key))).distinct().collect()]  # at most ``buckets``

    def lookup(self, ids: DataFrame) -> DataFrame:
        """A10: the rows of the keys in ``ids``, from their buckets only."""
        return self._read(self._touched(ids)).join(bounded_broadcast(ids.select(self.key).distinct(), 1_000_000), self.key, "left_semi")

    def upsert(self, new: DataFrame) -> "KeyedTable":
        """Rows of ``new`` (one a key) replace rows with the same key. A NULL key replaces nothing and is added."""
        touched = self._touched(new)
        kept = self._read(touched).join(bounded_broadcast(new.select(self.key), 1_000_000), self.key, "left_anti")
        return self._commit(kept.unionByName(new.select(*self.schema.names)), touched)

    def delete(self, ids: DataFrame) -> "KeyedTable":
        """Rows of the keys in ``ids`` go."""
        touched = [b for b in self._touched(ids) if b in self.live]
        return self._commit(self._read(touched).join(bounded_broadcast(ids.select(self.key), 1_000_000), self.key, "left_anti"), touched)

    def _commit(self, rows: DataFrame, touched: list[int]) -> "KeyedTable":
        if not touched:
            return self
        version = self.version + 1
        bucket = self._bucket(F.col(self.key))
        (rows.withColumn("kb", bucket).repartition(max(1, len(touched)), "kb").sortWithinPartitions("kb", self.key)
         .write.partitionBy("kb").mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.path}/v={version}"))
        filled = self._filled(version)
        live = {b: v for b, v in self.live.items() if b not in set(touched)} | {b: version for b in filled}
        changes = [(version, b, b in filled) for b in sorted(touched)]
        self.spark.createDataFrame(changes, "version int, kb int, filled boolean").coalesce(1).write.mode("append").parquet(f"{self.path}-manifest")
        return KeyedTable(self.spark, self.path, self.key, self.buckets, self.schema, version, live)

    def _filled(self, version: int) -> set[int]:
        """Buckets that have rows left in ``version``; an empty one has no folder."""
        schema = T.StructType([T.StructField(self.key, self.schema[self.key].dataType), T.StructField("kb", T.IntegerType())])
        found = self.spark.read.schema(schema).parquet(f"{self.path}/v={version}").select("kb").distinct()
        return {r["kb"] for r in found.collect()}


def create_keyed(rows: DataFrame, buckets: int = 256, key: str = "company_id", path: str | None = None) -> KeyedTable:
    """Write ``rows`` (one a key) as a keyed table. ``buckets`` should let a bucket be written by one task."""
    path = path or shared_path(rows.sparkSession, "keyed-companies")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    return KeyedTable(rows.sparkSession, path, key, buckets, schema, -1, {})._commit(rows, list(range(buckets)))


def open_keyed(spark: SparkSession, path: str, schema: T.StructType, buckets: int = 256, key: str = "company_id") -> KeyedTable:
    """The table as its manifest has it now."""
    log = spark.read.schema("version int, kb int, filled boolean").parquet(f"{path}-manifest")
    last = log.groupBy("kb").agg(F.max_by(F.struct("version", "filled"), "version").alias("m")).select("kb", "m.*").collect()  # a row a bucket
    version = max(r["version"] for r in last)
    return KeyedTable(spark, path, key, buckets, schema, version, {r["kb"]: r["version"] for r in last if r["filled"]})
