"""A2/A4/A6 incremental: company files arriving in a folder, ingested micro-batch by
micro-batch with Structured Streaming.

Each micro-batch is cleaned by the batch job (``clean_companies``, natural keys) and
*appended* to a change log ``(company_id, …, _epoch, _ordinal)`` in the target folder;
``current_companies`` reads the log and keeps the last version of every key with a
``max_by`` aggregation (partial, hot-key safe). Appends make a replayed epoch harmless:
its rows are identical to the first attempt, and last-wins picks either copy. A14
``compact_changes`` rewrites the log into one version per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import clean_companies

DOC_COLS = ["company_id", "name", "domain", "industry", "locality", "country", "size_range", "year_founded", "tags",
            "embedding"]


def start_ingest_stream(spark: SparkSession, source_dir: str, csv_columns: list[str], target: str,
                        checkpoint: str, max_files_per_trigger: int = 1, embed_dim: int | None = 64,
                        trigger_available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``. ``csv_columns``: header names of
    the files (streaming file sources need a schema; every cell is read as a string)."""
    schema = T.StructType([T.StructField(c if c else "_c0", T.StringType()) for c in csv_columns])
    stream = (spark.readStream.schema(schema).option("header", True).option("mode", "PERMISSIVE")
              .option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir)
              .select("*", F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block")))

    def upsert_batch(batch: DataFrame, epoch_id: int) -> None:
        raw = batch.withColumn("_mid", F.monotonically_increasing_id())
        clean = clean_companies(raw, id_mode="natural", embed_dim=embed_dim)
        # within-batch order for last-wins across epochs: the file order of the kept row
        out = clean.withColumn("_epoch", F.lit(epoch_id).cast("long"))
        out.select(*DOC_COLS, "_epoch").write.mode("append").parquet(target)

    w = stream.writeStream.foreachBatch(upsert_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w
    return w.start()


def current_companies(spark: SparkSession, target: str) -> DataFrame:
    """Current table: the latest version of every key in the change log."""
    log = spark.read.parquet(target)
    cols = [c for c in DOC_COLS if c != "company_id"]
    return (log.groupBy("company_id").agg(F.max_by(F.struct(*cols), F.col("_epoch")).alias("d"))
            .select("company_id", *[F.col(f"d.{c}").alias(c) for c in cols]))


def compact_changes(spark: SparkSession, target: str, dst: str, files: int) -> DataFrame:
    """A14 for the change log: one row per key, range-partitioned by key into ``files`` files. They are older than any
    epoch, so a stream that goes on in ``dst`` (a new one, too) has the last word."""
    cur = current_companies(spark, target).withColumn("_epoch", F.lit(-1).cast("long"))
    cur.repartitionByRange(files, "company_id").sortWithinPartitions("company_id").write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)
