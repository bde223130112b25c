"""Company-file ingest as one Spark job.

read CSV (all cells as strings, bad cells tolerated) → resolve column spellings → lower
and fill strings → tolerant year cast → key (natural: domain else name, last row wins;
or dense ordinal in file order) → optional row limit → embed → typed projection → write.
No row passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import embed_text, first_nonempty, normalise_all_strings, tokens, tolerant_year

from ..functions.shipping import ship_by_value
from ..sources.quoted_csv import read_quoted_csv
from ..session import materialize
from .knn import zero_vector_fallback
from .sizing import bounded_broadcast

ship_by_value(__name__)

COMPANY_SCHEMA = T.StructType([
    T.StructField("company_id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("locality", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("size_range", T.StringType()),
    T.StructField("year_founded", T.IntegerType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

# Fixed values that must equal the reference: the two spellings of renamed columns.
COLUMN_ALIASES = {"year_founded": ("year founded", "year_founded"), "size_range": ("size range", "size_range")}

# Fixed values (synthetic generator): industries and the employee range.
SYNTH_INDUSTRIES = ["software", "information technology and services", "healthcare", "finance", "manufacturing"]
SYNTH_SIZE_MAX = 20000
SYNTH_YEAR_MIN, SYNTH_YEAR_MAX = 1900, 2024


def read_company_csv(spark: SparkSession, path: str, multi_line: bool = False, rows: int | None = None) -> DataFrame:
    """A1: header CSV, every cell a string, malformed rows tolerated (short rows → NULLs).
    A blank header cell becomes ``_c0``. Adds the file position columns used for ordering.
    ``multi_line`` accepts line breaks inside quoted cells; such files are read in splits, too
    (``sources.quoted_csv``).
    ``rows`` (A3): so many are wanted, so only the leading files, in path order, that hold them are read, each of
    them whole (all files with ``multi_line``)."""
    if multi_line:
        return read_quoted_csv(spark, path)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
    df = reader.csv(path)
    if rows is not None:
        df = reader.schema(df.schema).csv(_leading_files(spark, path, df.schema, rows))
    return df.select("*", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_mid"))


def _leading_files(spark: SparkSession, path: str, schema: T.StructType, rows: int) -> list[str]:
    """The first of the files of ``path``, in the order of ordinals, that hold ``rows`` rows (at least one file). They are
    counted in groups that double in size, without parsing a cell, and no further than to the group that suffices."""
    file = F.col("_metadata.file_path").alias("file")
    names = sorted(r["file"] for r in spark.read.format("binaryFile").load(path).select(file).collect())  # no content is read
    have, taken, step = 0, 0, 1
    while taken < len(names) and (have < rows or not taken):
        group = names[taken:taken + step]
        read = spark.read.schema(schema).option("header", True).option("escape", '"').csv([unquote(n) for n in group])
        found = {r["file"]: r["count"] for r in read.groupBy(file).count().collect()}  # a row a file
        for name in group:
            taken += 1
            have += found.get(name, 0)
            if have >= rows:
                break
        step *= 2
    return [unquote(n) for n in names[:taken]]


def with_ordinal(df: DataFrame, name: str = "_ordinal") -> DataFrame:
    """A5: dense 0..n-1 ordinal in file order (file, block, row), computed distributed.

    Per file split only (count, first row id) is aggregated — one small row per split, by a pass that parses no
    cell — turned into offsets by a window over that small table and written. Rows add their offset after a
    join with it, broadcast up to a million splits, so the rows themselves are not moved. The files are to be
    read under the settings for splits that hold now; a row whose split isn't known then fails the job.
    """
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    d = df.withColumn("_local", local)
    splits = d.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_lo"))
    w = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    offsets = materialize(offsets.select("_file", "_block", "_off", "_lo"), "csv-splits")
    j = d.join(bounded_broadcast(offsets, 1_000_000), ["_file", "_block"], "left")
    start = F.coalesce(F.col("_off"), F.raise_error(F.lit("the files were split anew since their rows were counted")).cast("long"))
    return j.withColumn(name, start + F.col("_local") - F.col("_lo")).drop("_off", "_lo", "_local")


def resolve_aliases(df: DataFrame) -> DataFrame:
    """The renamed columns from either spelling (first non-empty)."""
    cols = set(df.columns)
    out = df
    for canon, spellings in COLUMN_ALIASES.items():
        present = [s for s in spellings if s in cols]
        if present:
            out = out.withColumn(f"__{canon}", first_nonempty(*[F.col(f"`{s}`") for s in present]))
        else:
            out = out.withColumn(f"__{canon}", F.lit(None).cast("string"))
    for spellings in COLUMN_ALIASES.values():
        out = out.drop(*[s for s in spellings if s in cols])
    for canon in COLUMN_ALIASES:
        out = out.withColumnRenamed(f"__{canon}", canon)
    return out


def with_hashed_embedding(df: DataFrame, text: str | Column, out: str = "embedding", dim: int = 64) -> DataFrame:
    """D10 built-in encoder (model-free): bag of tokens hashed into ``dim`` slots
    (slot = first 8 hex digits of md5(token) mod dim), L2-normalised; all zeros when the
    text has no token. A real encoder plugs in through ``embed_with`` instead.

    Slots, counts and norm are each bound to a lambda's argument, so none is worked out again for every element
    (projections of their own would be merged into one).
    """
    def bound(x: Column, f) -> Column:
        return F.transform(F.array(x), f)[0]

    slots = F.transform(tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"),
                                                       F.lit(dim)).cast("int"))

    def normalised(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x * x))
        return bound(norm, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float")))

    def counted(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(held, lambda x: x == i)).cast("double"))

    return df.withColumn(out, bound(slots, lambda s: bound(counted(s), normalised)))


def embed_with(df: DataFrame, text_col: str, make_model, out: str = "embedding", failures: str = "raise") -> DataFrame:
    """D10 hook for a real encoder: ``make_model()`` returns a function
    ``pd.Series[str] -> pd.Series[list[float]]``. It runs as an iterator pandas UDF, so the
    model is built once per task and fed Arrow batches.

    ``failures="null"``: where the encoder raises, the batch is encoded row by row and only the rows that
    fail again have a NULL vector, to be set apart (``quarantined``) or replaced (``query_vectors``).
    """
    if failures not in ("raise", "null"):
        raise ValueError("failures must be 'raise' or 'null'")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_model()

        def one(text):
            try:
                return encode(pd.Series([text])).iloc[0]
            except Exception:
                return None

        for s in it:
            try:
                yield encode(s)
            except Exception:
                if failures == "raise":
                    raise
                yield pd.Series([one(t) for t in s], dtype=object)

    return df.withColumn(out, _embed(F.col(text_col)))


def quarantined(df: DataFrame, vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Ingest after failures: the rows to write, and the rows without a vector, to be kept aside and tried again. The
    rows are written first: both answers come from one run of the encoder."""
    df = materialize(df, "encoded")
    return df.where(F.col(vec).isNotNull()), df.where(F.col(vec).isNull()).drop(vec)


def query_vectors(queries: DataFrame, text_col: str, make_model, dim: int, out: str = "vector") -> DataFrame:
    """Vectors of query texts; a query that can't be encoded has the zero vector (no kNN part)."""
    found = embed_with(queries, text_col, make_model, out, failures="null")
    return found.withColumn(out, zero_vector_fallback(out, dim))


def clean_companies(raw: DataFrame, id_mode: str = "natural", missing_year: int | None = None,
                    limit: int | None = None, embed_dim: int | None = 64) -> DataFrame:
    """Raw CSV rows → canonical company rows (``COMPANY_SCHEMA``).

    id_mode 'natural': id = domain, else name; rows with neither are skipped; a later row
    with the same id replaces the earlier one. id_mode 'ordinal': id = running number.
    ``limit`` keeps exactly the first ``limit`` rows of the file (A3).
    """
    if id_mode == "natural" and limit is None:  # the place in the files orders versions; no running number needed
        df = raw.withColumn("_ordinal", F.struct("_file", "_block", "_mid"))
    else:
        df = with_ordinal(raw)
    if limit is not None:
        df = df.where(F.col("_ordinal") < F.lit(limit))
    df = resolve_aliases(df.drop("_file", "_block", "_mid"))
    df = normalise_all_strings(df)  # B1 (also turns NULL into '')
    for c in ("name", "domain", "industry", "locality", "country", "size_range"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    df = df.withColumn("year_founded", tolerant_year("year_founded", missing_year))
    if id_mode == "natural":
        df = df.withColumn("company_id", first_nonempty("domain", "name")).where(F.col("company_id").isNotNull())
    elif id_mode == "ordinal":
        df = df.withColumn("company_id", F.col("_ordinal").cast("string"))
    else:
        raise ValueError("id_mode must be 'natural' or 'ordinal'")
    doc_cols = ["company_id", "name", "domain", "industry", "locality", "country", "size_range", "year_founded"]
    docs = df.select(*doc_cols, "_ordinal")
    if id_mode == "natural":
        # A4: last row per key wins; max_by aggregates partially before the shuffle
        docs = (docs.groupBy("company_id")
                .agg(F.max_by(F.struct(*doc_cols[1:]), F.col("_ordinal")).alias("d"))
                .select("company_id", *[F.col(f"d.{c}").alias(c) for c in doc_cols[1:]]))
    docs = docs.withColumn("tags", F.array().cast("array<string>"))
    if embed_dim:
        return with_hashed_embedding(docs, embed_text("name", "industry", "locality", strip=True), "embedding",
                                     embed_dim)
    return docs.withColumn("embedding", F.lit(None).cast("array<float>"))


def conform(df: DataFrame, schema: T.StructType = COMPANY_SCHEMA) -> DataFrame:
    """Check and cast to the declared schema before a write; a missing column is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_companies(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bulk write as Parquet (task retries replace the reference's bulk retry loop)."""
    conform(df).write.mode(mode).parquet(path)


def upsert(table: DataFrame, new: DataFrame, key: str = "company_id") -> DataFrame:
    """A4/A12 merge with a stored table: rows of ``new`` replace rows with the same key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new.select(*table.columns))


def delete(table: DataFrame, ids: DataFrame, key: str = "company_id") -> DataFrame:
    """A12 delete by id."""
    return table.join(ids.select(key), key, "left_anti")


def lookup(table: DataFrame, ids: DataFrame, key: str = "company_id") -> DataFrame:
    """A10 lookup of many ids: a semi join (broadcast when the id list is small)."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def drop_table(spark: SparkSession, path: str, schema: T.StructType = COMPANY_SCHEMA) -> None:
    """Replace the stored table by an empty one with the same schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, src: str, dst: str, files: int, key: str = "company_id") -> DataFrame:
    """Rewrite a table into ``files`` range-partitioned files sorted by key."""
    df = spark.read.parquet(src)
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def synthetic_companies(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` seeded synthetic company rows (raw CSV layout, strings as the generator
    writes them). Every value is a hash of (id, seed), so any partitioning gives the
    same rows."""
    from ..functions.buckets import size_bucket

    h = lambda salt: F.abs(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)))
    size = (h("size") % SYNTH_SIZE_MAX + 1).cast("int")
    ind = F.array(*[F.lit(x) for x in SYNTH_INDUSTRIES])
    return spark.range(n).select(
        F.concat(F.lit("company "), F.col("id").cast("string")).alias("name"),
        F.concat(F.lit("company"), F.col("id").cast("string"), F.lit(".example")).alias("domain"),
        (h("year") % (SYNTH_YEAR_MAX - SYNTH_YEAR_MIN + 1) + SYNTH_YEAR_MIN).cast("string").alias("year_founded"),
        F.element_at(ind, (h("ind") % len(SYNTH_INDUSTRIES) + 1).cast("int")).alias("industry"),
        size_bucket(size).alias("size_range"),
        F.concat(F.lit("city "), (h("city") % 500).cast("string"), F.lit(", state "),
                 (h("state") % 50).cast("string")).alias("locality"),
        F.lit("united states").alias("country"),
        F.concat(F.lit("linkedin.com/company/c"), F.col("id").cast("string")).alias("linkedin url"),
        size.alias("current employee estimate"),
        (size * 3 / 2).cast("int").alias("total employee estimate"))


__all__ = ["COMPANY_SCHEMA", "read_company_csv", "clean_companies", "with_ordinal", "conform",
           "write_companies", "upsert", "delete", "lookup", "drop_table", "compact", "synthetic_companies",
           "with_hashed_embedding", "embed_with", "resolve_aliases"]
