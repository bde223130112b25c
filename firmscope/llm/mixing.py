"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has an exponential key ``-ln(u) / weight`` (u from a hash of its id, so reruns
agree; weight from its quality); sorted by it, the first documents are a weighted sample without
replacement. A source's target is met by complete epochs (every document so often) and then, for
what remains, by the first documents in key order up to the remaining words.

The sort is distributed: keys fall into ``BUCKETS`` ranges, and each range into as many finer ones,
cut evenly by the mean of the keys' distributions at the three quality weights, so that a range holds
at most 3 in ``BUCKETS`` of the documents of any of these weights. Words are summed for each source and range
(partial sums before the shuffle), then for each finer range of the one or two ranges in which a source's
remainder ends, and only one or two finer ranges are sorted. The sources themselves are put in order by
ranges, too. What comes out is one cut for each source: a document gets its extra copy if its key lies below, and every document of a source does
if its remainder ends after the middle of the last one (no cut). So no source's documents meet in
one task, and the plan is made without texts. Functions of DataFrames only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, plain_id, solid_id

BUCKETS = 4096
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SEED = 7
#: Quality weight of a document labelled good, labelled bad, and not labelled.
GOOD, BAD, UNKNOWN = 1.0, 0.25, 0.5


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _with_keys(df: DataFrame) -> DataFrame:
    """Adds the sampling key, the finer range it falls into, and the order (ties end with the id)."""
    u = (F.shiftrightunsigned(F.xxhash64("__did", F.lit(SEED)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    weight = F.col("__weight")
    out = df.withColumn("__key", -F.log(u) / weight)
    beyond = sum((F.exp(-F.col("__key") * w) for w in (GOOD, UNKNOWN, BAD)), F.lit(0.0)) / 3
    out = out.withColumn("__fine", F.least(F.floor((1 - beyond) * BUCKETS * BUCKETS), F.lit(BUCKETS * BUCKETS - 1)).cast("int"))
    return out.withColumn("__order", F.struct("__fine", "__key", "__did", "__size"))


def _with_running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Adds to each row the sums over the rows before it. Rows are dealt to ranges of ``order`` (which must not
    tie) and summed inside each; one row a range, as many as there are tasks, carries the sums on."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)
    ahead = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    carried = carried.select("__range", *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums])
    out = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()]).join(carried, "__range")
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *[f"__{n}" for n in sums])


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(__did, __weight)`` of the labelled documents; an id labelled twice has the better label."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__did"))
    return known.agg(F.when(F.max("quality") > 0, GOOD).otherwise(BAD).alias("__weight"))


def targets(sizes: DataFrame) -> DataFrame:
    """``(skey, source, source_size, target)`` from ``(skey, source, source_size)``: weights 3, 1, 2 and so on
    in code point order (null last) share 150 % of all words; a target stops at twice its source's size and
    the excess goes to the others by weight until none is above. Solved at once: sources in order of
    cap by weight, and the common level at the first source that stays below its cap. One row a source."""
    placed = _with_running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "mix-places")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    s = placed.withColumn("w", weight).withColumn("cap", F.col("source_size") * MOST).withColumn("r", F.col("cap") / F.col("w"))
    s = _with_running(s, [F.col("r").asc(), F.col("skey").asc()], {"caps": F.col("cap"), "weights": F.col("w")}, "mix-levels")
    whole = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    s = s.withColumn("level", (whole["size"] * F.lit(SHARE) - F.col("caps")) / (F.lit(whole["w"]) - F.col("weights")))
    found = s.where("r > level").agg(F.max("level")).first()[0]
    return s.select("skey", "source", "source_size",
                    F.when(F.col("r") <= F.col("level"), F.col("cap")).otherwise(F.lit(found).cast("double") * F.col("w")).alias("target"))


def _plan(docs: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes, weights and order (no texts), and one row a source: epochs, cut, target."""
    rows = docs.select(solid_id().alias("__did"), F.col("source"), _source_key(F.col("source")).alias("skey"), words_in(F.col("text")).alias("__size"))
    rows = _weighted(rows, docs, labels)
    rows = materialize(_with_keys(rows), "mix-rows")
    sizes = rows.groupBy("skey", "source").agg(F.sum("__size").alias("source_size"))
    s = materialize(targets(sizes), "mix-targets")
    s = s.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    s = s.withColumn("rest", F.col("target") - F.col("__epochs") * F.col("source_size"))

    bucket = F.shiftright("__fine", BUCKETS.bit_length() - 1)
    ranges = rows.groupBy("skey", bucket.alias("b")).agg(F.sum("__size").alias("n")).where("n > 0")
    ranges = ranges.join(s.select("skey", "rest"), "skey").withColumn("start", F.lit(0).cast("long"))
    near = materialize(_where_it_ends(ranges), "mix-ranges")
    finer = (rows.withColumn("b", bucket).join(near.select("skey", "b"), ["skey", "b"]).groupBy("skey", F.col("__fine").alias("b"))
             .agg(F.sum("__size").alias("n")).where("n > 0"))
    last = _where_it_ends(finer.join(near.groupBy("skey").agg(F.min("below").alias("start"), F.first("rest").alias("rest")), "skey"))
    inside = Window.partitionBy("skey", "__fine").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    ends = (rows.join(last.withColumnRenamed("b", "__fine"), ["skey", "__fine"])
            .withColumn("ahead", F.col("below") + F.coalesce(F.sum("__size").over(inside), F.lit(0)))
            .where((F.col("__size") > 0) & (F.col("ahead") + F.col("__size") / 2 > F.col("rest"))))
    cut = ends.groupBy("skey").agg(F.min("__order").alias("__cut"))
    return rows, materialize(s.join(cut, "skey", "left"), "mix-sources")


def _where_it_ends(ranges: DataFrame) -> DataFrame:
    """``(skey, b, below, rest)``: of the ranges ``(skey, b, n, start, rest)`` of each source, at most ``BUCKETS`` twice,
    the two from the one on in which the remainder ends, and the words below each."""
    running = Window.partitionBy("skey").orderBy("b")
    upto = ranges.withColumn("upto", F.col("start") + F.sum("n").over(running)).where("upto > rest")
    return (upto.withColumn("i", F.row_number().over(running)).where("i <= 2")
            .select("skey", "b", (F.col("upto") - F.col("n")).alias("below"), "rest"))


def _weighted(rows: DataFrame, docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("__weight", F.lit(1.0))
    known = quality_weights(docs, labels)
    return rows.join(known, "__did", "left").withColumn("__weight", F.coalesce("__weight", F.lit(UNKNOWN)))


def _copies() -> Column:
    whole = F.col("__cut").isNull() & (F.col("rest") > 0)  # the remainder ends after the middle of the last document
    return F.col("__epochs") + F.when((F.col("__size") > 0) & (whole | (F.col("__order") < F.col("__cut"))), 1).otherwise(0)


def mixture(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(did, size, source_size, target, copies, taken)`` for every row of ``docs``; ``taken`` words are
    ``copies`` times its size, and copies are 0, 1 or 2. A source's taken words miss its target by half a
    document at most. Null and empty texts have size 0; a source without words takes nothing. Rows
    alike in id, size and source are taken alike. An empty table gives no rows."""
    rows, sources = _plan(docs, labels)
    out = rows.join(sources.drop("source"), "skey")
    return out.select(F.col("__did").alias("did"), F.col("__size").alias("size"), "source_size", "target",
                      _copies().alias("copies"), (_copies() * F.col("__size")).alias("taken"))


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it; columns stay as they are. Texts move
    once, to meet their quality weights, if labels are given and too many to broadcast."""
    rows, sources = _plan(docs, labels)
    out = docs.select(solid_id().alias("__did"), words_in(F.col("text")).alias("__size"), _source_key(F.col("source")).alias("skey"),
                      F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if labels is None:
        out = out.withColumn("__weight", F.lit(1.0))
    else:  # the weights by id, from the rows that were weighted above
        weights = rows.where(F.col("__weight") != UNKNOWN).select("__did", "__weight").distinct()
        out = out.join(weights, "__did", "left").withColumn("__weight", F.coalesce("__weight", F.lit(UNKNOWN)))
    out = _with_keys(out).join(sources.select("skey", "__epochs", "__cut", "rest"), "skey")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), _copies()))).select("row.*")


def op6_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mixture(docs, labels).select(plain_id(F.col("did")).alias("doc_id"), "size", "source_size", "target", "taken")
