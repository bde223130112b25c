"""Inverted index as DataFrames and set-at-a-time BM25 ``match`` scoring.

The index of one text field is three DataFrames:

* ``postings(doc_id, term, tf, dl)`` – one row per distinct (document, term);
* ``term_stats(term, df)`` – document frequency per term;
* ``corpus_stats(n_docs, avgdl)`` – one row; ``n_docs`` counts documents with at least
  one token, ``avgdl`` is total tokens / n_docs.

Scoring a whole table of queries is a join of the (small) query-term table against
postings and a ``groupBy(query_id, doc_id)``. BM25 (k1=1.2, b=0.75, no (k1+1) factor):
``idf = ln(1 + (N - df + .5)/(df + .5))``, ``w = tf / (tf + k1 (1 - b + b dl/avgdl))``,
score = boost · Σ_terms qtf · idf · w. Document lengths are exact (no lossy norms).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import materialize as _materialize
from ..session import shared_path
from .sizing import attach_scalars, bounded_broadcast, spread

K1 = 1.2
B = 0.75


SALTS = 8  # tasks that may share a term bucket when postings are written
TERM_BUCKETS = 64  # partitions of the written postings table; scale with the corpus (e.g. 1024 at 100 TB)


@dataclass
class TextIndex:
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    n_postings: int | None = None  # known when materialised; 0 ⇒ the field has no token at all
    buckets: int = 0  # > 0: postings carry ``tb`` = term bucket, a partition column on disk
    n_docs: int | None = None  # corpus statistics as scalars, known when materialised
    avgdl: float | None = None

    @property
    def empty(self) -> bool:
        return self.n_postings == 0


def term_bucket(term, buckets: int = TERM_BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_text_index(corpus: DataFrame, id_col: str, text_col: str | Column,
                     materialize: bool = False, name: str = "textindex", buckets: int = TERM_BUCKETS,
                     layout: str = "term") -> TextIndex:
    """Tokenise the whole text of every document and build the three index tables.

    Tokens of one document never leave its partition before the partial aggregation,
    so the only shuffle carries distinct (doc, term) pairs, hashed by (doc, term):
    frequent terms are spread over all reducers, not gathered in one.

    ``materialize=True`` writes the tables to the shared folder, with one of two
    physical layouts for the postings:

    * ``layout="term"``: partitioned by a term bucket ``tb`` (sorted by term inside), so
      a request reads only the buckets of its terms (dynamic partition pruning from the
      broadcast query side) — the layout for request-at-a-time search;
    * ``layout="doc"``: clustered by document (all terms of a document in one file,
      sorted by term), so all matched terms of a (query, document) pair meet in one task
      and are summed map-side before any shuffle — the layout for large query batches
      (measured at sf0.1: 200-query hybrid retrieval ~35 % faster than with "term").
    """
    if layout not in ("term", "doc"):
        raise ValueError("layout must be 'term' or 'doc'")
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    src = corpus.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    if materialize and layout == "doc":
        # documents hashed by id once: counting terms, sorting and writing then stay
        # inside each task (the term-count aggregation is already clustered by doc_id)
        src = src.repartition("doc_id")
    else:
        # tokenising is the costly step of an index build
        src = spread(src)
    docs = src.select("doc_id", tokens("_text").alias("toks"))
    postings = (docs.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
                .groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
                .select("doc_id", "term", "tf", "dl"))
    if not materialize:
        term_stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        lengths = postings.groupBy("doc_id").agg(F.first("dl").alias("dl"))
        corpus_stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"),
                                   (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
        return TextIndex(postings, term_stats, corpus_stats)
    spark = corpus.sparkSession
    path = shared_path(spark, f"{name}-postings")
    if layout == "term":
        out = postings.withColumn("tb", term_bucket(F.col("term"), buckets))
        # hash on the bucket and a salt of the document: no sampling pass, and a frequent term's
        # postings are written by up to SALTS tasks (files), each sorted by term
        out.repartition("tb", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).sortWithinPartitions("tb", "term").write.mode("overwrite").partitionBy("tb") \
            .parquet(path)
    else:
        out = postings
        # files = document shards (one per partition of the doc_id hash), terms sorted inside
        out.sortWithinPartitions("doc_id", "term").write.mode("overwrite").parquet(path)
    postings = spark.read.schema(out.schema).parquet(path)  # schema given: an empty field writes no file
    term_stats = _materialize(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{name}-terms")
    row = postings.groupBy("doc_id").agg(F.first("dl").alias("dl")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("_sum")).first()
    n_docs, total = int(row["n_docs"]), int(row["_sum"] or 0)
    corpus_stats = spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"),
                                         F.lit(total / n_docs if n_docs else None).cast("double").alias("avgdl"))
    return TextIndex(postings, term_stats, corpus_stats, n_postings=0 if n_docs == 0 else total,
                     buckets=buckets if layout == "term" else 0, n_docs=n_docs,
                     avgdl=(total / n_docs) if n_docs else None)


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str | Column = "query") -> DataFrame:
    """(query_id, term, qtf, slot): analysed query tokens; repeated tokens count repeatedly."""
    t = F.col(text) if isinstance(text, str) else text
    # the explicit non-empty filter (tokens never are) also marks this side as selective,
    # which lets Spark prune postings partitions dynamically from it
    # ``slot``: 0-based index of the term among the query's distinct terms (a window over
    # the small query-term table), so per-document term sets can be kept as bit masks
    from pyspark.sql import Window
    qt = (queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(t)).alias("term"))
          .where(F.col("term") != "")
          .groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("int").alias("qtf")))
    return qt.withColumn("slot", (F.dense_rank().over(Window.partitionBy("query_id").orderBy("term")) - 1)
                         .cast("int"))


def bm25_term_scores(index: TextIndex, qterms: DataFrame, boost: float = 1.0,
                     k1: float = K1, b: float = B, broadcast: bool | None = None,
                     max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Per matched (query_id, doc_id, term) contribution ``score`` (before summing).

    The query-term side (one row per query and term, carrying idf) is broadcast when
    ``broadcast`` is True, or — when None — when its row count is checked to be within
    ``max_broadcast_rows``; otherwise both sides shuffle on ``term``. On bucketed
    postings the join also matches the term bucket, which lets the broadcast side prune
    the postings partitions that hold none of the query terms.
    """
    terms = qterms.select("term").distinct()
    if broadcast:
        terms = F.broadcast(terms)
    stats = index.term_stats.join(terms, "term", "left_semi")
    if index.n_docs is not None:
        stats = stats.withColumns({"n_docs": F.lit(index.n_docs).cast("long"), "avgdl": F.lit(index.avgdl)})
    else:
        stats = attach_scalars(stats, index.corpus_stats)
    idf = stats.select("term", F.ln(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
                       .alias("idf"), F.col("avgdl"))
    qside = qterms.join(idf, "term")
    keys = ["term"]
    if index.buckets:
        qside = qside.withColumn("tb", term_bucket(F.col("term"), index.buckets))
        keys = ["tb", "term"]
    if broadcast is None:
        qside = bounded_broadcast(qside, max_broadcast_rows)
    elif broadcast:
        qside = F.broadcast(qside)
    p = index.postings.join(qside, keys)
    w = F.col("tf") / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    return p.select("query_id", "doc_id", "term", "slot",
                    (F.lit(boost) * F.col("qtf") * F.col("idf") * w).alias("score"))


def bm25(index: TextIndex, queries: DataFrame, query_id: str = "query_id", text: str | Column = "query",
         boost: float = 1.0, **kw) -> DataFrame:
    """(query_id, doc_id, score) for every document matching at least one query term."""
    ts = bm25_term_scores(index, query_terms(queries, query_id, text), boost=boost, **kw)
    return ts.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def top_k(scores: DataFrame, k: int, score: str = "score", key: str = "query_id", tie: str = "doc_id",
          rank: str = "rank", digits: int = 6) -> DataFrame:
    """Top-k per query, ties broken by ``tie`` ascending, score rounded to ``digits`` first.

    ``row_number() <= k`` plans as a partial WindowGroupLimit before the shuffle on
    ``key`` and a final one after it, so at most k rows per query and partition move.
    """
    from pyspark.sql import Window
    s = scores.withColumn(score, F.round(F.col(score), digits))
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie).asc())
    return s.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
