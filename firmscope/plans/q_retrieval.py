"""Registered retrieval queries: D1, D3, C12, D5, D13, D14, B16 (benchmark items as
queries over the documents/embeddings corpus)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.blockindex import Clause, top_documents
from ..operators.knn import knn
from ..operators.retrieval import build_hybrid_index, diagnostics, first_stage, guarded_reranker, two_stage_retrieval
from ..operators.sizing import attach_scalars
from ..session import materialize
from ..sources.tables import benchmark_queries, read_table, search_corpus, search_texts
from .registry import register
from .sqlparts import bm25_ctes, bm25_terms_cte, qterms_cte, tokens

_CORPUS = ("SELECT d.doc_id, d.text AS name, d.source AS industry, '' AS locality, d.lang AS country, e.embedding "
           "FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
_QUERIES = ("SELECT b.item_id AS query_id, b.text AS query, e.embedding AS vector "
            "FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id")

_cache: dict = {}


def hybrid_index(spark, sf_dir):
    """The hybrid index of the documents corpus, written once per session to the shared
    folder. The registered queries answer batches of queries: layout "blocks"."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cache:
        _cache[key] = build_hybrid_index(search_corpus(spark, sf_dir), materialize=True, layout="blocks", texts=search_texts(spark, sf_dir))
    return _cache[key]


# --- D1 -----------------------------------------------------------------------------

D1_SQL = f"""WITH {bm25_ctes('nm', 'SELECT doc_id, text FROM documents', 'doc_id', 'text')},
{qterms_cte('qt', 'SELECT item_id, text FROM benchmark', 'item_id', 'text')},
{bm25_terms_cte('st', 'nm', 'qt', 1.0)},
agg AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM st GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER)
AS rank FROM agg) WHERE rank <= 100"""


@register("d1_bm25_match", D1_SQL)
def d1_bm25_match(spark, sf_dir):
    """BM25 match of every benchmark item over the whole document texts, top 100."""
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return top_documents(hybrid_index(spark, sf_dir).blocks, q, [Clause("name", "query", 1.0)], 100).select("query_id", "doc_id", "score", "rank")


@register("d1_scored_share", """SELECT item_id AS query_id, TRUE AS scored_under_a_fifth FROM benchmark""")
def d1_scored_share(spark, sf_dir):
    """D1's top 10 as above: of all (query, document) pairs, under a fifth are looked up in all terms of the query."""
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    n = top_documents(hybrid_index(spark, sf_dir).blocks, q, [Clause("name", "query", 1.0)], 10, counted=True)
    share = n.agg((F.sum("scored") < 0.2 * F.sum("size")).alias("scored_under_a_fifth"))
    return attach_scalars(n.select("query_id").distinct(), share)


# --- D3 / D13 / C12 -----------------------------------------------------------------

def _knn_sql(corpus_where: str, k: int, corpus_sql: str = "SELECT vec_id AS doc_id, embedding FROM embeddings") -> str:
    return f"""WITH q AS ({_QUERIES}),
c AS (SELECT * FROM ({corpus_sql}) WHERE embedding IS NOT NULL {corpus_where}),
s AS (SELECT q.query_id, c.doc_id,
             round(list_cosine_similarity(q.vector::DOUBLE[], c.embedding::DOUBLE[]), 9) AS sim
      FROM q, c WHERE q.vector IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS INTEGER) AS knn_rank
      FROM s)
SELECT query_id, doc_id, sim, 1 / (2 - sim) AS knn_score, knn_rank FROM r WHERE knn_rank <= {k}"""


@register("d3_knn_top100", _knn_sql("", 100))
def d3_knn(spark, sf_dir):
    """D3: exact cosine kNN (k=100) of every benchmark vector over all embeddings."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return knn(e, benchmark_queries(spark, sf_dir), k=100)


@register("c12_prefiltered_knn", _knn_sql("AND label >= 5", 10,
                                          "SELECT vec_id AS doc_id, embedding, label FROM embeddings"))
def c12_prefiltered_knn(spark, sf_dir):
    """Hard filter (label >= 5, pushed into the scan) then kNN k=10 on the survivors."""
    e = read_table(spark, sf_dir, "embeddings").where(F.col("label") >= 5)
    return knn(e.select(F.col("vec_id").alias("doc_id"), "embedding"), benchmark_queries(spark, sf_dir), k=10)


@register("d13_knn_only_documents", _knn_sql("", 5, _CORPUS))
def d13_knn_only(spark, sf_dir):
    """kNN-only search (size 5, k 5) over the documents corpus."""
    c = search_corpus(spark, sf_dir).select("doc_id", "embedding")
    return knn(c, benchmark_queries(spark, sf_dir), k=5)


@register("d3_knn_l2", """WITH q AS (SELECT b.item_id AS query_id, e.embedding::DOUBLE[] AS v FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id),
s AS (SELECT query_id, vec_id AS doc_id, round(greatest(list_dot_product(v, v) + list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])
        - 2 * list_dot_product(v, embedding::DOUBLE[]), 0.0), 9) AS sim FROM q, embeddings),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim, doc_id) AS INTEGER) AS knn_rank FROM s)
SELECT query_id, doc_id, round(sim, 6) AS sim, knn_rank FROM r WHERE knn_rank <= 10""")
def d3_l2(spark, sf_dir):
    """D3 with squared Euclidean distance, k=10."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = knn(e, benchmark_queries(spark, sf_dir), k=10, metric="l2")
    return out.select("query_id", "doc_id", F.round("sim", 6).alias("sim"), "knn_rank")


@register("d3_knn_text_ids", f"""SELECT 'q' || query_id AS query_id, 'd' || doc_id AS doc_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, 'd' || doc_id) AS r FROM (
    SELECT query_id, doc_id, sim FROM ({_knn_sql('', 1000000000)}))) WHERE r <= 10""")
def d3_text_ids(spark, sf_dir):
    """D3/D13/C12 with ids of text, as the natural keys of the ingest are."""
    e = read_table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("doc_id"), "embedding")
    q = benchmark_queries(spark, sf_dir).withColumn("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    return knn(e, q, k=10).select("query_id", "doc_id", "sim")


# --- D4/D5 and D14 ------------------------------------------------------------------

HYBRID_CTES = f"""WITH corpus AS ({_CORPUS}),
queries AS ({_QUERIES}),
{bm25_ctes('nm', 'SELECT * FROM corpus', 'doc_id', 'name')},
{bm25_ctes('ind', 'SELECT * FROM corpus', 'doc_id', 'industry')},
{qterms_cte('qt', 'SELECT * FROM queries', 'query_id', 'query')},
{bm25_terms_cte('s_name', 'nm', 'qt', 1.0)},
{bm25_terms_cte('s_ind', 'ind', 'qt', 0.5)},
knn_raw AS (SELECT q.query_id, c.doc_id,
                   round(list_cosine_similarity(q.vector::DOUBLE[], c.embedding::DOUBLE[]), 9) AS sim
            FROM queries q, corpus c WHERE q.vector IS NOT NULL AND c.embedding IS NOT NULL),
knn AS (SELECT query_id, doc_id, 1 / (2 - sim) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rn FROM knn_raw)
        WHERE rn <= 100),
allc AS (SELECT query_id, doc_id, score, term AS rr_term, NULL::DOUBLE AS knn_only FROM s_name
         UNION ALL SELECT query_id, doc_id, score, term, NULL FROM s_ind
         UNION ALL SELECT query_id, doc_id, score, NULL, score FROM knn),
agg AS (SELECT query_id, doc_id, round(sum(score), 6) AS hybrid_score, max(knn_only) AS knn_only_score,
               count(DISTINCT rr_term) AS matched_terms FROM allc GROUP BY ALL),
s1 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, doc_id)
                              AS INTEGER) AS stage1_rank FROM agg) WHERE stage1_rank <= 100)"""

D5_SQL = HYBRID_CTES + "\nSELECT query_id, doc_id, hybrid_score, knn_only_score, matched_terms, stage1_rank FROM s1"

D14_SQL = HYBRID_CTES + f""",
nq AS (SELECT query_id, len(list_distinct({tokens('query')})) AS n_qterms FROM queries),
rr AS (SELECT s1.*, coalesce(round(CASE WHEN n_qterms > 0 THEN matched_terms / n_qterms END, 6), 0.0)
              AS re_rank_score FROM s1 JOIN nq USING (query_id)),
fin AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY re_rank_score DESC, stage1_rank)
        AS INTEGER) AS rank FROM rr)
SELECT query_id, rank, doc_id, re_rank_score, hybrid_score AS knn_score, knn_only_score FROM fin WHERE rank <= 10"""


@register("d5_hybrid_first_stage", D5_SQL)
def d5_first_stage(spark, sf_dir):
    """BM25(name)x1 + BM25(industry)x0.5 + kNN(k=100) summed, top 100 per query."""
    return first_stage(hybrid_index(spark, sf_dir), _with_intent(benchmark_queries(spark, sf_dir))).select(
        "query_id", "doc_id", "hybrid_score", "knn_only_score", "matched_terms", "stage1_rank")


@register("d14_two_stage_retrieval", D14_SQL)
def d14_two_stage(spark, sf_dir):
    """D14 (flagship): hybrid top 100 → lexical rerank → top 10 for every benchmark query."""
    return two_stage_retrieval(hybrid_index(spark, sf_dir), benchmark_queries(spark, sf_dir))


D16_SQL = D14_SQL.replace("SELECT query_id, rank, doc_id, re_rank_score, hybrid_score AS knn_score, knn_only_score "
                          "FROM fin WHERE rank <= 10",
                          "SELECT query_id, CAST(count(*) AS INTEGER) AS n_scores, min(re_rank_score) AS min_re_rank, "
                          "max(hybrid_score) AS max_knn_score, 'SemanticSearch' AS route FROM fin WHERE rank <= 10 "
                          "GROUP BY query_id")


@register("b16_diagnostics", D16_SQL)
def b16_diagnostics(spark, sf_dir):
    """Per-query diagnostics (route + ordered score list), summarised for the check."""
    idx = hybrid_index(spark, sf_dir)
    res = two_stage_retrieval(idx, benchmark_queries(spark, sf_dir))
    d = diagnostics(res, idx.corpus)
    return d.select("query_id", F.size("scores").alias("n_scores"),
                    F.array_min(F.transform("scores", lambda s: s["re_rank_score"])).alias("min_re_rank"),
                    F.array_max(F.transform("scores", lambda s: s["knn_score"])).alias("max_knn_score"), "route")


def _with_intent(q):
    return q.withColumn("intent_industry", F.lit(None).cast("string")).withColumn(
        "intent_country", F.lit(None).cast("string"))


D8_SQL = HYBRID_CTES + """
SELECT query_id, stage1_rank AS rank, doc_id, 0.0::DOUBLE AS re_rank_score, hybrid_score AS knn_score FROM s1 WHERE stage1_rank <= 10"""


@register("d8_rerank_fallback", D8_SQL)
def d8_fallback(spark, sf_dir):
    """A scorer that raises scores 0 everywhere, so the first stage's order stays."""
    def failing(queries, texts):
        raise RuntimeError("the scorer is down")

    res = two_stage_retrieval(hybrid_index(spark, sf_dir), benchmark_queries(spark, sf_dir), reranker=guarded_reranker(failing))
    return res.select("query_id", "rank", "doc_id", "re_rank_score", "knn_score")


@register("d14_after_ingest")
def d14_ingested(spark, sf_dir):
    """A1-A4, D10, D11, D14 in one chain: companies as the ingest keys and embeds them (text ids), indexed, and
    searched with the benchmark's texts and their vectors from the same encoder."""
    from ..operators.ingest import clean_companies, with_hashed_embedding
    from .q_ingest import _raw
    co = clean_companies(_raw(spark, sf_dir), id_mode="natural", embed_dim=64)
    # companies and query vectors are read several times: written once
    corpus = materialize(co.select(F.col("company_id").alias("doc_id"), "name", "industry", "locality", "country", "embedding"), "ingested")
    idx = build_hybrid_index(corpus, materialize=True, layout="blocks")
    b = read_table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"))
    q = materialize(with_hashed_embedding(b, "query", out="vector"), "ingested-queries")
    return two_stage_retrieval(idx, q).select("query_id", "rank", "doc_id", "re_rank_score", "knn_score", "knn_only_score")


# --- D12 ----------------------------------------------------------------------------

D12_SQL = """SELECT item_id AS query_id, 10::BIGINT AS n_found, TRUE AS recall_ok FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id"""


@register("d12_lsh_candidates", D12_SQL)
def d12_lsh(spark, sf_dir):
    """Approximate top 10 of every benchmark vector: each query gets ten, and at least nine of ten exact
    neighbours over all queries are among them (the recall floor)."""
    from ..operators.ivfpq import approx_knn
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = benchmark_queries(spark, sf_dir)
    found = approx_knn(e, q, k=10).select("query_id", "doc_id", F.lit(1).alias("hit"))
    exact = knn(e, q, k=10).select("query_id", "doc_id", F.lit(1).alias("near"))
    both = exact.join(found, ["query_id", "doc_id"], "full")
    per = both.groupBy("query_id").agg(F.count("hit").alias("n_found"), F.count("near").alias("n"), F.count(F.when(F.col("hit").isNotNull(), F.col("near"))).alias("k"))
    recall = per.agg((F.sum("k") / F.sum("n") >= 0.9).alias("recall_ok"))
    return attach_scalars(per, recall).select("query_id", "n_found", "recall_ok")


# --- D2 / E7: intent boosts ----------------------------------------------------------

_INTENT_QUERIES = ("SELECT b.item_id AS query_id, b.text AS query, e.embedding AS vector, "
                   "upper(d.source) AS intent_industry, upper(d.lang) AS intent_country "
                   "FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id "
                   "LEFT JOIN documents d ON d.doc_id = b.item_id")

D2_SQL = (HYBRID_CTES.replace(f"queries AS ({_QUERIES})", f"queries AS ({_INTENT_QUERIES})")
          .replace("knn_raw AS (", f"""{bm25_ctes('cty', 'SELECT * FROM corpus', 'doc_id', 'country')},
{qterms_cte('qi', "SELECT * FROM queries WHERE intent_industry IS NOT NULL AND intent_industry <> ''",
            'query_id', 'lower(intent_industry)')},
{qterms_cte('qc', "SELECT * FROM queries WHERE intent_country IS NOT NULL AND intent_country <> ''",
            'query_id', 'lower(intent_country)')},
{bm25_terms_cte('s_ii', 'ind', 'qi', 2.0)},
{bm25_terms_cte('s_ic', 'cty', 'qc', 2.0)},
knn_raw AS (""", 1)
          .replace("UNION ALL SELECT query_id, doc_id, score, NULL, score FROM knn",
                   "UNION ALL SELECT query_id, doc_id, score, NULL, score FROM knn "
                   "UNION ALL SELECT query_id, doc_id, score, NULL, NULL FROM s_ii "
                   "UNION ALL SELECT query_id, doc_id, score, NULL, NULL FROM s_ic")
          + D14_SQL[len(HYBRID_CTES):])


@register("d2_e7_intent_boosts", D2_SQL)
def d2_intent_boosts(spark, sf_dir):
    """Intent industry and country as soft x2 boosts (lower-cased) on top of the
    hybrid clauses; intents derived from the document with the query's id."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"),
                                                      F.upper("source").alias("intent_industry"),
                                                      F.upper("lang").alias("intent_country"))
    q = benchmark_queries(spark, sf_dir).join(d, "query_id", "left")
    return two_stage_retrieval(hybrid_index(spark, sf_dir), q)
