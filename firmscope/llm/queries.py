"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path
from . import bpe, divergence, hardneg, kdtree, maintext, mixing, pii, quality, recompress, simhash, tokentree, toxicity, urllist
from .common import plain_id

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The vocabulary file of the registered queries: the installed public one."""
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op1_rows(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2_rows(_table(spark, sf_dir, "documents"))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.op3_rows(_table(spark, sf_dir, "documents"))


def op4_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.op4_rows(_table(spark, sf_dir, "embeddings"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urllist.op5_rows(_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(plain_id(out.did).alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9_rows(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokentree.op10_rows(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.op12_rows(_table(spark, sf_dir, "embeddings"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.op13_rows(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_pii, op2_simhash, op3_recompression, op4_kdtree_topk, op5_url_filters, op6_mixing,
                            op7_toxicity, op8_bpe, op9_quality, op10_token_counts, op11_divergence, op12_hard_negatives, op13_main_text, pipeline)}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op3_recompression": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM s),
o AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS m FROM k) WHERE m < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM o),
c AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []::BIGINT[]), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)""",
    "op4_kdtree_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op5_url_filters": urllist.OP5_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_hard_negatives": hardneg.OP12_SQL,
    "op9_quality": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n
      FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id)),
j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
        100 * n_symbols > {quality.MAX_SYMBOLS_PERCENT} * n_words OR 100 * n_dup_lines > {quality.MAX_DUP_LINES_PERCENT} * n_lines
        OR word_chars < {quality.WORD_LENGTH[0]} * n_words OR word_chars > {quality.WORD_LENGTH[1]} * n_words AS soft FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(CASE WHEN base_failed OR soft THEN 1 ELSE 0 END)::DOUBLE AS k FROM j GROUP BY source),
a AS (SELECT sum(k) / sum(n) AS mean, sum(n) AS al FROM h),
v AS (SELECT sum(n * pow(k / n - mean, 2) / al) AS var, any_value(mean) AS mean FROM h, a),
z AS (SELECT mean, least(1e6, greatest(1.0, coalesce(mean * (1 - mean) / nullif(var, 0) - 1, 1e6))) AS st FROM v),
o AS (SELECT source, (k + mean * st) / (n + st) AS rate FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= {quality.MAX_HOST_RATE} AS kept, round(rate, 9) AS host_rate
FROM j JOIN o ON j.source IS NOT DISTINCT FROM o.source""",
}
