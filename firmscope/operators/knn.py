"""Exact nearest-neighbour search over vector columns (approximate: ``ivfpq``).

Exact kNN is a scan of the corpus vectors. The queries (ids + vectors) are shipped to
every task as a broadcast numpy matrix whose size is checked (blocks of at most
``max_block_queries`` queries; a larger query table is processed block by block). Each
task scores its Arrow batches with one matrix product and keeps a running top-k per
query, so at most k rows per (query, task) are emitted; a final
``row_number() <= k`` per query (WindowGroupLimit) merges them. Work is
|corpus| x |queries| multiply-adds, as any exact search must do, but no pair table
is ever materialised.

Scores follow the engine convention for the two spaces the reference configures:
cosine → 1 / (2 − cos), squared L2 → 1 / (1 + d²). Cosine is rounded to 9 decimals
before ranking so ties break deterministically on the document id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship_by_value
from ..session import materialize
from .sizing import is_small

ship_by_value(__name__)

DIGITS = 9


def zero_vector_fallback(vec: str, dim: int):
    """A NULL/failed embedding becomes the zero vector of ``dim`` floats."""
    return F.coalesce(F.col(vec), F.array_repeat(F.lit(0.0).cast("float"), dim))


def _carried(t: T.DataType) -> T.DataType:
    """The type an id has inside a block: whole numbers as long, anything else as its text."""
    return T.LongType() if isinstance(t, T.IntegralType) else T.StringType()


def _id_array(values) -> np.ndarray:
    a = np.asarray(values)
    return a.astype(np.int64) if a.dtype.kind in "iu" else a.astype(str)


def _blocks(q: DataFrame, most: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries in blocks of at most ``most`` rows: a block that is larger is split by further bits
    of a hash, so no more than ``most + 1`` rows ever reach the driver at once. Rows are distinct, vectors
    have one length and no NULL."""
    rows = q.limit(most + 1).toArrow()
    if rows.num_rows > most:
        bits = max(1, math.ceil(math.log2(q.count() / (0.9 * most))))
        at = F.shiftrightunsigned(F.xxhash64(*q.columns), depth).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        for side in range(1 << bits):
            yield from _blocks(q.where(at == side), most, depth + bits)
    elif rows.num_rows:
        vectors = rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        yield _id_array(rows.column(0).to_numpy()), vectors.astype(np.float64).reshape(rows.num_rows, -1)


_MAX_CELLS = 2_000_000


def _scores(qm, x, did, metric):
    """The documents of a chunk that count, and their scores (queries x documents; larger: nearer)."""
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)
        ok = n > 0
        x, did, n = x[ok], did[ok], n[ok]
        return did, np.round((qm @ x.T) / n[None, :], DIGITS)
    # squared L2, negated
    d2 = (qm * qm).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * (qm @ x.T)
    return did, -np.round(np.maximum(d2, 0.0), DIGITS)


class _Best:
    """The running top ``k`` of some queries as rows (query, score, id). What reaches a query's k-th best score is set
    aside and merged when there is as much of it as of the best themselves."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[tuple] = []
        self.size, self.most = 0, 2 * queries * k

    def add(self, did: np.ndarray, sim: np.ndarray) -> None:
        if sim.shape[1] > self.k and np.isneginf(self.least).any():  # k of these documents reach their k-th best
            self.least = np.maximum(self.least, np.partition(sim, -self.k, axis=1)[:, -self.k])
        q, d = np.nonzero(sim >= self.least[:, None])
        if len(q):
            self.held.append((q, sim[q, d], did[d]))
            self.size += len(q)
        if self.size > self.most or np.isneginf(self.least).any():
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.held:
            return None
        q, s, i = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((i, -s, q))  # by query, then score descending, then id
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, np.arange(len(self.least)))
        rank = np.arange(len(q)) - first[q]
        last = rank == self.k - 1
        self.least[q[last]] = s[last]
        keep = rank < self.k
        self.held = [(q[keep], s[keep], i[keep])]
        self.size = int(keep.sum())
        return self.held[0]


def _block_scores(corpus: DataFrame, ids: np.ndarray, mat: np.ndarray, k: int, cid: str, cvec: str,
                  metric: str) -> DataFrame:
    spark = corpus.sparkSession
    if metric == "cosine":
        norms = np.linalg.norm(mat, axis=1)
        keep = norms > 0  # zero query vector: no kNN contribution (D9)
        ids, mat = ids[keep], mat[keep] / norms[keep][:, None]
    bc, dim = spark.sparkContext.broadcast((ids, mat)), mat.shape[1]
    doc_type = _carried(corpus.schema[cid].dataType)
    out_schema = T.StructType([T.StructField("query_id", T.LongType() if ids.dtype.kind == "i" else T.StringType()),
                               T.StructField("doc_id", doc_type),
                               T.StructField("sim", T.DoubleType()), T.StructField("knn_score", T.DoubleType())])

    def score_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qm = bc.value
        best = _Best(len(qids), k)
        for pdf in batches:
            pdf = pdf[pdf[cvec].notna()]
            if len(pdf) == 0 or len(qids) == 0:
                continue
            pdf = pdf[[len(v) == dim for v in pdf[cvec]]]
            xall = np.array([np.asarray(v, dtype=np.float64) for v in pdf[cvec]]).reshape(len(pdf), dim)
            fine = np.isfinite(xall).all(axis=1)  # NULL components are not finite here
            xall, dall = xall[fine], _id_array(pdf[cid].to_numpy()[fine])
            step = max(1, _MAX_CELLS // max(1, len(qids)))  # bounds the queries x rows matrix
            for lo in range(0, len(dall), step):
                best.add(*_scores(qm, xall[lo:lo + step], dall[lo:lo + step], metric))
        found = best.merge()
        if found is not None:
            q, s, ids_found = found
            score = 1.0 / (2.0 - s) if metric == "cosine" else 1.0 / (1.0 - s)
            yield pd.DataFrame({"query_id": qids[q], "doc_id": ids_found, "sim": s if metric == "cosine" else -s, "knn_score": score})

    return corpus.where(F.col(cid).isNotNull()).select(F.col(cid).cast(doc_type).alias(cid), cvec).mapInPandas(score_partition, out_schema)


def knn(corpus: DataFrame, queries: DataFrame, k: int = 100, cid: str = "doc_id", cvec: str = "embedding",
        qid: str = "query_id", qvec: str = "vector", metric: str = "cosine",
        max_block_queries: int = 4096) -> DataFrame:
    """Exact top-k neighbours of every query vector.

    Returns (query_id, doc_id, sim, knn_score, knn_rank); ``sim`` is the cosine (or
    squared L2 distance), rounded to 9 decimals. Ids keep their types; whole numbers break
    ties as numbers, all others as text. Rows with a NULL id or vector take no part, nor do vectors with NULL or
    non-finite components; a query meets vectors of its own length. ``corpus`` may be pre-filtered (C12):
    filters on it are pushed into its scan by Catalyst.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric must be 'cosine' or 'l2'")
    q_type, d_type = queries.schema[qid].dataType, corpus.schema[cid].dataType
    asked = (queries.select(F.col(qid).cast(_carried(q_type)).alias("id"), F.col(qvec).alias("vec"))
             .where("id is not null and size(vec) > 0").where(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))).distinct())
    if not is_small(asked, max_block_queries):
        asked = materialize(asked, "knn-queries")  # each block reads it
    lengths = [r[0] for r in asked.select(F.size("vec")).distinct().limit(1000).collect()]
    parts = [_block_scores(corpus, ids, mat, k, cid, cvec, metric) for n in sorted(lengths)
             for ids, mat in _blocks(asked.where(F.size("vec") == n), max_block_queries)]
    if not parts:
        empty = T.StructType([T.StructField("query_id", q_type), T.StructField("doc_id", d_type), T.StructField("sim", T.DoubleType()),
                              T.StructField("knn_score", T.DoubleType()), T.StructField("knn_rank", T.IntegerType())])
        return corpus.sparkSession.createDataFrame([], empty)
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    scored = scored.withColumns({"query_id": F.col("query_id").cast(q_type), "doc_id": F.col("doc_id").cast(d_type)})
    order = F.col("sim").desc() if metric == "cosine" else F.col("sim").asc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("doc_id").asc())
    return scored.withColumn("knn_rank", F.row_number().over(w)).where(F.col("knn_rank") <= k)
