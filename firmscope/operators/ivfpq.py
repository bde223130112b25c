"""Approximate nearest neighbours by cosine: inverted cells with product-quantised codes.

A coarse quantiser (k-means of unit vectors) puts every vector into a cell; what is left of it after its
cell's centre is stored as one byte for each four dimensions (k-means of each piece). Both are trained on a
bounded sample; every row is indexed. A query reads its nearest cells only, scores their codes by table
lookups and keeps the best; those few are scored again with their whole vectors.

How many cells are read follows from a recall target, not from the size: neighbours of sampled rows are
looked for among the sample, and so many cells are taken that the target share of them is covered. In
vectors without any clusters that is a large part of the cells, in clustered ones a few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship_by_value
from ..session import materialize
from .knn import DIGITS, _blocks, _carried
from .sizing import bounded_broadcast

ship_by_value(__name__)

SAMPLE = 16_384  # rows the quantisers are trained on, the first ones in hash order
PIECE = 4  # dimensions of one code byte
MAX_CELLS = 4096
RERANK = 50  # candidates scored exactly, for each neighbour asked for
RECALL = 0.97  # share of sampled neighbours whose cells are read; quantisation takes a little more
BLOCK_QUERIES = 1024


@dataclass
class CellIndex:
    codes: DataFrame  # doc_id, cell, codes (one byte a piece); files go by cell
    corpus: DataFrame  # doc_id, vec
    centres: np.ndarray
    books: np.ndarray  # pieces x 256 x PIECE
    probes: int
    dim: int
    id_type: T.DataType


def unit_rows(lists: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the lists that have ``dim`` finite numbers, not all of them zero."""
    a = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.nan_to_num(a.value_lengths().to_numpy(zero_copy_only=False), nan=-1)
    at = np.flatnonzero(sizes == dim)
    x = a.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    fine = np.isfinite(x).all(axis=1)
    norms = np.linalg.norm(np.where(fine[:, None], x, 0.0), axis=1)
    fine &= norms > 0
    return at[fine], x[fine] / norms[fine][:, None]


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """``k`` centres (fewer if there are fewer rows); a centre left without rows moves to a random row."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.argmax(x[i:i + 8192] @ centres.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def _pieces(x: np.ndarray) -> np.ndarray:
    """Rows cut into pieces of ``PIECE`` dimensions, the last one filled up with zeros."""
    pad = -x.shape[1] % PIECE
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, PIECE)


def _cells_by_nearness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argsort(0.5 * (centres * centres).sum(axis=1) - x @ centres.T, axis=1, kind="stable")


def _probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Cells to read so that ``recall`` of the sample's nearest ``k`` of 256 of its rows are in them."""
    asked = x[:256]
    near = np.argsort(-(asked @ x.T), axis=1)[:, 1:k + 1]
    place = np.argsort(_cells_by_nearness(asked, centres), axis=1)
    needed = np.take_along_axis(place, nearest(x, centres)[near], axis=1)
    return int(np.quantile(needed, recall, method="higher")) + 1 if needed.size else 1


def build_cell_index(corpus: DataFrame, k: int = 10, cid: str = "doc_id", cvec: str = "embedding", recall: float = RECALL, seed: int = 7) -> CellIndex:
    """Trains on at most ``SAMPLE`` rows and codes every row. The index takes vectors of the length most common in the
    sample; others, and vectors with NULL, non-finite or only zero components, take no part, nor do NULL ids."""
    id_type = corpus.schema[cid].dataType
    rows = corpus.where(F.col(cid).isNotNull() & F.col(cvec).isNotNull()).select(F.col(cid).cast(_carried(id_type)).alias("doc_id"), F.col(cvec).alias("vec"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.col("vec").cast("array<double>").alias("vec")).toArrow()["vec"]
    sizes = sample.combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(sample) else np.zeros(0)
    dim = int(np.bincount(sizes.astype(int)).argmax()) if len(sizes) else 0
    rng = np.random.default_rng(seed)
    x = unit_rows(sample, dim)[1] if dim else np.zeros((0, 0))
    if not len(x):
        empty = rows.limit(0).select("doc_id", F.lit(0).alias("cell"), F.lit(None).cast("binary").alias("codes"))
        return CellIndex(empty, rows, np.zeros((0, dim)), np.zeros((0, 256, PIECE)), 0, dim, id_type)
    n_cells = max(1, min(MAX_CELLS, round(rows.count() ** 0.5), len(x) // 8))
    centres = k_means(x, n_cells, rng)
    left = _pieces(x - centres[nearest(x, centres)])
    books = np.stack([np.resize(k_means(left[:, m], 256, rng, 6), (256, PIECE)) for m in range(left.shape[1])])
    probes = _probes(x, centres, k, recall)
    model = rows.sparkSession.sparkContext.broadcast((centres, books))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cs, bs = model.value
        for b in batches:
            at, u = unit_rows(b.column("vec"), dim)
            cell = nearest(u, cs)
            pieces = _pieces(u - cs[cell]) if len(u) else np.zeros((0, len(bs), PIECE))
            codes = np.stack([nearest(pieces[:, m], bs[m]) for m in range(len(bs))], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())],
                                             ["doc_id", "cell", "codes"])

    coded = rows.mapInArrow(code, T.StructType([rows.schema["doc_id"], T.StructField("cell", T.IntegerType()), T.StructField("codes", T.BinaryType())]))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of (cell, hash): a large cell spans files, and files hold few cells
    codes = materialize(coded.repartitionByRange(parts, "cell", F.xxhash64("doc_id")).sortWithinPartitions("cell"), "cell-codes")
    return CellIndex(codes, rows, centres, books, probes, dim, id_type)


def _scored_cells(b: pa.RecordBatch, queries: np.ndarray, tables: np.ndarray, centres: np.ndarray, asked: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each cell of the batch: the queries that read it, the places of its rows, and the estimates."""
    cell = b.column("cell").to_numpy()
    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, -1)
    for c in np.unique(cell):
        who = asked[c]
        if len(who):
            at = np.flatnonzero(cell == c)
            estimate = np.repeat((queries[who] @ centres[c])[:, None], len(at), axis=1).astype(np.float32)
            for m in range(codes.shape[1]):
                estimate += tables[who, m][:, codes[at, m]]
            yield who, at, estimate


def _candidates(index: CellIndex, queries: np.ndarray, keep: int) -> DataFrame:
    """``(query, doc_id, estimate)``: the best ``keep`` codes of each query in every task."""
    near = _cells_by_nearness(queries, index.centres)[:, :index.probes]
    asked = [np.flatnonzero((near == c).any(axis=1)) for c in range(len(index.centres))]
    shared = index.codes.sparkSession.sparkContext.broadcast((queries, asked, index.centres, index.books))
    cells = [int(c) for c in np.unique(near)]
    codes = index.codes.where(F.col("cell").isin(cells)) if len(cells) <= 256 else index.codes
    id_kind = pa.int64() if isinstance(_carried(index.id_type), T.LongType) else pa.string()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, who_reads, centres, books = shared.value
        pieces = _pieces(qs)
        tables = np.einsum("qmd,mjd->qmj", pieces, books).astype(np.float32)
        scores: dict[int, list] = {}
        names: dict[int, list] = {}

        def trim(q: int) -> tuple[np.ndarray, pa.Array]:
            s, d = np.concatenate(scores[q]), pa.concat_arrays(names[q])
            if len(s) > keep:
                best = np.argpartition(-s, keep - 1)[:keep]
                s, d = s[best], d.take(pa.array(best))
            scores[q], names[q] = [s], [d]
            return s, d

        held: dict[int, int] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                for who, at, estimate in _scored_cells(b, qs, tables, centres, who_reads):
                    for r, q in enumerate(who):
                        e, places = estimate[r], at
                        if len(e) > keep:
                            best = np.argpartition(-e, keep - 1)[:keep]
                            e, places = e[best], at[best]
                        scores.setdefault(int(q), []).append(e)
                        names.setdefault(int(q), []).append(b.column("doc_id").take(pa.array(places)))
                        held[int(q)] = held.get(int(q), 0) + len(e)
                        if held[int(q)] > 4 * keep:
                            held[int(q)] = len(trim(int(q))[0])
        for q in scores:
            s, d = trim(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q), pa.int32()), d.cast(id_kind), pa.array(s.astype(np.float64))], ["query", "doc_id", "estimate"])

    found = codes.mapInArrow(search, T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", _carried(index.id_type)), T.StructField("estimate", T.DoubleType())]))
    w = Window.partitionBy("query").orderBy(F.desc("estimate"), F.asc("doc_id"))
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).select("query", "doc_id")


def approx_knn(corpus: DataFrame, queries: DataFrame, k: int = 10, cid: str = "doc_id", cvec: str = "embedding", qid: str = "query_id", qvec: str = "vector",
               index: CellIndex | None = None, recall: float = RECALL) -> DataFrame:
    """Approximate top ``k`` by cosine: ``(query_id, doc_id, sim, knn_rank)``, cosines exact and rounded to 9 places, ties
    to the smaller id. ``index``: one made before by ``build_cell_index``, else made here. Queries of another
    length than the index's, or without a direction, have no answer."""
    index = index or build_cell_index(corpus, k, cid, cvec, recall)
    q_type = queries.schema[qid].dataType
    spark = queries.sparkSession
    fine = (F.size(qvec) == index.dim) & F.forall(qvec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(qvec, lambda x: x != 0)
    asked = queries.where(F.col(qid).isNotNull() & fine).select(F.col(qid).cast(_carried(q_type)).alias("id"), F.col(qvec).alias("vec")).distinct()
    named = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("query_id", _carried(q_type))])
    out = None
    for ids, mat in (_blocks(asked, BLOCK_QUERIES) if index.probes else ()):
        unit = mat / np.linalg.norm(mat, axis=1)[:, None]
        scored = _exact(index, _candidates(index, unit, RERANK * k), unit)
        part = scored.join(F.broadcast(spark.createDataFrame([(i, q.item()) for i, q in enumerate(ids)], named)), "query").drop("query")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("doc_id", _carried(index.id_type)), T.StructField("sim", T.DoubleType()),
                                                      T.StructField("query_id", _carried(q_type))]))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("doc_id"))
    best = out.withColumn("knn_rank", F.row_number().over(w)).where(F.col("knn_rank") <= k)
    return best.select(F.col("query_id").cast(q_type).alias("query_id"), F.col("doc_id").cast(index.id_type).alias("doc_id"), "sim", "knn_rank")


def _exact(index: CellIndex, candidates: DataFrame, queries: np.ndarray) -> DataFrame:
    """``(query, doc_id, sim)`` of the candidates, from whole vectors."""
    shared = candidates.sparkSession.sparkContext.broadcast(queries)
    dim = index.dim

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, u = unit_rows(b.column("vec"), dim)
            q = b.column("query").to_numpy()[at]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), b.column("doc_id").take(pa.array(at)), pa.array(np.round(np.einsum("ij,ij->i", u, shared.value[q]), DIGITS))],
                                             ["query", "doc_id", "sim"])

    met = index.corpus.join(bounded_broadcast(candidates, 2_000_000), "doc_id").select("query", "doc_id", "vec")
    return met.mapInArrow(score, T.StructType([T.StructField("query", T.IntegerType()), index.corpus.schema["doc_id"], T.StructField("sim", T.DoubleType())]))
