"""Exact top-k by inner product with one KD-tree for each shard.

Vectors are dealt to shards of about ``SHARD`` rows by a hash. In a shard, median splits along the
widest dimension give a tree whose nodes keep the tight box of their vectors. A query walks the tree
best first: the inner product with a box is at most ``sum(max(q * low, q * high))``, and a node whose
bound is below the query's k-th score so far is left out with all below it. That k-th score is
propagated: shards are searched in rounds (1, then 16, 256, ...), and each round starts from the
scores that the rounds before have found.

Queries meet shards in blocks: the search of a block of ``BLOCK`` queries in one shard is one group,
of bounded size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value
from ..session import materialize

SHARD, BLOCK, LEAF, GROWTH = 4096, 4096, 64, 16
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
ship_by_value(__name__)


class KDTree:
    """Boxes and leaves over the rows of ``vectors`` (whole numbers as doubles)."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors = vectors
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray | None] = []
        low, high = [], []
        todo = [(np.arange(len(vectors)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.rows)
            if parent >= 0:
                pair = self.children[parent]
                self.children[parent] = (me, pair[1]) if side == 0 else (pair[0], me)
            box = vectors[rows]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            wide = int(np.argmax(high[-1] - low[-1])) if vectors.shape[1] else 0
            if len(rows) <= leaf or not vectors.shape[1] or high[-1][wide] == low[-1][wide]:
                self.children.append(None)
                self.rows.append(rows)
                continue
            half = len(rows) // 2
            order = rows[np.argpartition(box[:, wide], half)]
            self.children.append((-1, -1))
            self.rows.append(None)
            todo += [(order[:half], me, 0), (order[half:], me, 1)]
        self.low, self.high = np.array(low), np.array(high)

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The ``k`` best ``(score, row)`` of rows not marked ``own``, of at least ``floor``; ties to the smaller id."""
        bound = np.maximum(q * self.low, q * self.high).sum(axis=1)
        heap = [(-bound[0], 0)]
        scores, rows, least = np.zeros(0), np.zeros(0, np.int64), floor
        while heap:
            b, node = heapq.heappop(heap)
            if -b < least:
                break
            pair = self.children[node]
            if pair:
                for c in pair:
                    if bound[c] >= least:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            new = self.rows[node]
            s = self.vectors[new] @ q
            good = (s >= least) & ~own[new]
            if good.any():
                scores, rows = np.concatenate((scores, s[good])), np.concatenate((rows, new[good]))
                best = np.lexsort((ids[rows], -scores))[:k]
                scores, rows = scores[best], rows[best]
                if len(rows) == k:
                    least = max(least, scores[-1])
        return list(zip(scores.tolist(), rows.tolist()))


def _search_group(shard: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    names = ["qid", "vec_id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64()]
    if not shard.num_rows or not queries.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names=names)
    vectors = np.array(shard["v"].to_pylist(), dtype=float).reshape(shard.num_rows, -1)
    ids = np.array([i if i is not None else np.iinfo(np.int64).max for i in shard["vec_id"].to_pylist()], np.int64)
    asked = np.array(queries["v"].to_pylist(), dtype=float).reshape(queries.num_rows, -1)
    width = max(1, vectors.shape[1])
    if np.abs(vectors).max(initial=0) * np.abs(asked).max(initial=0) * width >= EXACT:
        found = _by_whole_numbers(shard, queries, ids, k)
    else:
        tree = KDTree(vectors)
        floors = [-np.inf if f is None else float(f) for f in queries["floor"].to_pylist()]
        found = [(q, int(ids[r]), int(s)) for q, vec, v, f in zip(queries["qid"].to_pylist(), queries["own"].to_pylist(), asked, floors)
                 for s, r in tree.search(v, ids == vec, ids, k, f)]
    cols = list(zip(*found)) if found else [[], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def _by_whole_numbers(shard: pa.Table, queries: pa.Table, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """For components so large that doubles would round: whole numbers of any size, all rows of the shard;
    scores outside the range of a long are put at its ends."""
    rows = [[int(x) for x in v] for v in shard["v"].to_pylist()]
    out = []
    for q, vec, v in zip(queries["qid"].to_pylist(), queries["own"].to_pylist(), queries["v"].to_pylist()):
        w = [int(x) for x in v]
        scored = sorted((-min(2**63 - 1, max(-2**63, sum(a * b for a, b in zip(w, r)))), int(i)) for r, i in zip(rows, ids) if i != vec)
        out += [(q, i, -s) for s, i in scored[:k]]
    return out


def top_k(vectors: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``vectors(vec_id, v array<double>)`` with the
    highest inner products for each row of ``asked(vec_id, v)``, ties to the smaller id.

    Rows with the query's own id are left out; vectors of another length than the query's are no
    candidates. Repeated rows of another id each count; a query asked twice is answered once (two
    vectors under one id are two queries). A null id comes last among ties. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    v = vectors.select("vec_id", "v", F.size("v").alias("dim"))
    total = v.count()
    shards = max(1, -(-total // SHARD))
    dealt = materialize(v.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")), "kd-shards")
    q = asked.select(F.col("vec_id").alias("own"), "v", F.size("v").alias("dim")).distinct()
    q = materialize(q.withColumn("qid", F.xxhash64("own", "v")), "kd-queries")
    blocks = max(1, -(-q.count() // BLOCK))
    q = q.withColumn("block", F.pmod("qid", F.lit(blocks)).cast("int"))

    def search(shard, queries):
        return _search_group(shard, queries, k)

    best = spark.createDataFrame([], "qid long, vec_id long, score long")
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("vec_id"))
    done, step = 0, 1
    while done < shards:
        upto = min(shards, done + step)
        floors = best.groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("qid", F.col("least").alias("floor"))
        left = dealt.where(F.col("shard").between(done, upto - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = q.join(floors, "qid", "left").withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(upto - 1))))
        found = (left.select("dim", "shard", "block", "vec_id", "v").groupBy("dim", "shard", "block")
                 .cogroup(right.select("dim", "shard", "block", "qid", "own", "v", "floor").groupBy("dim", "shard", "block"))
                 .applyInArrow(search, "qid long, vec_id long, score long"))
        best = materialize(best.union(found).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank"), "kd-best")
        done, step = upto, step * GROWTH
    answers = best.withColumn("rank", F.row_number().over(ranked)).join(q.select("qid", F.col("own").alias("query_id")), "qid")
    missing = F.lit(int(np.iinfo(np.int64).max))
    return answers.select("query_id", "rank", F.when(F.col("vec_id") != missing, F.col("vec_id")).alias("vec_id"), "score")


def whole_numbers(embeddings: DataFrame, *also: str) -> DataFrame:
    """``(vec_id, v)``, and the columns ``also``, with ``floor(256 * x)`` for each component; vectors null, empty, or
    holding a null or non-finite component are left out."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    def floored(c):
        y = F.lit(256.0) * c.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    v = F.transform(x, floored)
    return embeddings.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *also)


def op4_rows(embeddings: DataFrame, k: int = 5) -> DataFrame:
    v = whole_numbers(embeddings)
    return top_k(v, v.where(F.col("vec_id") % 50 == 0), k)
