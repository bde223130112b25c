"""Hard negatives for each anchor and positive, by angular triangle filtering.

A vector stores its norm and its angles to some reference directions. By the triangle inequality for angles,
the angle between two vectors is at least the largest difference of their stored angles, and at most the
smallest sum (a sum beyond pi turns back). The cosines of these two, times the norms, widened for rounding,
bound the inner product. A window of scores is searched for negatives; only rows whose bounds overlap a
window that is still open get their product, in whole numbers.

Rows are dealt to shards by a hash and anchors to blocks; one group is one block of anchors in one shard.
Shards are searched in rounds (1, then 16, 256, ...); the last score kept so far closes windows from below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value
from ..session import materialize
from .kdtree import whole_numbers

ship_by_value(__name__)

SHARD, BLOCK, GROWTH = 8192, 2048, 16
#: Reference directions are chosen from at most so many rows, the first ones in hash order.
REFERENCES, SAMPLE = 16, 2048
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
POSITIVES, NEGATIVES, LEAST_PERCENT, MOST_PERCENT = 5, 10, 30, 90
_NO_ID = int(np.iinfo(np.int64).max)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1) if rows else np.zeros((0, 0))


def spread_directions(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` unit vectors among the rows of ``sample``, each as far in angle from those before as can be."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0][:, None]
    chosen: list[np.ndarray] = []
    nearest = np.full(len(units), -1.0)
    for _ in range(min(n, len(units))):
        at = int(np.argmin(nearest)) if chosen else 0
        if chosen and nearest[at] > 1 - 1e-9:
            break
        chosen.append(units[at])
        nearest = np.maximum(nearest, units @ units[at])
    return np.array(chosen).reshape(len(chosen), sample.shape[1])


def reference_directions(vectors: DataFrame, n: int = REFERENCES, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Directions for each vector length in a sample of ``sample`` rows. They steer how much is pruned, never what
    is found: a length without directions has bounds from norms alone."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("v").collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    return {d: spread_directions(np.array(v, dtype=float), n) for d, v in by_size.items()}


def with_angles(vectors: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """``vectors(vec_id, label, v, dim)`` with ``norm`` and ``angles`` to the directions of its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norms, angles = np.zeros(b.num_rows), [np.zeros(0)] * b.num_rows
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix(b.column("v").take(pa.array(at)), len(at))
                norms[at] = n = np.linalg.norm(x, axis=1)
                refs = directions.get(int(d), np.zeros((0, int(d))))
                cosines = (x @ refs.T) / np.where(n > 0, n, 1.0)[:, None]
                for i, a in zip(at, np.arccos(np.clip(cosines, -1.0, 1.0))):
                    angles[i] = a
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norms), pa.array(angles, pa.list_(pa.float64()))], [*b.schema.names, "norm", "angles"])

    return vectors.select("vec_id", "label", "v", "dim").mapInArrow(run, "vec_id long, label int, v array<double>, dim int, norm double, angles array<double>")


class Rows:
    """Rows of one shard and length: whole-number vectors, labels, norms and angles."""

    def __init__(self, t: pa.Table):
        n = t.num_rows
        self.ids = np.array([_NO_ID if i is None else i for i in t["vec_id"].to_pylist()], np.int64)
        self.labels = t["label"].to_numpy()
        self.vectors = _matrix(t["v"], n)
        self.norms = t["norm"].to_numpy()
        self.angles = np.ascontiguousarray(_matrix(t["angles"], n).T)
        self.largest = np.abs(self.vectors).max(initial=0)
        #: A stored cosine is off by less than ``(dim + 8) * 2**-50``, its angle by four times the root of that.
        self.slack = 8 * np.sqrt((self.vectors.shape[1] + 8) * 2.0 ** -50)

    def bounds(self, some: np.ndarray, norm: float, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest inner products that rows ``some`` can have with a vector, never too tight."""
        mine, size = self.angles[:, some], norm * self.norms[some]
        if len(mine):
            apart = np.abs(mine - angles[:, None]).max(axis=0)
            both = mine + angles[:, None]
            along = np.minimum(both, 2 * np.pi - both).min(axis=0)
        else:
            apart, along = np.zeros(len(some)), np.full(len(some), np.pi)
        least, most = np.minimum(along + self.slack, np.pi), np.maximum(apart - self.slack, 0.0)
        spare = 1.0 + 1e-9 * size
        return size * np.cos(least) - spare, size * np.cos(most) + spare

    def scores(self, some: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Inner products of rows ``some`` in whole numbers: longs, or objects where a long may not do."""
        if self.largest * np.abs(vector).max(initial=0) * max(1, len(vector)) < EXACT:
            return (self.vectors[some] @ vector).astype(np.int64)
        w = [int(x) for x in vector]
        return np.array([sum(a * int(b) for a, b in zip(w, self.vectors[i])) for i in some], dtype=object)

    def best(self, some: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` highest, ties to the smaller id."""
        if scores.dtype == object:
            order = np.array(sorted(range(len(some)), key=lambda i: (-scores[i], self.ids[some[i]]))[:k], np.int64)
        else:
            order = np.lexsort((self.ids[some], -scores))[:k]
        return some[order], scores[order]


def first_positives(rows: Rows, anchor: dict, k: int) -> list[tuple[int, int]]:
    """``(id, score)`` of the ``k`` best rows of the anchor's label, of at least its floor."""
    some = np.flatnonzero((rows.labels == anchor["label"]) & (rows.ids != anchor["own"]))
    if not len(some):
        return []
    vector, floor = np.array(anchor["v"], dtype=float), anchor["floor"]
    _, most = rows.bounds(some, anchor["norm"], np.array(anchor["angles"]))
    hopeful = some[np.argpartition(-most, k - 1)[:k]] if len(some) > k else some
    found = rows.scores(hopeful, vector)
    if len(found) == k:
        floor = max(int(found.min()), floor) if floor is not None else int(found.min())
    if floor is not None:
        some = some[most >= float(floor)]
    scores = rows.scores(some, vector)
    some, scores = rows.best(some, scores, k)
    return [(int(rows.ids[r]), int(s)) for r, s in zip(some, scores)]


def window_negatives(rows: Rows, anchor: dict, k: int, least: int, most: int) -> list[tuple[int, int, int]]:
    """``(window, id, score)``: for each window of the anchor the ``k`` best rows of another label in it."""
    windows = [w for w in anchor["windows"] if w["score"] >= 0]
    others = np.flatnonzero(rows.labels != anchor["label"])
    others = others[rows.ids[others] != anchor["own"]]
    if not windows or not len(others):
        return []
    low, high = rows.bounds(others, anchor["norm"], np.array(anchor["angles"]))
    overlap = np.zeros(len(others), bool)
    for w in windows:
        start = max(w["score"] * least / 100, float(w["floor"]) if w["floor"] is not None else 0.0)
        overlap |= (high >= start * (1 - 1e-12)) & (low <= w["score"] * most / 100 * (1 + 1e-12))
    some = others[overlap]
    scores = rows.scores(some, np.array(anchor["v"], dtype=float))
    out = []
    for w in windows:
        inside = (100 * scores >= least * w["score"]) & (100 * scores <= most * w["score"])
        if w["floor"] is not None:
            inside &= scores >= w["floor"]
        inside = inside.astype(bool)
        got, s = rows.best(some[inside], scores[inside], k)
        out += [(w["pos"], int(rows.ids[r]), int(x)) for r, x in zip(got, s)]
    return out


def _long(x: int) -> int:
    """Scores outside the range of a long are put at its ends."""
    return max(-(1 << 63), min(_NO_ID, x))


def _searched(rows: DataFrame, asked: DataFrame, done: int, upto: int, blocks: int, find: Callable, out: str) -> DataFrame:
    """``find(Rows, anchor)`` for every anchor in the shards from ``done`` to before ``upto``."""
    left = rows.where(F.col("shard").between(done, upto - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(upto - 1))))
    names = [c.split()[0] for c in out.split(", ")]

    def search(shard: pa.Table, anchors: pa.Table) -> pa.Table:
        found = []
        if shard.num_rows:
            here = Rows(shard)
            for a in anchors.to_pylist():
                found += [(a["own"], a["qid"], *[_long(x) for x in f]) for f in find(here, a)]
        cols = list(zip(*found)) if found else [[]] * len(names)
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=names)

    return left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInArrow(search, out)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_PERCENT,
         most: int = MOST_PERCENT) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` and ``anchors``: ``vec_id long, label int, v array<double>`` of whole numbers, none of them null but
    ids of ``vectors``. An anchor's positives are the first ``positives`` rows of its label; for each, the
    negatives are the first ``negatives`` rows of another label that score from ``least`` to ``most`` percent of
    the positive (none where that is below zero). Higher scores come first, ties by smaller id, a null id last.

    Rows with the anchor's id are never its candidates, nor are vectors of another length. Repeated rows of
    another id each count; a repeated anchor is answered once. Scores beyond a long's range stand at its ends,
    a positive's before its window is taken. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.col("label").cast("int").alias("label"), "v", F.size("v").alias("dim"))
    directions = reference_directions(v)
    rows = with_angles(v, directions)
    rows = materialize(rows.withColumn("hash", F.xxhash64("vec_id", "v")), "hardneg-angles")
    shards = max(1, -(-rows.count() // SHARD))
    rows = rows.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int")).drop("hash")
    a = anchors.select("vec_id", F.col("label").cast("int").alias("label"), "v", F.size("v").alias("dim")).distinct()
    a = with_angles(a, directions).withColumnRenamed("vec_id", "own").withColumn("qid", F.xxhash64("own", "label", "v"))
    a = materialize(a, "hardneg-anchors")
    blocks = max(1, -(-a.count() // BLOCK))
    a = a.withColumn("block", F.pmod("qid", F.lit(blocks)).cast("int"))

    best = spark.createDataFrame([], "own long, qid long, vec_id long, score long")
    ranked = Window.partitionBy("own", "qid").orderBy(F.desc("score"), F.asc("vec_id"))
    done, step = 0, 1
    while done < shards:
        upto = min(shards, done + step)
        floors = best.groupBy("own", "qid").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= positives).drop("n")
        found = _searched(rows, a.join(floors, ["own", "qid"], "left"), done, upto, blocks, lambda r, x: first_positives(r, x, positives),
                          "own long, qid long, vec_id long, score long")
        best = best.union(found).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= positives).drop("rank")
        best = materialize(best, "hardneg-positives")
        done, step = upto, step * GROWTH
    windows = materialize(best.select("own", "qid", F.row_number().over(ranked).cast("long").alias("pos"), F.col("vec_id").alias("positive_id"),
                                      F.col("score").alias("positive_score")), "hardneg-windows")

    best = spark.createDataFrame([], "own long, qid long, pos long, vec_id long, score long")
    ranked = Window.partitionBy("own", "qid", "pos").orderBy(F.desc("score"), F.asc("vec_id"))
    done, step = 0, 1
    while done < shards:
        upto = min(shards, done + step)
        floors = best.groupBy("own", "qid", "pos").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= negatives).drop("n")
        open_windows = (windows.join(floors, ["own", "qid", "pos"], "left").groupBy("own", "qid")
                        .agg(F.collect_list(F.struct("pos", F.col("positive_score").alias("score"), "floor")).alias("windows")))
        found = _searched(rows, a.join(open_windows, ["own", "qid"]), done, upto, blocks, lambda r, x: window_negatives(r, x, negatives, least, most),
                          "own long, qid long, pos long, vec_id long, score long")
        best = best.union(found).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
        best = materialize(best.drop("rank"), "hardneg-negatives")
        done, step = upto, step * GROWTH
    out = best.withColumn("rank", F.row_number().over(ranked)).join(windows, ["own", "qid", "pos"])

    def known(c: str):
        return F.when(F.col(c) != _NO_ID, F.col(c))

    return out.select(F.col("own").alias("anchor_id"), known("positive_id").alias("positive_id"), "rank", known("vec_id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


def op12_rows(embeddings: DataFrame) -> DataFrame:
    """``mine`` over ``embeddings(vec_id, embedding, label)``: whole numbers from components, labels moved on by one for
    ids divisible by 7, ids divisible by 100 as anchors. Null labels, and vectors null, empty or holding a null or
    non-finite component, take no part."""
    labelled = embeddings.where(F.col("label").isNotNull()).select("vec_id", "embedding", F.col("label").cast("int").alias("label"))
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = whole_numbers(labelled.withColumn("label", moved), "label")
    return mine(v, v.where(F.col("vec_id") % 100 == 0))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
