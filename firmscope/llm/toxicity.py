"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores ``p = sigmoid(bias + sum of the weights of
the features of its distinct words)``, a word's features being itself and its pieces of 4 and 5
letters; the document scores the noisy-or ``1 - prod(1 - p)``. Weights are trained
from document labels alone (gradients through the noisy-or), and then the sentence scores say
where the offence is.

Training takes a sample of labelled documents of bounded size (``MAX_DOCS`` of each label and
``MAX_CHARS`` characters in all, whole documents in hash order), so it costs the same at any
corpus size. Its features are counted and screened in tasks; the driver sees the features kept and
where they occur. Scoring covers every row in Arrow batches; the model (words with their weights) is
bounded by the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value
from ..session import materialize
from .common import Memo, id_and_text, plain_id

#: Bounds of the training sample: documents of each label, and characters of all their texts.
MAX_DOCS, MAX_CHARS = 3000, 24_000_000
#: A feature is kept if so many toxic documents of the sample have it (a third of them if that is less),
#: and it stands out by so many standard errors.
MIN_DOCS, MIN_Z = 10, 5.0
#: Tasks over the sample.
TASKS = 12
HELD_OUT = 2
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
ship_by_value(__name__)


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """``(start, end, distinct words)`` of each sentence with a word; offsets in code points."""
    out = []
    for m in SENTENCE.finditer(text):
        words = sorted(set(WORD.findall(m.group().lower())))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(did, text, y)`` to learn from, never of a held-out id (crc32 of the id's text, mod 4, is 2).
    Rows with a null id, text or label are left out; an id labelled twice counts as toxic if once so."""
    known = (labels.where("doc_id is not null and toxic is not null")
             .where(F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT)
             .groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.max(F.col("toxic").cast("int")).alias("y")))
    sized = (docs.where("doc_id is not null and text is not null")
             .groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.max(F.length("text")).alias("n")))
    known = materialize(known.join(sized, "did"), "labelled")
    chosen: list[tuple[int, int]] = []
    for y in (0, 1):
        room = MAX_CHARS // 2
        for r in known.where(F.col("y") == y).orderBy(F.xxhash64("did"), "did").limit(MAX_DOCS).collect():
            if r["n"] <= room:
                chosen.append((r["did"], y))
                room -= r["n"]
    ids = docs.sparkSession.createDataFrame(chosen, "did long, y int")  # at most 2 * MAX_DOCS rows
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("did"), "text").join(F.broadcast(ids), "did")
    return materialize(rows.repartition(TASKS, "did", "text"), "toxicity-sample")


def features(word: str) -> list[str]:
    """The word between marks, and its pieces of 4 and 5 letters (marks included)."""
    w = f"^{word}$"
    return sorted({w, *(w[i:i + k] for k in (4, 5) for i in range(len(w) - k + 1))})


def screened(sample: DataFrame, n_toxic: int, n_other: int) -> dict[str, int]:
    """The features that go with the label: by how many standard errors their share among toxic
    documents exceeds that among the others (MIN_Z at least, and MIN_DOCS toxic documents, or a third of a small
    sample's). In a sample of fewer than MIN_Z ** 2 documents no feature stands out so far: none is kept."""
    least = min(MIN_DOCS, -(-n_toxic // 3))
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Memo(features)
        seen = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                seen[y].update(set(chain.from_iterable(map(parts.__getitem__, set(WORD.findall(text.lower()))))))
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([seen[y][f] for f in names], pa.int64()) for y in (1, 0)]],
                                         ["feature", "k1", "k0"])

    found = sample.select("text", "y").mapInArrow(count, "feature string, k1 long, k0 long")
    found = found.groupBy("feature").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0")).where(F.col("k1") >= least)
    share = (F.col("k1") + F.col("k0")) / (n_toxic + n_other)
    excess = F.col("k1") / n_toxic - F.col("k0") / n_other
    error = F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_other))
    kept = found.where((excess > 0) & (excess >= MIN_Z * error)).select("feature").collect()
    return {f: i for i, f in enumerate(sorted(r["feature"] for r in kept))}


def bags(sample: DataFrame, index: dict[str, int]) -> list:
    """For each sampled document: label, number of sentences, and its (sentence, feature) pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Memo(lambda w: tuple(index[f] for f in features(w) if f in index))
        for b in batches:
            sizes, rows = [], []
            for text in b.column("text").to_pylist():
                found = sentences(text)
                pairs = [(i, f) for i, (_, _, words) in enumerate(found) for f in chain.from_iterable(map(hits.__getitem__, words))]
                sizes.append(len(found))
                rows.append(np.array(pairs, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("y"), pa.array(sizes, pa.int32()), pa.array(rows, pa.binary())],
                                             ["did", "y", "n", "pairs"])

    return sorted(sample.mapInArrow(run, "did long, y int, n int, pairs binary").collect())


def fit(sample: DataFrame, steps: int = 300, decay: float = 5e-5) -> dict:
    """Weights by Adam on the mean log loss of the noisy-or, plus ``decay`` times the squared weights.
    Without examples of both labels the model is a constant: the share of toxic ones."""
    counts = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_other = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_other:
        return {"weights": {}, "bias": None, "rate": 1.0 if n_toxic else 0.0}
    index = screened(sample, n_toxic, n_other)
    rows = bags(sample, index)
    y = np.array([r["y"] for r in rows], float)
    sizes = np.array([r["n"] for r in rows], np.int64)
    d = np.repeat(np.arange(len(rows)), sizes)  # the document of each sentence
    pairs = [np.frombuffer(r["pairs"], np.int32).reshape(-1, 2) for r in rows]
    base = np.cumsum(sizes) - sizes
    s = np.concatenate([p[:, 0] + b for p, b in zip(pairs, base)])
    i = np.concatenate([p[:, 1] for p in pairs])
    params = np.zeros(len(index) + 1)
    params[-1] = -6.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        z = params[-1] + np.bincount(s, weights=params[i], minlength=len(d))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(d, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        bag = np.clip(1 - np.exp(log_clean), 1e-9, 1)
        slope = np.where(y > 0, -(1 - bag) / bag, 1.0)  # of the loss by each of the bag's z, over p
        dz = slope[d] * p / len(y)
        grad = np.concatenate((np.bincount(i, weights=dz[s], minlength=len(index)), [dz.sum()]))
        grad[:-1] += 2 * decay * params[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return {"weights": {f: float(params[j]) for f, j in index.items()}, "bias": float(params[-1]), "rate": n_toxic / (n_toxic + n_other)}


class Scorer:
    """Scores texts with a fitted model."""

    def __init__(self, model: dict):
        self.model, self.bias, self.rate = model, model["bias"], model["rate"]
        weights = model["weights"]
        self.weight = Memo(lambda w: sum(weights[f] for f in features(w) if f in weights))

    def _sentence(self, line: str) -> float:
        words = set(WORD.findall(line.lower()))
        if not words:
            return 0.0
        z = self.bias + sum(sorted(map(self.weight.__getitem__, words)))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

    def score(self, text: str, offending: float = 0.5) -> tuple[float, str]:
        """The document's score, and the spans (``start:end``) of sentences scoring ``offending`` or more."""
        if self.bias is None:
            return self.rate, ""
        clean, spans = 1.0, []
        for m in SENTENCE.finditer(text):
            p = self._sentence(m.group())
            if p:
                clean *= 1 - p
                if p >= offending:
                    spans.append(f"{m.start()}:{m.end()}")
        return 1 - clean, ",".join(spans)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(did, score, offending)`` for every row. Null and empty texts have no sentence and score 0
    (or the constant of a model without both labels). An empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in batches:
            found = [scorer.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), pa.array([s for s, _ in found], pa.float64()), pa.array([o for _, o in found], pa.string())],
                ["did", "score", "offending"])

    return id_and_text(docs).mapInArrow(run, "did long, score double, offending string")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay as they are.
    The text is scored where the row is: no join, no shuffle, and repeated rows are judged alike."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in batches:
            stay = [scorer.score(t or "")[0] < threshold for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    out = score_documents(docs, labels)
    doc_id = plain_id(F.col("did"))
    return out.select(doc_id.alias("doc_id"),
                      F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
