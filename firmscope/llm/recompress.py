"""Substring dedup by recompression.

Each document is a string of words. Rounds replace runs of an equal symbol and pairs of
symbols by new symbols. A new symbol's name is a hash of what it replaces, so it is the same
in every document and no round needs a table of names; which pairs merge depends on the two
names alone (a name is a left or a right one in each round, and a left one merges with a right
one behind it) and only symbols of few words merge. So whether a symbol ends at a place is
decided by the ``MARGIN`` words on either side of it, and equal passages are parsed alike but
for their margins.

Every window of 50 words hence holds whole symbols that all its occurrences have at the same
offset. The window is represented by the one whose *anchor* (the symbol with its margins: the
words that fix it) has the least hash; consecutive windows mostly share a representative, so
one row for every 15 to 20 words leaves a document:

    anchor, hash of the words that its windows span (the context), document, first and last window

1. Anchors found in one document only are dropped: their windows occur nowhere else.
2. Equal anchor and context: all windows are equal; the smallest document has them first, the
   rest lose all words that the windows span.
3. An anchor with several contexts: the smallest document of each context goes back to its text
   and names each of the anchor's windows by a hash; windows met in a smaller document go.

Anchor, context and window are 64-bit hashes of unlike kind, always compared in pairs (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value
from ..session import materialize
from .common import WordHash, id_and_text, mixed, plain_id, raw_texts

#: Round 0 names runs of up to RUN words; each further round names pairs of symbols of up to so many words.
RUN, PAIR_ROUNDS = 2, (1, 1, 2, 2)
MARGIN = RUN + sum(PAIR_ROUNDS)
LONGEST = max(RUN, 2 * max(PAIR_ROUNDS))
#: Words parsed together (a longer document is parsed by itself).
CHUNK = 200_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PRIME = np.uint64(0xFF51AFD7ED558CCD)
ship_by_value(__name__)


class Parsed:
    """Documents parsed together: word hashes, and the symbols that the rounds leave."""

    def __init__(self, words: list[list[bytes]], memo: WordHash):
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.hashes = np.concatenate([memo.of(w) for w in words]) if words else np.zeros(0, np.uint64)
        n = len(self.hashes)
        power = np.full(n + 1, _BASE, np.uint64)
        back = np.full(n + 1, _BACK, np.uint64)
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power)
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * power[:n], dtype=np.uint64)))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words ``start:end``."""
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths, in words, of the symbols after all rounds."""
        name, start = self.hashes.copy(), np.arange(len(self.hashes))
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        length = np.ones(len(name), np.int64)
        if len(name) == 0:
            return start, length
        # runs
        begins = np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])))
        at = np.flatnonzero(begins)
        k = np.diff(np.concatenate((at, [len(name)])))
        own = np.repeat(k, k)
        keep = begins | (own > RUN)
        length = np.where(begins & (own <= RUN), own, 1)[keep]
        name = np.where(own <= RUN, mixed(name + own.astype(np.uint64) * _PRIME), name)[keep]
        start, doc = start[keep], doc[keep]
        # pairs
        for i, most in enumerate(PAIR_ROUNDS):
            left = (mixed(name ^ np.uint64(0xA0761D6478BD642F + i)) >> np.uint64(63)).astype(bool)
            active = length <= most
            at = np.flatnonzero((left & active)[:-1] & (~left & active)[1:] & (doc[1:] == doc[:-1]))
            name[at] = mixed(name[at] * _PRIME + mixed(name[at + 1] + np.uint64(i + 1)))
            length[at] += length[at + 1]
            keep = np.ones(len(name), bool)
            keep[at + 1] = False
            name, start, length, doc = name[keep], start[keep], length[keep], doc[keep]
        return start, length


def anchors(p: Parsed, window: int) -> tuple[np.ndarray, ...]:
    """``(document, anchor, context, first, last)``: the windows first..last (word numbers over
    all documents) are represented by the anchor."""
    none = np.zeros(0, np.int64)
    start, length = p.symbols()
    n = len(p.hashes)
    count = np.maximum(p.sizes - window + 1, 0)
    total = int(count.sum())
    if not total:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    doc = np.repeat(np.arange(len(p.sizes)), count)
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + p.first[doc]  # first words of the windows
    lo, hi = np.maximum(start - MARGIN, 0), np.minimum(start + length + MARGIN, n)
    rank = p.span(lo, hi)  # of symbols too near a document's end it means nothing; no window takes those
    before = np.concatenate(([0], np.cumsum(np.bincount(start, minlength=n + 1))))  # symbols starting before a word
    a = before[at + MARGIN]
    b = before[at + window - MARGIN + 1] - 2  # the last that ends there or before
    best = [np.arange(len(start))]  # of 1, 2, 4, ... symbols from each on, the least (the first of equals)
    for j in range(int(np.log2(window)) + 1):
        x = best[-1]
        y = np.concatenate((x[1 << j:], x[-1:].repeat(min(1 << j, len(x)))))
        best.append(np.where(rank[x] <= rank[y], x, y))
    table = np.stack(best)
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    x, y = table[level, a], table[level, b - (1 << level) + 1]
    rep = np.where(rank[x] <= rank[y], x, y)
    new = np.flatnonzero(np.concatenate(([True], (rep[1:] != rep[:-1]) | (doc[1:] != doc[:-1]))))
    first, last = at[new], at[np.concatenate((new[1:], [total])) - 1]
    offset = (start[rep[new]] - first).astype(np.uint64)
    context = mixed(p.span(first, last + window) + (offset * np.uint64(window + 1) + (last - first).astype(np.uint64)) * _PRIME)
    return doc[new], rank[rep[new]], context, first, last


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[bytes]]]]:
    """Rows of each batch, split into groups of about ``CHUNK`` words."""
    for b in batches:
        rows, words, size = [], [], 0
        for i, text in enumerate(raw_texts(b.column("text"))):
            w = text.split()
            if rows and size + len(w) > CHUNK:
                yield b, rows, words
                rows, words, size = [], [], 0
            rows.append(i)
            words.append(w)
            size += len(w)
        if rows:
            yield b, rows, words


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b, rows, words in _chunks(batches):
            p = Parsed(words, memo)
            doc, anchor, context, first, last = anchors(p, window)
            of = pa.array(np.array(rows, np.int64)[doc])
            base = p.first[doc]
            yield pa.RecordBatch.from_arrays(
                [b.column("did").take(of), b.column("th").take(of), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)),
                 pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))],
                ["did", "th", "anchor", "context", "first", "last"])

    return docs.mapInArrow(run, "did long, th long, anchor long, context long, first int, last int")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """Each window of the ``groups`` of a row, by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b, rows, words in _chunks(batches):
            p = Parsed(words, memo)
            groups = b.column("groups").take(pa.array(rows)).to_pylist()
            flat = np.array([(r, g["anchor"], p.first[i] + g["first"], g["last"] - g["first"] + 1)
                             for i, (r, gs) in enumerate(zip(rows, groups)) for g in gs], np.int64).reshape(-1, 4)
            size = flat[:, 3]
            row, anchor, begin = (np.repeat(flat[:, c], size) for c in range(3))
            at = begin + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            of = pa.array(row)
            base = np.zeros(b.num_rows, np.int64)
            base[rows] = p.first[:-1]
            yield pa.RecordBatch.from_arrays(
                [b.column("did").take(of), b.column("th").take(of), pa.array(anchor), pa.array(p.span(at, at + window).view(np.int64)),
                 pa.array((at - base[row]).astype(np.int32))], ["did", "th", "anchor", "name", "first"])

    return docs.mapInArrow(run, "did long, th long, anchor long, name long, first int")


def _cut(docs: DataFrame) -> DataFrame:
    """Take the words of a row's ``spans`` out of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_words, n_removed = [], [], []
            for text, spans in zip(raw_texts(b.column("text")), b.column("spans").to_pylist()):
                words = text.split()
                if spans:
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, [s["s"] for s in spans], 1)
                    np.add.at(delta, [s["e"] for s in spans], -1)
                    out = np.cumsum(delta[:-1]) > 0
                    left = [w for w, gone in zip(words, out.tolist()) if not gone]
                else:
                    left = words
                kept.append(b" ".join(left))
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                ["did", "kept_text", "n_words", "n_removed"])

    return docs.mapInArrow(run, "did long, kept_text string, n_words long, n_removed long")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``(did, kept_text, n_words, n_removed)``, one row for each row of ``docs``: a word goes if
    it lies in a window of ``window`` words that also starts in a document with a smaller id.

    Null texts have no words; a text shorter than the window keeps all. Rows without an id rank
    behind all others (``common.solid_id``); rows repeating an id never take words from each
    other. Windows are judged on the input. An empty table gives an empty result.
    """
    if window < 2 * MARGIN + 2 * LONGEST - 1:
        raise ValueError("the window is too short to hold a whole symbol between its margins")
    base = id_and_text(docs).withColumn("th", F.xxhash64("text"))
    found = materialize(_anchor_rows(base, window), "anchors")
    # Sums by key are written before they are joined, so that a join with a frequent key can be split.
    shared = materialize(found.groupBy("anchor").agg(F.min("did").alias("x"), F.max("did").alias("y")).where("x < y").select("anchor"), "anchors-known")
    hits = materialize(found.join(shared, "anchor", "left_semi"), "anchors-shared")

    contexts = materialize(hits.groupBy("anchor", "context").agg(F.min("did").alias("owner")), "contexts")
    several = materialize(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "anchors-counted")
    owners = materialize(contexts.join(several, "anchor"), "owners")
    judged = materialize(hits.join(owners, ["anchor", "context"]), "anchors-judged")
    whole = judged.where("owner < did").select("did", "th", F.col("first").alias("s"), (F.col("last") + window).alias("e"))

    open_groups = (judged.where("owner = did and n > 1").select("did", "th", F.struct("anchor", "first", "last").alias("g"))
                   .groupBy("did", "th").agg(F.collect_set("g").alias("groups")))
    rows = materialize(_window_rows(base.join(open_groups, ["did", "th"]), window), "windows")
    firsts = rows.groupBy("anchor", "name").agg(F.min("did").alias("owner"), F.max("did").alias("y")).where("owner < y")
    firsts = materialize(firsts.select("anchor", "name", "owner"), "windows-known")
    single = (rows.join(firsts, ["anchor", "name"]).where("owner < did")
              .select("did", "th", F.col("first").alias("s"), (F.col("first") + window).alias("e")))

    spans = whole.union(single).distinct().groupBy("did", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return _cut(base.join(spans, ["did", "th"], "left").select("did", "text", "spans"))


def op3_rows(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select(plain_id(F.col("did")).alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
