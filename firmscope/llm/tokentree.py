"""Edit-aware token counts.

A document keeps its pre-tokens (the pieces that BPE never merges across) in a tree: leaves hold the
length and the token count of up to ``WIDTH`` pre-tokens, inner nodes the sums of up to ``WIDTH``
children. An edit replaces a range of characters. Pre-splitting runs from left to right, and a pre-token
depends on its own characters and ``AHEAD`` more behind it; so everything before the pre-token that holds
the place ``AHEAD`` characters before the edit stays, pre-splitting starts there, and it stops as soon as a
boundary behind the edit coincides with one of the old tree: from there on the split is the old one. Only
the pre-tokens between are encoded, their range in the tree is replaced, and sums change along the paths
above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value
from .bpe import PATTERN, Codec, broadcast_tables, shared_codec
from .common import id_and_text, plain_id, solid_id

WIDTH = 32
#: Characters behind a pre-token on which its end may depend (contractions look at two, runs of spaces at one).
AHEAD = 3
EDITS = "array<struct<at:long,remove:long,insert:string>>"
ship_by_value(__name__)


class Node:
    """Sums over pre-tokens: characters, tokens, and how many there are. A leaf has ``items``."""

    __slots__ = ("chars", "tokens", "size", "children", "items")

    def __init__(self, children: list[Node] | None, items: list[tuple[int, int]] | None):
        self.children, self.items = children, items
        if items is not None:
            self.size = len(items)
            self.chars = sum(c for c, _ in items)
            self.tokens = sum(t for _, t in items)
        else:
            self.size = sum(n.size for n in children)
            self.chars = sum(n.chars for n in children)
            self.tokens = sum(n.tokens for n in children)


def _packed(parts: list, leaf: bool) -> list[Node]:
    """Nodes of about equal size over the parts, none above WIDTH."""
    if not parts:
        return []
    n = -(-len(parts) // WIDTH)
    edges = [len(parts) * i // n for i in range(n + 1)]
    return [Node(None, parts[a:b]) if leaf else Node(parts[a:b], None) for a, b in zip(edges, edges[1:])]


def build(items: list[tuple[int, int]]) -> Node:
    level = _packed(items, True) or [Node(None, [])]
    while len(level) > 1:
        level = _packed(level, False)
    return level[0]


def _replaced(node: Node, i: int, j: int, items: list[tuple[int, int]]) -> list[Node]:
    """The nodes that stand for ``node`` with pre-tokens ``i:j`` replaced."""
    if node.items is not None:
        return _packed(node.items[:i] + items + node.items[j:], True)
    out, at, put = [], 0, False
    for n in node.children:
        a, b = i - at, j - at
        last = n is node.children[-1]
        if not put and (a < n.size or last):  # holds the first pre-token replaced, or the place behind all
            out += _replaced(n, a, min(b, n.size), items)
            put = True
        elif put and b > 0:
            if b < n.size:
                out += _replaced(n, 0, b, [])
        else:
            out.append(n)
        at += n.size
    return _packed(out, False)


class TokenTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, items: list[tuple[int, int]]):
        self.text, self.root = text, build(items)
        self.encoded = 0

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def items(self) -> list[tuple[int, int]]:
        out, todo = [], [self.root]
        while todo:
            n = todo.pop()
            if n.items is not None:
                out += n.items
            else:
                todo += reversed(n.children)
        return out

    def locate(self, at: int) -> tuple[int, int]:
        """Number and start of the pre-token that holds character ``at`` (behind the text: size and length)."""
        node, index, start = self.root, 0, 0
        if at >= node.chars:
            return node.size, node.chars
        while node.items is None:
            for n in node.children:
                if at < start + n.chars:
                    node = n
                    break
                index, start = index + n.size, start + n.chars
        for c, _ in node.items:
            if at < start + c:
                break
            index, start = index + 1, start + c
        return index, start

    def tokens_before(self, at: int) -> int:
        """Tokens of the pre-tokens that end at or before character ``at``."""
        node, start, tokens = self.root, 0, 0
        while node.items is None:
            for n in node.children:
                if at < start + n.chars or n is node.children[-1]:
                    node = n
                    break
                start, tokens = start + n.chars, tokens + n.tokens
        for c, t in node.items:
            if start + c > at:
                break
            start, tokens = start + c, tokens + t
        return tokens

    def edit(self, at: int, remove: int, insert: str, count: Callable[[str], int]) -> None:
        """Take ``remove`` characters away at ``at`` (both cut to the text) and put ``insert`` there."""
        old = self.text
        at = max(0, min(at, len(old)))
        end = at + max(0, min(remove, len(old) - at))
        new = old[:at] + insert + old[end:]
        first, start = self.locate(max(0, at - AHEAD))
        if start > max(0, at - AHEAD):  # behind the last pre-token of a text that got shorter
            first, start = self.locate(start - 1)
        shift = len(new) - len(old)
        items, last = [], self.root.size
        for m in _SPLIT.finditer(new, start):
            items.append((m.end() - m.start(), count(m.group())))
            back = m.end() - shift
            if back >= end:
                index, boundary = self.locate(back)
                if boundary == back:
                    last = index
                    break
        self.encoded += len(items)
        self.text = new
        level = _replaced(self.root, first, last, items) or [Node(None, [])]
        while len(level) > 1:
            level = _packed(level, False)
        self.root = level[0]
        while self.root.items is None and len(self.root.children) == 1:
            self.root = self.root.children[0]


_SPLIT = regex.compile(PATTERN)


def _split_items(text: str, codec: Codec) -> tuple[list[int], list[int]]:
    words = codec.split(text)
    return list(map(len, words)), list(map(len, map(codec.words.__getitem__, words)))


def build_trees(docs: DataFrame, path: str) -> DataFrame:
    """``(did, text, chars array<int>, tokens array<int>)``: the leaves of each document's tree, in order; any
    other columns named ``edits`` pass through. Null texts are empty and have no leaves. Strings of
    special tokens count as ordinary text."""
    tables = broadcast_tables(docs.sparkSession, path)
    base = id_and_text(docs) if "edits" not in docs.columns else docs.select(
        *[c for c in _named(docs)], F.col("edits").cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tables.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                made = [_split_items(t, codec) for t in b.column("text").to_pylist()]
                kind = pa.list_(pa.int32())
                cols = [pa.array([np.array(x, np.int32) for x, _ in made], kind), pa.array([np.array(y, np.int32) for _, y in made], kind)]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "chars", "tokens"])

    kinds = ", ".join(f"{n} {t}" for n, t in base.dtypes)
    return base.mapInArrow(run, f"{kinds}, chars array<int>, tokens array<int>")


def _named(docs: DataFrame):
    return [solid_id().alias("did"), F.coalesce(F.col("text"), F.lit("")).alias("text")]


def apply_edits(trees: DataFrame, path: str) -> DataFrame:
    """Edits of each row of ``trees`` (with ``edits array<struct<at, remove, insert>>``, in order, places counted
    in the text as the edits before left it). Returns the new state and what it took: ``(did, text, chars,
    tokens, n_before, n_after, n_pretokens, n_encoded)``. Null edits, or null parts of one, change nothing."""
    tables = broadcast_tables(trees.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tables.value)
        words = codec.words

        def count(word: str) -> int:
            return len(words[word])

        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                rows = []
                for text, chars, tokens, edits in zip(*(b.column(c).to_pylist() for c in ("text", "chars", "tokens", "edits"))):
                    tree = TokenTree(text, list(zip(chars, tokens)))
                    before = tree.tokens
                    for e in edits or []:
                        if e is not None and e["at"] is not None:
                            tree.edit(e["at"], e["remove"] or 0, e["insert"] or "", count)
                    items = tree.items()
                    rows.append((tree.text, [c for c, _ in items], [t for _, t in items], before, tree.tokens, tree.root.size, tree.encoded))
                kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4]
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column("did"), *cols], ["did", "text", "chars", "tokens", "n_before", "n_after", "n_pretokens", "n_encoded"])

    return trees.select("did", "text", "chars", "tokens", "edits").mapInArrow(
        run, "did long, text string, chars array<int>, tokens array<int>, n_before long, n_after long, n_pretokens long, n_encoded long")


def edited_counts(docs: DataFrame, path: str) -> DataFrame:
    """Counts before and after the ``edits`` of each row, without handing the trees on:
    ``(did, n_before, n_after, n_pretokens, n_encoded, text_sha256)``."""
    tables = broadcast_tables(docs.sparkSession, path)
    base = docs.select(*_named(docs), F.col("edits").cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tables.value)
        words = codec.words

        def count(word: str) -> int:
            return len(words[word])

        for b in batches:
            rows = []
            for text, edits in zip(b.column("text").to_pylist(), b.column("edits").to_pylist()):
                tree = TokenTree(text, list(zip(*_split_items(text, codec))))
                before = tree.tokens
                for e in edits or []:
                    if e is not None and e["at"] is not None:
                        tree.edit(e["at"], e["remove"] or 0, e["insert"] or "", count)
                rows.append((before, tree.tokens, tree.root.size, tree.encoded, hashlib.sha256(tree.text.encode()).hexdigest()))
            kinds = [*[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("did"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]],
                                             ["did", "n_before", "n_after", "n_pretokens", "n_encoded", "text_sha256"])

    return base.mapInArrow(run, "did long, n_before long, n_after long, n_pretokens long, n_encoded long, text_sha256 string")


def derived_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits for each row, derived from its id and text: a piece of it put in elsewhere, a
    stretch taken out, and a stretch replaced by digits and punctuation."""
    did, n = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.length(F.coalesce(F.col("text"), F.lit("")))

    def place(salt: int):
        return F.pmod(F.xxhash64(did, F.lit(salt)), (n + 1).cast("long"))

    def edit(at, remove: int, insert):
        return F.struct(at.alias("at"), F.lit(remove).cast("long").alias("remove"), insert.alias("insert"))

    piece = F.coalesce(F.substr(F.col("text"), (place(11) + 1).cast("int"), F.lit(40)), F.lit(""))
    return docs.withColumn("edits", F.array(edit(place(1), 0, piece), edit(place(2), 25, F.lit("")), edit(place(3), 12, F.lit("'ll 42, x!  \n"))))


def op10_rows(docs: DataFrame, path: str) -> DataFrame:
    return edited_counts(derived_edits(docs), path).select(
        plain_id(F.col("did")).alias("doc_id"), "n_before", "n_after", "n_pretokens", "n_encoded", "text_sha256")
