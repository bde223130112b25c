"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens: it accepts exactly the token sequences that BPE yields. It is built by
one gadget for each merge, in order of priority. At first one state loops on every byte. Merge
``(u, v) -> w`` takes the state after ``u``; if that can read ``v``, the state is copied without
``v`` (the copy is the state after ``u`` from now on), and every state that reads ``u`` also reads
``w`` and goes to the state after ``v``.

All arcs with one label lead to one state, so a state is named by the label before it, and it is
stored by its history rather than as a set of up to |V| arcs: the token's two parts and the place
of its gadget, and the arcs taken away (the merges). ``reads(t, x)`` follows that history; the
answers fill the transition table as texts need them (deterministic, bounded by the memo's room).

Encoding: a trie over the token labels gives the arcs that match the bytes at a place; from each
state the longest matching arc is tried first. The automaton accepts one token sequence for each
byte string and for each of its prefixes, so a place found dead stays dead and the walk is linear
in places times arcs. Words are pre-split by the tokenizer's pattern and remembered.
Decoding: the labels of the arcs, one after the other.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value
from .common import Memo, id_and_text

#: Fixed value: the pre-splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ship_by_value(__name__)


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as U+0100 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load_tables(path: str) -> dict:
    """The tokenizer's tables as plain data, to be broadcast: labels, merges and special tokens.
    Their size is that of the vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    labels: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in special}
    labels |= {i: s.encode() for s, i in special.items()}
    merges = []
    for m in spec["model"]["merges"]:
        u, v = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[u], vocab[v], vocab[u + v]))
    return {"labels": [labels[i] for i in range(len(labels))], "merges": merges, "special": special}


class Automaton:
    """The tokenization automaton of a merge list, and the trie over its labels."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special = labels, special
        self.left, self.right = [-1] * len(labels), [-1] * len(labels)
        self.place = [-1] * len(labels)  # of the token's gadget; bytes have none
        self.taken: dict[int, int] = {}  # arcs taken away: (state, label) -> by which gadget
        self.size = len(labels)
        live = set(range(len(labels))) - set(special.values()) - {w for _, _, w in merges}
        for k, (u, v, w) in enumerate(merges):
            if self.place[w] >= 0:
                raise ValueError(f"two merges make token {w}")
            # gadgets after k don't exist yet, so the history as it stands is that of step k
            if u in live and v in live and self._history(u, v):
                live.add(w)
            self.taken[u * self.size + v] = k
            self.left[w], self.right[w], self.place[w] = u, v, k
        self.whole = {labels[t]: t for t in live}
        self.arcs = Memo(self._transition, 500_000)
        self.trie: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for t in sorted(live):
            node = 0
            for b in labels[t]:
                step = node << 8 | b
                if step not in self.trie:
                    self.trie[step] = len(self.ends)
                    self.ends.append(-1)
                node = self.trie[step]
            self.ends[node] = t

    def _history(self, t: int, x: int) -> bool:
        """Whether the state after ``t`` reads ``x``, told from how both came to be."""
        before = len(self.place)  # only arcs taken away before this gadget count
        while True:
            gone = self.taken.get(t * self.size + x)
            if gone is not None and gone < before:
                return False
            a, b = self.place[t], self.place[x]
            if a < 0 and b < 0:
                return True
            if a == b:  # one token twice: its last part, then its first, before its gadget
                t, x, before = self.right[t], self.left[x], a
            elif b > a:  # x was added where its first part could be read, after its gadget took its arc
                x, before = self.left[x], b + 1
            else:  # the state after t is that of its last part when its gadget came
                t, before = self.right[t], a

    def _transition(self, key: int) -> int:
        return 1 if self._history(*divmod(key, self.size)) else 0

    def _matching(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """Labels that match at ``at`` and where they end, shortest first."""
        out, node, trie, ends = [], 0, self.trie, self.ends
        for i in range(at, len(word)):
            node = trie.get(node << 8 | word[i])
            if node is None:
                break
            if ends[node] >= 0:
                out.append((ends[node], i + 1))
        return out

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        t = self.whole.get(word)
        if t is not None:
            return (t,)
        n, size, arcs = len(word), self.size, self.arcs
        path: list[int] = []
        ends = [0]
        open_arcs = [self._matching(word, 0)]
        dead: set[int] = set()
        while open_arcs:
            choice = open_arcs[-1]
            state = path[-1] if path else -1
            while choice:
                t, end = choice.pop()
                if end not in dead and (state < 0 or arcs[state * size + t]):
                    path.append(t)
                    if end == n:
                        return tuple(path)
                    ends.append(end)
                    open_arcs.append(self._matching(word, end))
                    break
            else:
                dead.add(ends.pop())
                open_arcs.pop()
                if path:
                    path.pop()
        raise ValueError("the vocabulary lacks a byte")


class Codec:
    """Pre-splitting, the automaton, and its labels: text to ids and back."""

    def __init__(self, tables: dict):
        self.automaton = Automaton(tables["labels"], tables["merges"], tables["special"])
        self.labels = self.automaton.labels
        self.id_texts = [str(i) for i in range(len(self.labels))]
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(tables["special"], key=len, reverse=True))) + ")") if tables["special"] else None
        own = list(range(len(self.labels)))  # one object for each id, shared by the remembered words
        self.words = Memo(lambda w: tuple([own[i] for i in self.automaton.encode_word(w.encode())]))

    def encode_ordinary(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the special tokens' own strings become their ids."""
        if self.special is None or not self.special.search(text):
            return self.encode_ordinary(text)
        out: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.automaton.special[part]] if i % 2 else self.encode_ordinary(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def shared_codec(tables: dict) -> Codec:
    """The codec of a broadcast table: built once in each Python worker, kept beside the table."""
    if "codec" not in tables:
        tables["codec"] = Codec(tables)
    return tables["codec"]


def broadcast_tables(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load_tables(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``(did, ids array<int>)`` for each row; a null or empty text has no ids."""
    tables = broadcast_tables(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tables.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids = [np.array(codec.encode(t), np.int32) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("did"), pa.array(ids, pa.list_(pa.int32()))], ["did", "ids"])

    return id_and_text(docs).mapInArrow(run, "did long, ids array<int>")


def encode_rows(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with ``n_tokens``, ``ids`` and ``decoded_ok`` (the ids decode to
    the text). A null or empty text has no ids."""
    tables = broadcast_tables(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tables.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids, same = [], []
                for text in part.column(len(keep)).to_pylist():
                    own = codec.encode(text)
                    same.append(codec.decode(own) == text)
                    ids.append(np.array(own, np.int32))
                cols = [*part.columns[:-1], pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", "ids", "decoded_ok"])

    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, ids array<int>, decoded_ok boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``(did, text)`` from ``(did, ids)``: the labels of the ids in order; null ids give an empty text."""
    tables = broadcast_tables(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tables.value)
        for b in batches:
            texts = [codec.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("did"), pa.array(texts, pa.string())], ["did", "text"])

    return encoded.select("did", "ids").mapInArrow(run, "did long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each row in one pass and keep digests: ``(did, n_tokens, ids_sha256,
    decoded_sha256)``. Null texts count as empty; every row of the input has one here."""
    tables = broadcast_tables(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(tables.value)
        texts = codec.id_texts
        for b in batches:
            sizes, digests, decoded = [], [], []
            for text in b.column("text").to_pylist():
                ids = codec.encode(text)
                sizes.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(texts.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                ["did", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "did long, n_tokens long, ids_sha256 string, decoded_sha256 string")
