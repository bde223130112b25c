"""Helpers shared by the corpus operators: ids, text batches and connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..functions.shipping import ship_by_value
from ..session import materialize

#: Words are runs of anything but ASCII white space (space, tab, line feed, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows without an id get one from here upwards, made from their text; see ``solid_id``.
NO_ID = 1 << 62

ship_by_value(__name__)


def solid_id(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The row's id, or for a null id a stand-in above every real id, made from the text:
    equal texts without an id share it, and it never wins where the smallest id is taken."""
    made = F.lit(NO_ID) + F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit((1 << 60) - 1))
    return F.coalesce(F.col(id_col).cast("long"), made)


def plain_id(c: Column) -> Column:
    """Undo ``solid_id``: a stand-in becomes null again."""
    return F.when(c < F.lit(NO_ID), c)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Columns ``did`` (never null) and ``text`` (null becomes empty); all else is left behind."""
    return docs.select(solid_id().alias("did"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


class Memo(dict):
    """Remembers ``make(key)`` for the ``room`` to ``2 * room`` keys used last; bounded memory."""

    def __init__(self, make: Callable, room: int = 300_000):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, key):
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class WordHash(Memo):
    """64-bit hashes of words (bytes)."""

    def __init__(self):
        super().__init__(xxh64_intdigest)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (multiply and shift-xor rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def components(edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, root)`` with the
    smallest node reachable as root, for every node but the roots themselves.

    Alternating large-star and small-star rounds; each round is written to the shared folder
    (the lineage ends there) and the driver sees a count and a checksum only. A node with very
    many neighbours is handled by map-side minima and an equi-join that may be split.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        m = smallest(pairs)
        if large:
            out = pairs.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = pairs.join(m, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = materialize(now, name)
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, True)
        now = materialize(star(large, False), name)
        was, seen = seen, mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

