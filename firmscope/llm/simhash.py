"""SimHash near-duplicates by pivot distance tables.

1. Fingerprint: 3-word shingles, XXH64, majority per bit (NumPy inside Arrow batches).
2. Classes: equal fingerprints are one class; only distinct fingerprints go on.
3. Pivot table: the Hamming distances of each fingerprint to 16 reference fingerprints,
   kept per 16-bit block (``bit_count((fp ^ reference) & block)``); their sum over the blocks
   is the distance to the whole reference. In each block the references are the rows of a
   Hadamard matrix, so equal block distances mean equal blocks.
4. Candidates: two fingerprints at most 2 bits apart agree in two of the four blocks at least,
   hence have equal distances to all references there: an equi-join on those coordinates,
   one key for each of the six pairs of blocks. Nothing is lost.
5. Discard: a pair whose largest coordinate difference over the 16 references exceeds the
   limit can't link (triangle inequality). Survivors are verified by their own distance.
6. A key held by more than ``bucket`` fingerprints isn't paired up at all: each of its members
   is put next to every reference at most one bit from it (33 of them, as only the two other
   blocks may differ). Two members are within 2 bits exactly if they share such a reference,
   and a reference has 33 members at most. Exact, and linear in the size of the bucket.
7. Components over the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..functions.shipping import ship_by_value
from ..session import materialize
from .common import components, id_and_text, plain_id, raw_texts, solid_id

BLOCK_BITS, BLOCKS = 16, 4
ship_by_value(__name__)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text; zero for a text without words."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n < 1:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4080):  # bounded memory for very long texts
        bits = np.unpackbits(h[i:i + 4080].view(np.uint8), bitorder="little").reshape(-1, 64)
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(did, fp)`` of every row; fp is the unsigned fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in raw_texts(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("did"), pa.array(fp.view(np.int64))], ["did", "fp"])

    return id_and_text(docs).mapInArrow(run, "did long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references() -> list[int]:
    """16 reference fingerprints: row r of the Hadamard matrix of order 16 in all four blocks."""
    rows = [sum(1 << c for c in range(BLOCK_BITS) if (r & c).bit_count() & 1) for r in range(BLOCK_BITS)]
    return [sum(row << (BLOCK_BITS * b) for b in range(BLOCKS)) for row in rows]


def _block_distances(fp: Column, block: int) -> Column:
    mask = F.lit(_signed(((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * block)))
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(r))).bitwiseAND(mask)).cast("byte") for r in references()])


def pivot_table(classes: DataFrame) -> DataFrame:
    """Adds ``d0..d3`` (distances to the references within each block) and ``d`` (whole)."""
    out = classes.withColumns({f"d{b}": _block_distances(F.col("fp"), b) for b in range(BLOCKS)})
    whole = [reduce(lambda x, y: x + y, [F.col(f"d{b}")[j] for b in range(BLOCKS)]) for j in range(BLOCK_BITS)]
    return out.withColumn("d", F.array(*whole))


def links(classes: DataFrame, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """Edges ``(a, b)`` between class representatives that join all classes at most ``max_bits``
    apart (every linked pair is connected within its bucket). ``max_bits`` is 2, or 0."""
    if max_bits not in (0, 2):
        raise ValueError("the blocks and the radius of references are laid out for 0 or 2 bits")
    table = pivot_table(classes)
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("pair"), F.xxhash64(F.lit(i), f"d{x}", f"d{y}").alias("key"))
                     for i, (x, y) in enumerate(combinations(range(BLOCKS), 2))])
    entries = table.select("rep", "fp", F.explode(keys).alias("k")).select("rep", "fp", "k.pair", "k.key")
    entries = materialize(entries, "pivot-entries")
    sizes = entries.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(pivot_table(entries.join(sizes, ["pair", "key"])).drop(*[f"d{b}" for b in range(BLOCKS)]), "pivot-shared")

    few = shared.where(F.col("n") <= bucket)
    a = few.select("pair", "key", F.col("rep").alias("a"), F.col("fp").alias("fa"), F.col("d").alias("da"))
    b = few.select("pair", "key", F.col("rep").alias("b"), F.col("fp").alias("fb"), F.col("d").alias("db"))
    differences = [F.abs(F.col("da")[j] - F.col("db")[j]) for j in range(BLOCK_BITS)]
    near = F.greatest(*differences) <= max_bits
    verified = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits
    paired = a.join(b, ["pair", "key"]).where(F.col("fa") < F.col("fb")).where(near).where(verified).select("a", "b")

    # Large buckets: members meet at references at most one bit from both.
    free = F.lit(None)
    for i, (x, y) in enumerate(combinations(range(BLOCKS), 2)):
        bits = [BLOCK_BITS * z + j for z in range(BLOCKS) if z not in (x, y) for j in range(BLOCK_BITS)]
        free = F.when(F.col("pair") == i, F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << j)) for j in bits])).otherwise(free)
    radius = free if max_bits == 2 else F.array(F.lit(0).cast("long"))
    many = shared.where(F.col("n") > bucket)
    met = (many.select("pair", "key", "rep", "fp", F.explode(radius).alias("flip"))
           .groupBy("pair", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("ref"))
           .agg(F.collect_list("rep").alias("reps")).where(F.size("reps") > 1))
    starred = met.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    return paired.union(starred)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``(did, fp, component)`` for every row of ``docs``: the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Rows without an id take a
    stand-in (``common.solid_id``). Rows repeating an id count as one document in the components
    and each keep a row here. An empty table gives an empty result.
    """
    marks = materialize(fingerprints(docs, shingle), "simhash")
    classes = materialize(marks.groupBy("fp").agg(F.min("did").alias("rep")), "simhash-classes")
    shared_ids = marks.groupBy("did").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("did")
    several = marks.join(shared_ids, "did").join(classes, "fp").select(F.col("did").alias("a"), F.col("rep").alias("b"))
    roots = components(links(classes, max_bits).union(several), "simhash-cc")
    with_root = (classes.join(roots, classes.rep == roots.node, "left")
                 .select("fp", F.coalesce("root", "rep").alias("component")))
    with_root = materialize(with_root, "simhash-components")  # a join with a frequent fingerprint can then be split
    return marks.join(with_root, "fp").select("did", "fp", "component")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (of rows repeating that
    id, one). Columns and their order stay."""
    kept = near_duplicates(docs, shingle, max_bits).select(F.col("component").alias("did")).distinct()
    rows = docs.select(solid_id().alias("did"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(kept, "did", "left_semi").dropDuplicates(["did"]).select("row.*")


def op2_rows(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        plain_id(F.col("did")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        plain_id(F.col("component")).alias("component_id"))
