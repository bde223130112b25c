"""Source divergence audit by Gustavson row accumulation.

Within each language, how far is a source's use of terms from every other source's (part ``pair``), and which
terms does it use more than the language as a whole (part ``term``)? A group (lang, source) gives each kept
term of its language the share ``p = 1 + floor(SCALE * (count + 1) / (N + V))``, and the divergence of p from
q is ``f(p, q) = floor((p - q)^2 / q)``, in whole numbers.

The term-major index holds, for each term, the groups that use it with their shares. Each group's row goes
through it: the entries of its terms are scattered into one dense accumulator, a place for each peer, as in
Gustavson's product of sparse matrices, so no pair of entries becomes a row. Terms that one side or both
lack are not in the index; with p0 the share of a count of zero, the sum over all V terms is

    sum f(pa, qb) = sum f(pa, qb0) + sum f(pa0, qb) - V f(pa0, qb0)
                    + sum over shared terms of f(pa, qb) - f(pa, qb0) - f(pa0, qb) + f(pa0, qb0)

and the first two sums need only how often each count occurs in a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value
from ..operators.sizing import bounded_broadcast
from ..session import materialize
from .common import raw_texts

ship_by_value(__name__)

SCALE, MIN_DOCS, TOP_TERMS = 1_000_000_000, 3, 200
#: Entries (term, group) a task counts before it hands them on; bytes of text cut into terms at once; entries of the
#: index multiplied at once; accumulators (in long values) a task holds before it hands them on.
ROOM, PIECE, STEP, DENSE = 500_000, 1 << 22, 1 << 20, 1 << 22

# A-Z become a-z, all other ASCII but a-z becomes a space; bytes of non-ASCII characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a list for each piece of it; no term is cut."""
    clean = text.translate(_TABLE)
    at = 0
    while at < len(clean):
        end = at + PIECE
        if end < len(clean):
            space = clean.find(b" ", end)
            end = len(clean) if space < 0 else space
        yield clean[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, df)``: occurrences of each term in a group, and its documents there. Each task
    counts on its own first, so a frequent term or a large group is a few rows for each task."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        df: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key in list(n):
                count, docs_of = n.pop(key), df.pop(key)
                words = list(count)
                for i in range(0, len(words), 50_000):
                    some = words[i:i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key[0]] * len(some)), pa.array([key[1]] * len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                         pa.array([count[w] for w in some], pa.int64()), pa.array([docs_of[w] for w in some], pa.int64())],
                        ["lang", "source", "term", "n", "df"])

        for b in batches:
            for t, lang, source in zip(raw_texts(b.column("text")), b.column("lang").to_pylist(), b.column("source").to_pylist()):
                key = (lang, source)
                if key not in n:
                    n[key], df[key] = Counter(), Counter()
                held: set[bytes] = set()
                for words in terms(t):
                    n[key].update(words)
                    held.update(words)
                df[key].update(held)
            if sum(map(len, n.values())) > ROOM:
                yield from flush()
        yield from flush()

    return (docs.select(text, lang, source).mapInArrow(run, "lang string, source string, term string, n long, df long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))


def _share(count: str, total: str, kept: str) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + kept))`` of named columns, exact for any long counts; for a language
    without kept terms a number that nothing depends on."""
    return F.expr(f"1L + (cast({count} + 1 as decimal(20,0)) * cast({SCALE} as decimal(10,0))) div cast(greatest({total} + {kept}, 1L) as decimal(20,0))")


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Accumulators:
    """Dense accumulators of one language, one for each group (row) seen, a place for each peer."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.zero = np.zeros(0, np.int64)  # p0 of each group
        self.rows: dict[int, np.ndarray] = {}

    def places(self, sources: pa.Array, zeros: np.ndarray) -> np.ndarray:
        """The places of ``sources``; new ones get one."""
        coded = sources.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        names = coded.dictionary.to_pylist()
        first = np.zeros(len(names), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        for name, at in zip(names, first):
            if name not in self.place:
                self.place[name] = len(self.place)
                self.zero = np.append(self.zero, zeros[at])
        return np.array([self.place[x] for x in names], np.int64)[codes]

    def add(self, starts: np.ndarray, group: np.ndarray, p: np.ndarray) -> int:
        """Send every group's row through an index slice: term t has the entries ``starts[t]:starts[t + 1]`` of
        ``group`` (places) and ``p``. Returns how many places the rows of the slice have."""
        sizes = np.diff(starts)
        term = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for mine in np.split(order, cuts):
            if not len(mine):
                continue
            a = int(group[mine[0]])
            row = self.rows.get(a, np.zeros(0, np.int64))
            if len(row) < len(self.zero):
                row = np.concatenate((row, np.zeros(len(self.zero) - len(row), np.int64)))
            width = sizes[term[mine]]
            upto = np.cumsum(width)
            lo = 0
            while lo < len(mine):
                done = upto[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(upto, done + STEP, side="right")))
                some, w = mine[lo:hi], width[lo:hi]
                ends = np.cumsum(w)
                at = np.arange(ends[-1]) - np.repeat(ends - w, w) + np.repeat(starts[term[some]], w)
                peer, pb, pa_ = group[at], p[at], np.repeat(p[some], w)
                a0, b0 = self.zero[a], self.zero[peer]
                np.add.at(row, peer, divergences(pa_, pb) - divergences(pa_, b0) - divergences(a0, pb) + divergences(a0, b0))
                lo = hi
            self.rows[a] = row
        return sum(map(len, self.rows.values()))

    def take(self) -> Iterator[tuple[str, list[str], np.ndarray]]:
        """Group, its peers and what was accumulated for them; the accumulators start anew."""
        names = np.array(list(self.place), dtype=object)
        for a, row in self.rows.items():
            used = np.flatnonzero(row)
            used = used[used != a]
            yield names[a], names[used].tolist(), row[used]
        self.rows = {}


def shared_terms(index: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the sum over shared terms, in parts (a task hands on what it has).
    ``index``: ``lang``, ``entries array<struct<source, p, p0>>``, a row for each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, Accumulators] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, held in langs.items():
                for source, peers, values in held.take():
                    for i in range(0, len(peers), 50_000):
                        n = len(peers[i:i + 50_000])
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                                                          pa.array(peers[i:i + 50_000], pa.string()), pa.array(values[i:i + 50_000], pa.int64())],
                                                         ["lang", "source", "item", "value"])

        for whole in batches:
            for i in range(0, whole.num_rows, 5000):
                b = pa.Table.from_batches([whole.slice(i, 5000)]).combine_chunks()
                names = b["lang"].to_numpy()
                for lang in set(names):
                    lists = b["entries"].filter(pa.array(names == lang)).combine_chunks()
                    flat = lists.flatten()
                    held = langs.setdefault(lang, Accumulators())
                    starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
                    p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
                    held.add(starts, held.places(flat.field("source"), p0), p)
                if sum(len(r) for h in langs.values() for r in h.rows.values()) > DENSE:
                    yield from flush()
        yield from flush()

    return index.select("lang", "entries").mapInArrow(run, "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` over all documents.

    Part ``pair``: each other source of the language, by divergence (0 if the language keeps no term), all of
    them. Part ``term``: the group's terms of a higher share than the language's, the first ``top_terms``.
    Ranks from 1 for each group and part, by falling value, then by item in UTF-8 order.

    Null text, lang and source are empty strings. Groups whose documents have no terms, or none kept, have
    all their pairs too. Repeated rows each count as a document. Very long texts are cut into terms piece by
    piece. An empty table gives no rows; other columns play no part, whatever their names.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    groups = docs.select(lang, source).distinct()
    counts = materialize(term_counts(docs), "audit-counts")
    of_term = Window.partitionBy("lang", "term")
    kept = (counts.withColumns({"lang_n": F.sum("n").over(of_term), "docs": F.sum("df").over(of_term)})
            .where(F.col("docs") >= min_docs).drop("docs", "df"))
    kept = materialize(kept, "audit-kept")
    langs = (kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
             .groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("used"))
    stats = (groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
             .fillna(0, ["total", "used", "v", "lang_total"]).withColumn("none", F.lit(0).cast("long")))
    stats = materialize(stats.withColumn("p0", _share("none", "total", "v")).drop("none"), "audit-groups")
    entries = (kept.join(bounded_broadcast(stats, 200_000), ["lang", "source"])
               .withColumns({"p": _share("n", "total", "v"), "q": _share("lang_n", "lang_total", "v")}))

    # the sums over all terms of the group, and of the peer, from how often each share occurs
    shares = (entries.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
              .union(stats.select("lang", "source", F.col("p0").alias("p"), (F.col("v") - F.col("used")).alias("n"))))
    shares = shares.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    peers = stats.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("item"), "p0")).alias("peers"))
    row = (stats.select("lang", "source", "p0", "v").join(shares, ["lang", "source"]).join(peers, "lang")
           .withColumn("peers", F.expr("filter(peers, x -> x.item <> source)")))
    row = row.select("lang", "source", F.explode(F.expr(
        "transform(peers, x -> struct(x.item as item, "
        "aggregate(shares, 0L, (s, h) -> s + h.n * (((h.p - x.p0) * (h.p - x.p0)) div x.p0)) - v * (((p0 - x.p0) * (p0 - x.p0)) div x.p0) as out, "
        "aggregate(shares, 0L, (s, h) -> s + h.n * (((x.p0 - h.p) * (x.p0 - h.p)) div h.p)) as back))")).alias("x"))
    sums = row.select("lang", F.explode(F.array(F.struct("source", F.col("x.item").alias("item"), F.col("x.out").alias("value")),
                                                F.struct(F.col("x.item").alias("source"), F.col("source").alias("item"), F.col("x.back").alias("value")))).alias("y"))
    index = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries"))
    pairs = (sums.select("lang", "y.*").unionByName(shared_terms(index)).groupBy("lang", "source", "item")
             .agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value")))
    above = entries.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    first = above.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top_terms)
    both = pairs.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(ranks)}).unionByName(first.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")


#: The same rows by plain sums over all terms of a language for each pair of sources.
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM o GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM k GROUP BY lang),
t AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0) + 1)) // (t.total + l.v) AS p,
        1 + ({SCALE} * (k.lang_n + 1)) // (l.total + l.v) AS q
      FROM t JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
