"""Quality rules, by document and by host.

Each document is measured where its row is, with array functions (no word ever leaves its row):
repeated 3-word windows are found by sorting the windows' hashes within the text. Then hosts (the
``source`` column): documents that fail a rule are counted for each host, the failure rate is shrunk
towards the corpus by a beta prior whose parameters come from the spread of the hosts' rates (method of
moments), and the verdict on the host joins back to its documents. Functions of DataFrames only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import attach_scalars
from ..session import materialize
from .common import plain_id, solid_id

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Soft rules: symbols for 100 words, share of lines that repeat an earlier one, mean word length.
MAX_SYMBOLS_PERCENT, MAX_DUP_LINES_PERCENT, WORD_LENGTH = 10, 30, (2, 12)
#: A host goes if its shrunk failure rate exceeds this.
MAX_HOST_RATE = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more (the first included)."""
    def from_hashes(h: Column) -> Column:
        def from_sorted(z: Column) -> Column:
            def again(x: Column, k: Column) -> Column:
                return F.when((F.get(z, k - 1)["h"] == x["h"]) | (F.get(z, k + 1)["h"] == x["h"]), x["i"])

            def covered(at: Column) -> Column:
                gaps = F.transform(at, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - v, F.lit(3))))
                return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

            return let(F.sort_array(F.filter(F.transform(z, again), lambda i: i.isNotNull())), covered)

        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(pairs), from_sorted))

    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                         lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return let(hashes, from_hashes)


def measures(docs: DataFrame) -> DataFrame:
    """``(did, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)`` of every row."""
    d = docs.select(solid_id().alias("did"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    words = F.array_remove(F.split(text, SPACE), "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return d.select(
        "did", "source",
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        counted.alias("c"), lined.alias("l"),
    ).select("did", "source", "c.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "c.n_repeat_words")


def judged(m: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``failed`` (that, or a soft rule)."""
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n)
    soft = ((100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * n) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines"))
            | (F.col("word_chars") < WORD_LENGTH[0] * n) | (F.col("word_chars") > WORD_LENGTH[1] * n))
    return m.withColumn("base_failed", base).withColumn("failed", base | soft)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """``(source, host_docs, host_rate, host_ok)``: failures of each host, shrunk by the empirical beta
    prior. The prior's mean is the corpus rate, its strength ``mean (1 - mean) / variance - 1`` (1 to
    1,000,000) with the hosts' variance weighted by their documents. A null source is a host of its own."""
    hosts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("k"))
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(F.sum("host_docs").alias("n"), F.sum("k").alias("k")).select(F.col("n").alias("all_docs"), (F.col("k") / F.col("n")).alias("mean"))
    hosts = attach_scalars(hosts, total)
    spread = hosts.agg(F.sum(F.col("host_docs") * F.pow(F.col("k") / F.col("host_docs") - F.col("mean"), F.lit(2.0)) / F.col("all_docs")).alias("variance"))
    hosts = attach_scalars(hosts, spread)
    mean, room = F.col("mean"), F.col("mean") * (1 - F.col("mean"))
    strength = F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(room, F.col("variance")) - 1, F.lit(1e6))))
    rate = (F.col("k") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.select("source", "host_docs", rate.alias("host_rate"), (rate <= MAX_HOST_RATE).alias("host_ok"))


def apply_rules(docs: DataFrame) -> DataFrame:
    """Measures, rules and host verdicts for every row of ``docs``. Null and empty texts have no words and
    fail. Rows alike count as often as they occur. An empty table gives no rows."""
    rows = materialize(judged(measures(docs)), "quality")
    hosts = host_verdicts(rows)
    h = hosts.select(F.col("source").alias("host"), "host_rate", "host_ok")
    out = rows.join(h, rows.source.eqNullSafe(h.host), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def op9_rows(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select(plain_id(F.col("did")).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                    "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))
