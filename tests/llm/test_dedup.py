"""SimHash groups and substring removal against brute force, and their odd cases."""

import hashlib
import random

import pytest
from xxhash import xxh64_intdigest

from firmscope.llm import common, recompress, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=1):
    return spark.createDataFrame([(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def test_simhash_against_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("ab cd ef gh ij kl mn op".split()) for _ in range(rnd.randint(1, 60))) for _ in range(80)]
    texts = base + [t + " ab" for t in base[:30]] + base[:10] + [t.upper() for t in base[10:14]] + ["", None, " \t\n", "x", "Ünï x y"]
    got = {r["doc_id"]: r for r in simhash.op2_rows(docs_of(spark, texts)).collect()}
    fps = {i + 1: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)


def test_links_of_small_and_large_buckets_agree_with_brute_force(spark):
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    fps = {f for s in seeds for _ in range(25) for f in [s ^ sum(1 << rnd.randrange(64) for _ in range(rnd.choice([0, 1, 1, 2, 4])))]}
    fps |= {seeds[0] ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)}  # one dense ball, more than a bucket holds
    fps = {f & (1 << 64) - 1 for f in fps}
    ids = dict(enumerate(sorted(fps)))
    classes = spark.createDataFrame([(i, simhash._signed(f)) for i, f in ids.items()], "rep long, fp long")
    for bucket in (8, 10_000):
        found = {r["node"]: r["root"] for r in common.components(simhash.links(classes, 2, bucket)).collect()}
        assert {i: found.get(i, i) for i in ids} == brute_components(ids)


def test_pivot_distances_never_exceed_the_hamming_distance(spark):
    rnd = random.Random(7)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    rows = simhash.pivot_table(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")).collect()
    refs = simhash.references()
    for f, r in zip(fps, rows):
        assert r["d"] == [(f ^ p).bit_count() for p in refs]
    for a, b in zip(range(0, 40, 2), range(1, 40, 2)):
        assert max(abs(x - y) for x, y in zip(rows[a]["d"], rows[b]["d"])) <= (fps[a] ^ fps[b]).bit_count()


def test_long_chains_of_links(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r["root"] for r in common.components(edges).collect()} == {0}


def test_dropping_near_duplicates_keeps_one_row_and_all_columns(spark):
    rows = [(3, "a b c d e", "en", 1.0), (1, "a b c d e", "de", 2.0), (1, "a b c d e", "de", 2.0), (None, "a b c d e", "fr", 3.0),
            (None, "quite another text here", "fr", 3.0), (9, None, "xx", None), (8, "", "yy", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, did string, component double")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[1], rows[4], rows[6]], key=repr)


def brute_removal(rows, window=50):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substring_removal_against_brute_force(spark):
    rnd = random.Random(11)
    vocab = ["w%d" % i for i in range(400)]
    few = ["a", "b"]

    def words(n, of):
        return [rnd.choice(of) for _ in range(n)]

    passages = [words(n, vocab) for n in (50, 51, 60, 120, 200, 49)] + [["a"] * 130, ["a", "b"] * 60, words(90, few)]
    texts = []
    for _ in range(70):
        t = []
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 10)
            t += words(rnd.randint(0, 40), vocab) + p[a if rnd.random() < 0.3 else 0:] + words(rnd.randint(0, 5), few)
        texts.append(rnd.choice([" ", "\n", " \t "]).join(t))
    texts += ["", None, " ", "a " * 5000, "a " * 4999 + "b"]
    got = {r["doc_id"]: tuple(r)[1:] for r in recompress.op3_rows(docs_of(spark, texts)).collect()}
    assert got == brute_removal([(i + 1, t) for i, t in enumerate(texts)])
    assert sum(v[1] for v in got.values()) > 1000


def test_substring_removal_of_rows_without_or_with_equal_ids(spark):
    text = " ".join("w%d" % i for i in range(80))
    docs = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 2), (None, "z " + text, 3)], "doc_id long, text string, th int")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in recompress.op3_rows(docs).collect())
    assert got == [(-1, 80, 80), (-1, 81, 80), (4, 80, 0), (4, 80, 0)]


def test_window_too_short_for_the_margins(spark):
    with pytest.raises(ValueError):
        recompress.remove_repeats(docs_of(spark, ["a"]), window=10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.op2_rows(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0
    assert recompress.op3_rows(none).count() == 0
