"""Top-k, URL lists, mixing and quality rules: brute force, odd cases; the pipeline's stages."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmscope.llm import kdtree, mixing, quality, queries, simhash, urllist

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_top(rows, k=5):
    out = []
    for q, v in rows:
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD", 60)
    monkeypatch.setattr(kdtree, "BLOCK", 7)
    rnd = random.Random(6)
    rows = [(i, [float(rnd.choice([-1, 0, 0.25, rnd.gauss(0, 1)])) for _ in range(6)]) for i in range(900)]
    rows += [(i + 900, rows[i][1]) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in kdtree.op4_rows(df).collect())
    f32 = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    assert got == brute_top(f32)


def test_top_k_odd_vectors(spark):
    inf = float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [inf, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (7, []),
            (8, [1.0]), (50, [3e38, -3e38]), (None, [0.5, 0.5])]
    got = [tuple(r) for r in kdtree.op4_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()]
    big = 256 * int(np.float32(3e38))
    assert [r[:3] for r in got] == [(0, 1, 5), (0, 2, 5), (0, 3, None), (0, 4, 50), (50, 1, 5), (50, 2, 5), (50, 3, None), (50, 4, 0)]
    assert got[0][3] == 256 * 256 + 512 * 256 and got[3][3] == -(1 << 63) and big > 1 << 63
    assert kdtree.op4_rows(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_url_lists_against_brute_force(spark):
    entries = [("ads.com", 100, "add"), ("ads.com", 500, "remove"), ("ads.com", 500, "add"), ("ads.com", 900, "add"), ("x.ads.com", 200, "add"),
               ("news.org/live", 50, "add"), ("gone.net", 10, "remove"), ("late.io", 10_000_000, "add"), ("far.org", 9_000_000_000, "add"), ("1.2.3.4", 5, "add"), ("2.3.4", 5, "add"), (None, 1, "add"), ("ads.com", None, "add"), ("ads.com", 300, None)]
    urls = ["http://ads.com/a", "https://u@X.Ads.com:8080/b?q", "http://badads.com/", "http://news.org/live/1", "http://news.org/other", "http://gone.net", "late.io",
            "http://late.io./z", None, "", "http://localhost/x", "http://x.ads.com/live", "http://far.org/", "http://1.2.3.4/a", "http://9.2.3.4/"]
    times = [99, 100, 250, 499, 500, 899, 900, 5_000_000, 10_000_000, 8_999_999_999, 9_000_000_001, None]
    captures = [(i * 100 + j, u, t) for i, u in enumerate(urls) for j, t in enumerate(times)]
    captures += [captures[0]] * 2 + [(None, "http://ads.com/a", 100)]
    c = spark.createDataFrame([(*r, "z") for r in captures], "page_id long, url string, fetched long, pattern string")
    e = spark.createDataFrame(entries, "pattern string, at long, action string")

    def listed(p, t):
        log = defaultdict(set)
        for q, at, a in entries:
            if q == p and at is not None and a and at <= t:
                log[at].add(a)
        return bool(log) and "remove" not in log[max(log)]

    def expected(url, t):
        m = re.match(r"[a-z]+://(?:[^/?#]*@)?([^/?#:]*)(?::\d*)?(?:/([^/?#]+))?", url or "")
        if not m or t is None:
            return None
        host = m[1].lower().rstrip(".")
        parts = host.split(".")
        domains = [host] if all(p.isdigit() for p in parts) else [".".join(parts[i:]) for i in range(max(1, len(parts) - 1))]
        hits = [p for d in domains for p in ([d, f"{d}/{m[2]}"] if m[2] else [d]) if listed(p, t)]
        return max(hits, key=lambda p: (len(p), p), default=None)

    got = urllist.filter_captures(c, e)
    want = Counter((i, u, t, expected(u, t)) for i, u, t in captures)
    assert Counter((r["page_id"], r["url"], r["fetched"], r["pattern"]) for r in got.collect()) == want
    assert all(r["blocked"] == (r["pattern"] is not None) for r in got.collect())
    assert urllist.filter_captures(c, e.limit(0)).where("blocked").count() == 0
    assert urllist.filter_captures(c.limit(0), e).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_mixture_meets_its_targets(spark):
    rnd = random.Random(8)
    sources = ["a", "b", "Z", "é", None, "hot", "￿", "\U0001F600", "empty"]
    rows = []
    for i in range(3000):
        s = "hot" if i % 3 == 0 else rnd.choice(sources[:-1])
        rows.append((i, " ".join(["w"] * rnd.randint(0, 30)), "en", s, 1))
    rows += [(5000 + i, None if i % 2 else "", "en", "empty", 0) for i in range(5)] + [rows[7], rows[7], (None, "a b c", "en", "a", 1), (6000, "w " * 4000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 3000, 2)] + [(4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.op6_rows(docs, labels).collect()
    assert len(got) == len(rows)
    sizes, source_of = defaultdict(int), {}
    for i, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
        source_of[i] = s
    want = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 + (rows[7][1].count("w") * 2 if s == source_of[7] else 0)
    # complete epochs first: where the target passes the source's size, every document is in
    for r in got:
        if want[source_of[r["doc_id"]]] >= r["source_size"] > 0:
            assert r["taken"] >= r["size"]
    again = mixing.op6_rows(docs.repartition(7), labels).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    rows_out = mixing.mixed_documents(docs, labels)
    assert rows_out.columns == docs.columns
    counts = Counter((r["doc_id"], len((r["text"] or "").split())) for r in rows_out.collect())
    assert sum(n * k for (_, n), k in counts.items()) == sum(r["taken"] for r in got)
    assert mixing.op6_rows(docs.limit(0), labels).count() == 0
    assert mixing.mixture(docs, None).count() == len(rows)


def test_remainder_that_reaches_into_the_last_document(spark):
    """A remainder past the middle of a source's last document in key order takes the whole source."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, "w " * 100, "en", s, 1) for i, s in enumerate("abc")], DOCS)
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.op6_rows(one, labels).collect()) == [(0, 200), (1, 100), (2, 200)]
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(one, labels).collect()) == {0: 2, 1: 1, 2: 2}

    ids = spark.createDataFrame([(i, 1.0, 10) for i in range(10)], "__did long, __weight double, __size long")
    last = mixing._with_keys(ids).orderBy("__order").collect()[-1]["__did"]
    rows = [(i, "w " * (1000 if i == last else 10), "en", "b", 1) for i in range(10)] + [(10, "w " * 1090, "en", "a", 1), (11, "w " * 1090, "en", "c", 1)]
    long_last = spark.createDataFrame(rows, DOCS)
    for r in mixing.mixture(long_last).collect():
        assert r["target"] == pytest.approx({10: 2180, 11: 1816.667}.get(r["did"], 908.333), abs=0.01)
        assert r["copies"] == (2 if r["did"] > 9 else 1)
    assert mixing.mixed_documents(long_last).count() == 14

    rnd = random.Random(3)
    few = [(i, "w " * rnd.choice([1, 5, 40, 100]), "en", f"s{rnd.randint(0, 60)}", 1) for i in range(150)]
    taken, largest, want = defaultdict(int), defaultdict(int), {}
    source_of = {r[0]: r[3] for r in few}
    for r in mixing.op6_rows(spark.createDataFrame(few, DOCS), labels).collect():
        s = source_of[r["doc_id"]]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        want[s] = r["target"]
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)


def test_no_range_of_keys_holds_many_rows(spark):
    """Rows of the least weight, one source: no range holds one in a hundred, no finer range more than a few."""
    for weight in (mixing.BAD, mixing.UNKNOWN, mixing.GOOD):
        rows = mixing._with_keys(spark.range(40_000).select(F.col("id").alias("__did"), F.lit(weight).alias("__weight"), F.lit(10).alias("__size")))
        largest = [rows.groupBy((F.col("__fine") / n).cast("int")).count().agg(F.max("count")).first()[0] for n in (mixing.BUCKETS, 1)]
        assert largest[0] <= 400 and largest[1] <= 8
        by_key = [r["__did"] for r in rows.orderBy("__key", "__did").collect()]
        assert by_key == [r["__did"] for r in rows.orderBy("__order").collect()]


def test_targets_of_very_many_sources(spark):
    """Sources dealt to ranges: places in code point order, and the common level, as worked out one by one."""
    rnd = random.Random(5)
    names = [chr(rnd.choice([0x41, 0xE9, 0xFFFD, 0x1F600])) + str(i) for i in range(700)] + [None, ""]
    sizes = {s: rnd.choice([0, 1, 7, 100, 10_000]) for s in names}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = mixing.targets(df.withColumn("skey", mixing._source_key(F.col("source")))).collect()
    want = brute_targets(sizes)
    assert len(got) == len(want)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)


def test_sampling_follows_the_weights(spark):
    """With a tenth of the words asked for, good documents come in well above their share."""
    rows = [(i, "w w w w", "en", "a" if i < 4000 else "b", 1) for i in range(4400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    got = [r for r in mixing.op6_rows(docs, labels).collect() if r["doc_id"] < 4000]
    extra = [r for r in got if r["taken"] == 8]
    assert 0.1 < len(extra) / 4000 < 0.9
    good = sum(r["doc_id"] % 2 for r in extra) / len(extra)
    assert good > 0.6


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_against_brute_force(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["a", "b", "ab", " ", " ", "\n", "\t", "#", "é", " ", "\x0b", "<"]) for _ in range(rnd.randint(0, 120))) for _ in range(300)]
    texts += ["", None, " ", "a " * 5000, "x\n" * 60, "a b c a b c", "a a a", "a a a a"]
    rows = [(i, t, "en", "s%d" % (i % 7) if i % 11 else None, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_words int")
    got = {r["doc_id"]: r for r in quality.op9_rows(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        g = got[i]
        want = brute_quality(t or "")
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want, repr(t)
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g["kept"] and g["base_failed"])


def test_host_verdicts_shrink_small_hosts(spark):
    good, bad = " ".join("word%d" % i for i in range(60)), "too short"
    rows = [(i, good, "en", f"h{i % 20}", 1) for i in range(2000)] + [(5000 + i, bad, "en", "spam", 1) for i in range(300)]
    rows += [(6000, good, "en", "spam", 1), (7000, bad, "en", "tiny", 1), (7001, good, "en", "tiny", 1), (8000, good, "en", None, 1)]
    got = {r["doc_id"]: r for r in quality.op9_rows(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[6000]["kept"] and got[6000]["host_rate"] > 0.5  # a good text of a host that fails
    assert got[7001]["kept"] and got[8000]["kept"] and not got[7000]["kept"]
    assert all(got[i]["kept"] for i in range(2000))
    assert quality.op9_rows(spark.createDataFrame([], DOCS)).count() == 0


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels, pages = spark.read.parquet(f"{SF001}/labels.parquet"), spark.read.parquet(f"{SF001}/pages.parquet")
    for df in (mixing.op6_rows(docs, labels), quality.op9_rows(docs), quality.judged(quality.measures(docs)), urllist.op5_rows(pages), mixing.mixed_documents(docs, labels)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF01)
        seen.append(out.cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    raw, clean, single, masked, mixed, tokens = seen
    gone = {r["doc_id"] for r in raw.collect()} - {r["doc_id"] for r in clean.collect()}
    assert gone and sum(labels.get(i) == 0 for i in gone) <= 3
    groups = {r["doc_id"]: r["component_id"] for r in simhash.op2_rows(clean).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values()))
    assert masked.count() == single.count() and masked.where("text rlike '<EMAIL>'").count() > 0
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in masked.collect()}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert sum(size[i] * k for i, k in copies.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
    assert tokens.count() == mixed.count() and tokens.where("not decoded_ok").count() == 0


def test_registered_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(queries.ORACLES) < set(queries.QUERIES)


@pytest.mark.parametrize("n", [0, 1])
def test_pipeline_stages_on_odd_rows_with_clashing_columns(spark, n):
    """Nulls in every column, empty and very long texts, repeated rows and extra columns named like the
    operators' own; n = 0: the same columns without rows."""
    import corpus_pipeline

    extra = ["did", "row", "skey", "size", "copies", "component", "fp", "y", "n", "__did", "__size", "spans", "ids", "n_tokens", "score", "th"]
    rows = [(1, "a few words here", "en", "s", 16), (1, "a few words here", "en", "s", 16), (2, "", "en", None, 0), (3, None, None, "s", None),
            (None, "text without an id " * 3, "en", "t", 5), (None, None, None, None, None), (4, "long text " * 60_000, "en", "t", 600_000),
            (5, "me a@b.co and 10.0.0.1", "en", "u", 22), (6, "you stupid idiot, loser and scum. trash!", "en", "u", 40)]
    rows = [(*r, *[i] * len(extra)) for i, r in enumerate(rows)]
    schema = DOCS + "".join(f", `{c}` int" for c in extra)
    docs = spark.createDataFrame(rows if n else [], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF01).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() > 0 if n else out.count() == 0
        docs = out
    if n:
        assert {r["doc_id"] for r in docs.collect()} >= {4, 5}


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op6", "op7", "op8", "op9", "op10"])
def test_operators_on_clashing_columns(spark, name):
    """Extra columns named like the operators' own change nothing."""
    from firmscope.llm import bpe, pii, recompress, tokentree, toxicity
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    rows = [(1, "a few words here", "en", "s", 16), (2, "", "en", None, 0), (3, None, None, "s", None), (None, "no id", "en", "t", 5)]
    extra = ["did", "fp", "component", "anchor", "first", "th", "size", "skey", "target", "y", "score", "base", "spans", "n_words", "failed", "host_rate", "w", "m", "__did"]
    plain = spark.createDataFrame(rows, DOCS)
    wide = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], DOCS + "".join(f", `{c}` string" for c in extra))
    run = {"op1": pii.op1_rows, "op2": simhash.op2_rows, "op3": recompress.op3_rows, "op6": lambda d: mixing.op6_rows(d, labels),
           "op7": lambda d: toxicity.op7_rows(d, labels), "op8": lambda d: bpe.round_trip(d, queries.tokenizer_path()), "op9": quality.op9_rows,
           "op10": lambda d: tokentree.op10_rows(d, queries.tokenizer_path())}[name]
    a, b = run(plain), run(wide)
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_topk_ignores_other_columns(spark):
    """Columns named like the operator's own, and repeated rows, change nothing."""
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)], 1, "x", None) for i in range(300)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string, query_id long")
    got = sorted(map(tuple, kdtree.op4_rows(plain).collect()))
    assert got == sorted(map(tuple, kdtree.op4_rows(plain.select("vec_id", "embedding")).collect())) and len(got) == 30
