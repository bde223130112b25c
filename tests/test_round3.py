"""Facets, rules as a table, whole responses, approximate search, TTL passes and values that are NULL, ragged or odd."""

import datetime
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmscope.operators import cache, cluster, facets, ingest, intent, ivfpq, keyed, knn, leads, search, tags


# ---- C5/C9: tags

COMPANY = "company_id string, name string, industry string, size_range string, country string, year_founded int, tags array<string>"
REQUEST = "request_id long, name string, industry string, size_range string, country string, year_from int, year_to int, tags array<string>, page int, size int"


def test_batch_search_with_tags_equals_single_searches(spark):
    rnd = random.Random(1)
    pool = ["vip", "priority", "a,b", "é", ""]
    rows = [(f"c{i:03d}", rnd.choice(["acme corp", "acme", "widget"]), rnd.choice(["tech", "retail", None]), rnd.choice(["1-10", "11-50"]), rnd.choice(["us", "uk"]),
             rnd.choice([None, 1990, 2000, 0]), rnd.choice([None, [], [None], rnd.sample(pool, 3), rnd.sample(pool, 3) + [None], ["vip", "vip"]])) for i in range(220)]
    co = spark.createDataFrame(rows, COMPANY).repartition(3)
    reqs = [(0, None, None, None, None, None, None, ["vip"], 1, 5), (1, None, "Tech", None, None, None, None, ["vip", "priority"], 1, 10), (2, None, "TECH", "1-10", "US", 1991, None, ["vip"], 1, 10),
            (3, None, None, None, None, None, 1995, ["é"], 2, 4), (4, "acme", None, None, None, None, None, ["vip"], 1, 10), (5, None, None, None, None, None, None, ["vip", None], 1, 10),
            (6, None, None, None, None, None, None, [None], 1, 10), (7, None, None, None, None, None, None, ["vip", "vip", "a,b"], 3, 3), (8, None, None, None, None, None, None, ["none such"], 1, 10),
            (9, None, None, None, None, None, None, [""], 1, 1000), (10, None, "tech", None, None, None, None, [], 1, 5), (11, None, None, None, None, None, None, None, 4, 7),
            (12, "acme", "tech", None, "us", 1980, 2001, ["priority", "é"], 1, 10)]
    got = {}
    for r in search.batch_search(co, spark.createDataFrame(reqs, REQUEST)).collect():
        got.setdefault(r["request_id"], []).append((r["rank"], r["company_id"]))
    index = search.name_index(co, materialize=True)
    for rid, name, industry, size_range, country, y1, y2, tg, page, size in reqs:
        one = search.search(co, search.SearchRequest(name, industry, size_range, country, y1, y2, tg, page, size), index).collect()
        assert sorted(got.get(rid, [])) == sorted((r["rank"], r["company_id"]) for r in one), rid


def test_facet_numbers_and_pages_spell_out_only_needed_buckets(spark, monkeypatch):
    n = 70_000  # three buckets
    co = spark.range(n).select(F.format_string("%06d", "id").alias("company_id"), F.lit("x").alias("industry"), F.lit(None).cast("string").alias("size_range"),
                               F.lit("us").alias("country"), F.when(F.col("id") % 1000 == 999, F.array(F.lit("t"))).otherwise(F.array(F.lit("u"), F.lit("w"))).alias("tags"))
    idx = facets.build_facet_index(co)
    assert idx.numbered.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first() == (1, n, n)
    assert idx.numbered.where("pos <> cast(company_id as int) + 1").count() == 0
    asked = spark.createDataFrame([(1, [("tag", "t")], 5), (2, [("tag", "t"), ("country", "us")], None), (3, [("tag", "t"), ("tag", "u")], None), (4, [("tag", "w"), ("tag", "u")], 40_000)],
                                  "fs_id long, facets array<struct<facet:string,value:string>>, need long")
    hits = {}
    for r in facets.facet_hits(idx, asked).collect():
        hits.setdefault(r["fs_id"], []).append(r["pos"])
    assert sorted(hits[2]) == [1000 * (i + 1) for i in range(70)] and 3 not in hits
    assert len(hits[1]) == 32 and max(hits[1]) <= facets.BITS  # the first bucket holds enough
    assert 40_000 <= len(hits[4]) < 66_000 and max(hits[4]) <= 2 * facets.BITS


# ---- E1: rules as a table; what is cached

def test_rule_table_equals_the_first_contained_phrase(spark, monkeypatch):
    rnd = random.Random(2)
    words = ["cloud", "Cloud in", "n l", "é", "in london", "startups in london", "", "the", "he", "Über"]
    rules = [(i, rnd.randrange(5) if i % 7 else None, rnd.choice(words) if i % 11 else f"unseen {i}", f"ind {i}", i % 2 == 0) for i in range(1, 60)] + [(99, 0, None, "x", None)]
    queries = [(i, q) for i, q in enumerate(["Cloud in London ", " the startups in LONDON", "nothing", "", None, "an ÜBER thing", "é", "\tn l\n"])]
    r = spark.createDataFrame(rules, "rule_id long, priority long, phrase string, industry string, requires_agent boolean")
    q = spark.createDataFrame(queries, "query_id long, query string")
    for some in (rules, [x for x in rules if x[2] != ""]):
        for most in (1000, 9):  # one automaton, several
            monkeypatch.setattr(intent, "MAX_RULES", most)
            got = {x["query_id"]: x["rule_id"] for x in intent.rule_matches(q, r.where(F.col("rule_id").isin([x[0] for x in some]))).collect()}
            for i, text in queries:
                fits = [(p or 0, rid) for rid, p, phrase, *_ in some if phrase is not None and text is not None and phrase.lower() in text.strip().lower()]
                assert got[i] == (min(fits)[1] if fits else None), (i, text)
    monkeypatch.setattr(intent, "MAX_RULES", 1000)
    out = {x["query_id"]: x for x in intent.resolve_intents(q, r.where("phrase <> ''")).collect()}
    assert out[0]["source"] == "rule" and out[0]["intent"]["industry"].startswith("ind ") and out[2]["source"] == "keyword"
    assert intent.rule_matches(q, r.limit(0)).where("rule_id is not null").count() == 0


def test_keyword_answers_are_not_cached_and_json_null_is_a_miss(spark):
    q = spark.createDataFrame([(1, "who founded acme")], "query_id long, query string")
    assert intent.intent_cache_entries(intent.resolve_intents(q)).count() == 0
    extracted = spark.createDataFrame([(1, '{"industry": "x"}')], "query_id long, raw string")
    assert intent.intent_cache_entries(intent.resolve_intents(q, extracted=extracted)).count() == 1
    t0 = datetime.datetime(2024, 1, 1)
    entries = spark.createDataFrame([(v, v, t0, t0 + datetime.timedelta(days=1)) for v in ("null", " null\n", "\tnull ", "{}", "not json", '"null"')],
                                    "key string, value string, filled_at timestamp, expires_at timestamp")
    got = {r["key"]: r["cache_hit"] for r in cache.cache_lookup(entries.select("key"), entries.withColumnRenamed("key", "key"), "key", F.lit(t0)).collect()}
    assert got == {"null": False, " null\n": False, "\tnull ": False, "{}": True, "not json": False, '"null"': True}


def test_new_tag_beside_a_null_element(spark):
    co = spark.createDataFrame([("a", ["x", None]), ("b", None)], "company_id string, tags array<string>")
    req = spark.createDataFrame([("a", "new", 1), ("a", "x", 2), ("b", "new", 3)], "company_id string, tag string, seq long")
    got = {r["company_id"]: r["tags"] for r in tags.add_tags(co, req)[0].collect()}
    assert got == {"a": ["x", None, "new"], "b": ["new"]}


# ---- nearest neighbours

def vectors(spark, x, extra=()):
    t = pa.table([pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "embedding"])
    df = spark.createDataFrame(t)
    return df.unionByName(spark.createDataFrame(list(extra), "doc_id long, embedding array<float>")) if extra else df


ODD = [(900_001, [1.0, None] + [0.0] * 6), (900_002, [float("nan")] * 8), (900_003, [float("inf")] + [0.0] * 7), (900_004, [1.0] * 3), (900_005, [0.0] * 8), (900_006, None), (None, [1.0] * 8), (900_007, [])]


def test_exact_and_approximate_search_leave_odd_vectors_out(spark):
    x = np.random.default_rng(3).normal(size=(300, 8)).astype(np.float32)
    c = vectors(spark, x, ODD)
    q = c.where("doc_id < 5 or doc_id > 900000").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, int(d)) for i in range(5) for d in np.argsort(-(unit[i] @ unit.T))[:4]}
    got = {(r["query_id"], r["doc_id"]) for r in knn.knn(c, q, k=4).collect()}
    assert got == want | {(900_004, 900_004)}  # a query meets vectors of its own length
    near = ivfpq.approx_knn(c, q, 4)
    assert {(r["query_id"], r["doc_id"]) for r in near.collect()} == want  # every code is a candidate here
    assert ivfpq.approx_knn(c.limit(0), q, 4).count() == 0 and ivfpq.approx_knn(c, q.limit(0), 4).count() == 0
    assert knn.knn(c, q.limit(0), k=4).count() == 0


@pytest.mark.parametrize("n, clusters", [(2000, 0), (8000, 0), (32_000, 0), (100_000, 0), (20_000, 40)])
def test_recall_does_not_fall_with_size(spark, n, clusters):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    if clusters:
        x = (rng.normal(size=(clusters, 64))[rng.integers(0, clusters, n)] + 0.2 * x).astype(np.float32)
    c = vectors(spark, x)
    asked = np.arange(0, n, n // 100)
    q = c.where(F.col("doc_id") % (n // 100) == 0).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = ivfpq.build_cell_index(c)
    got = {(r["query_id"], r["doc_id"]) for r in ivfpq.approx_knn(c, q, 10, index=index).select("query_id", "doc_id").collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact = [(int(a), int(d)) for a, row in zip(asked, np.argsort(-(unit[asked] @ unit.T), axis=1)[:, :10]) for d in row]
    assert sum(e in got for e in exact) / len(exact) >= 0.9
    assert ivfpq.RERANK * 10 < 0.1 * n or n < 8000  # candidates scored with their whole vectors
    if clusters:
        assert index.probes < len(index.centres) / 4


# ---- F4

@pytest.mark.parametrize("slices", [1, 3, 16])
def test_ttl_labels_over_any_slices(spark, slices):
    rnd = random.Random(slices)
    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        k = rnd.choice(["hot"] * 6 + [None, "", "a", "b", "c"] + [f"k{j}" for j in range(40)])
        step = rnd.choice([rnd.randrange(100_000), rnd.randrange(0, 100_000, 600), 50_000])
        rows.append((i, k, t0 + datetime.timedelta(seconds=step) if i % 50 else None, float(i)))
    log = spark.createDataFrame(rows, "id long, k string, ts timestamp, cache_value double")
    for ttl in (1, 600, 5000, 200_000):
        want, filled = {}, {}
        for i, k, ts, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
            want[i] = k in filled and (ts - filled[k]).total_seconds() < ttl
            if not want[i]:
                filled[k] = ts
        want |= {r[0]: False for r in rows if r[2] is None}
        got = cache.label_ttl_hits(log, "k", "ts", "id", ttl, slices=slices)
        assert got.columns == [*log.columns, "cache_hit"]
        assert {r["id"]: r["cache_hit"] for r in got.collect()} == want
    assert cache.label_ttl_hits(log.limit(0), "k", "ts", "id", 5).count() == 0


# ---- flights on a stream; sketches

def brute_outcomes(times, flight, ttl):
    off, out = None, []
    for t in times:
        if off is None or t >= off + flight + ttl:
            off = t
            out.append("compute")
        else:
            out.append("wait" if t < off + flight else "hit")
    return out


@pytest.mark.parametrize("flight, ttl", [(0, 5), (3, 0), (4, 9), (1000, 1)])
def test_outcomes_of_one_key(flight, ttl):
    from firmscope.streaming.flight_stream import outcomes

    rnd = random.Random(flight)
    times = sorted(rnd.randrange(300) for _ in range(200))
    got, off = outcomes(np.array(times), None, flight, ttl)
    want = brute_outcomes(times, flight, ttl)
    assert got.tolist() == want
    cut = 77  # the state carries over
    first, off = outcomes(np.array(times[:cut]), None, flight, ttl)
    assert first.tolist() + outcomes(np.array(times[cut:]), off, flight, ttl)[0].tolist() == want


def test_flights_go_on_after_a_restart(spark):
    from firmscope.session import shared_path
    from firmscope.streaming.flight_stream import flights_stream, keep_state_in_rocksdb

    keep_state_in_rocksdb(spark)
    rnd = random.Random(4)
    t0 = datetime.datetime(2024, 1, 1)
    rows = sorted(((rnd.choice("abc"), t0 + datetime.timedelta(seconds=rnd.randrange(4000))) for _ in range(120)), key=lambda r: r[1])
    rows = [(i, k, t) for i, (k, t) in enumerate(rows)]
    src, out, ckpt = (shared_path(spark, f"flights-{x}") for x in ("src", "out", "ckpt"))
    schema = "event_id long, k string, ts timestamp"
    for part in (rows[:50], rows[50:]):  # the second run starts from the checkpoint of the first
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(schema).parquet(src)
        q = (flights_stream(s, "k", "ts", "event_id", 120, 600, "1 hour").writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    got = {r["event_id"]: r["outcome"] for r in spark.read.parquet(out).collect()}
    for key in "abc":
        mine = [(i, (t - t0).total_seconds()) for i, k, t in rows if k == key]
        assert [got[i] for i, _ in mine] == brute_outcomes([t for _, t in mine], 120, 600)


def test_window_stats_without_successes_and_outside_the_log(spark):
    from firmscope.operators.metrics import latency_sketches, window_stats

    t = datetime.datetime(2024, 1, 1)
    rows = [("a", t + datetime.timedelta(seconds=i), float(i), True) for i in range(600)] + [("b", t, 1.0, False), ("c", t, None, True)]
    s = latency_sketches(spark.createDataFrame(rows, "endpoint string, ts timestamp, latency double, ok boolean"))
    got = {r["endpoint"]: r for r in window_stats(s, t + datetime.timedelta(minutes=2), t + datetime.timedelta(minutes=7)).collect()}
    assert set(got) == {"a"} and got["a"]["request_count"] == 300 and (got["a"]["min_latency"], got["a"]["max_latency"]) == (120.0, 419.0)
    assert got["a"]["avg_latency"] == 269.5 and abs(got["a"]["p50"] - 269.5) <= 3
    whole = {r["endpoint"]: r for r in window_stats(s).collect()}
    assert whole["b"]["failure_count"] == 1 and whole["b"]["p50"] is None and whole["c"]["p99"] is None and whole["a"]["request_count"] == 600
    assert window_stats(s.limit(0)).count() == 0


# ---- A1: line breaks in quoted cells

def test_quoted_line_breaks_in_any_splits(spark, tmp_path):
    import csv
    import io

    from firmscope.operators import ingest
    from firmscope.sources.quoted_csv import ends_inside

    cases = {"a,b": (False, True), 'a,"b': (True, False), 'a","b': (True, True), '5" pipe,x': (False, False), '"a""': (True, False), '"a"""': (False, False),
             'x"': (False, False), '""': (False, True), "": (False, True)}
    assert {x: (ends_inside(x, False), ends_inside(x, True)) for x in cases} == cases
    rnd = random.Random(9)
    rows = [["id", "name", "note"]]
    for i in range(400):
        cell = rnd.choice(["plain", "a\nb", '"\n"', "\n" * 30, "x," * 40 + "\n", 'say "hi"', "é\n\n日本", "long " * 60])
        rows.append([str(i), f"n{i}", cell] if i % 5 else [str(i), cell, "end"])
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    for name, part in (("a.csv", text.getvalue()), ("b.csv", 'id,name,note\n900,5" pipe,x\n\n901,short\n902,"open\ncell')):
        (tmp_path / name).write_text(part, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = ingest.with_ordinal(ingest.read_company_csv(spark, str(tmp_path), multi_line=True))
            got = [(r["id"], r["name"], r["note"]) for r in raw.orderBy("_ordinal").collect()]
            assert got[:400] == [tuple(r) for r in rows[1:]]
            assert got[400:] == [("900", '5" pipe', "x"), ("901", "short", None), ("902", "open\ncell", None)]
            assert [r["_ordinal"] for r in raw.select("_ordinal").orderBy("_ordinal").collect()] == list(range(403))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_synthesis_as_one_job(spark):
    """Tasks to results: evidence cut at three, failed and empty searches, answers that are missing or broken, and a model called once."""
    tasks = spark.createDataFrame([(f"t{i}", i, None if i == 4 else f"q{i}", "processing") for i in range(6)], "task_id string, query_id long, query string, status string")
    evidence = spark.createDataFrame([(0, r, f"u{r}", f"c{r}") for r in range(5)] + [(1, 1, None, None), (2, 1, "u", "c"), (99, 1, "u", "c")],
                                     "query_id long, rank int, url string, content string")
    failed = spark.createDataFrame([(2,), (2,), (77,)], "query_id long")
    good = '{"summary": "s", "leads": [{"name": "A", "industry": "x"}, {"name": "B", "industry": "y", "year_founded": 2000}]}'
    calls = spark.sparkContext.accumulator(0)

    def complete(df):
        @F.udf("string")
        def answer(task):
            calls.add(1)
            return {"t0": good, "t1": '{"summary": "none", "leads": []}', "t2": good, "t3": "{", "t4": None}.get(task, good)
        return df.withColumn("payload", answer.asNondeterministic()("task_id"))

    job = leads.synthesize(tasks, evidence, complete, failed)
    got = {r["task_id"]: (r["state"], r["result"]) for r in job.results.collect()}
    first = json.loads(got["t0"][1])
    assert first["raw_markdown"] == "\n\n".join(f"Source: u{r}\nSnippet: c{r}" for r in range(3))
    assert [(x["name"], x["domain"], x["year_founded"], x["size_range"]) for x in first["leads"]] == [("A", None, None, "Unknown"), ("B", None, 2000, "Unknown")]
    assert json.loads(got["t1"][1]) == {"summary": "none", "raw_markdown": "Source: \nSnippet: ", "leads": []}
    assert json.loads(got["t2"][1])["raw_markdown"] == leads.SEARCH_UNAVAILABLE and json.loads(got["t5"][1])["raw_markdown"] == leads.NO_NEWS
    assert got["t3"] == ("FAILURE", "invalid JSON") and got["t4"] == ("FAILURE", "empty model response")
    exploded = {(r["task_id"], r["pos"]): r["lead_id"] for r in job.leads.collect()}
    assert sorted(exploded) == [(t, p) for t in ("t0", "t2", "t5") for p in (0, 1)]
    assert [x["id"] for x in first["leads"]] == [exploded["t0", 0], exploded["t0", 1]]
    assert {r["task_id"]: r["exception"] for r in job.dead.collect()} == {t: got[t][1] for t in ("t3", "t4")}
    assert calls.value == 6
    none = leads.synthesize(tasks.limit(0), evidence, complete)
    assert none.results.count() == none.leads.count() == none.dead.count() == 0


def test_deterministic_responses_cover_every_request(spark):
    requests = spark.createDataFrame([(1,), (2,)], "request_id long")
    found = spark.createDataFrame([(1, 2, "b", "B", 0.5), (1, 1, "a", "A", None)], "request_id long, rank int, company_id string, name string, score double")
    got = {r["request_id"]: r for r in search.deterministic_responses(requests, found).collect()}
    assert [(x["company_id"], x["name"]) for x in got[1]["results"]] == [("a", "A"), ("b", "B")]
    assert got[2]["results"] == [] and got[2]["diagnostics"].asDict() == {"route": "Deterministic", "intent": {}, "scores": []}


def test_clustered_table_answers_like_the_plain_one(spark, tmp_path):
    """A third of the rows in one industry, NULL fields and years: same pages, and the files that hold the matches are among those read."""
    rnd = random.Random(4)
    rows = [(f"c{i:05d}", f"n{i}", "hot" if i % 3 == 0 else rnd.choice([None, "", *(f"ind{j}" for j in range(40))]), rnd.choice(["1-10", "11-50", "51-200", None]),
             rnd.choice([f"country {j}" for j in range(30)]), rnd.choice([None, 0, *range(1900, 2024)]), ["t"] if i % 5 else None) for i in range(6000)]
    co = spark.createDataFrame(rows, COMPANY).repartition(4)
    table = cluster.write_clustered(co, 48, str(tmp_path / "cluster ed"))
    assert table.rows.count() == 6000 and sorted(table.rows.columns) == sorted(co.columns)
    n = table.years.count()
    sizes = [r["count"] for r in table.rows.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert n >= 40 and max(sizes) < 6000 / 48 * 2  # the hot industry fills several files
    reqs = [search.SearchRequest(industry="Hot"), search.SearchRequest(industry="ind7", country="Country 4"), search.SearchRequest(country="country 9", year_from=1950, year_to=1970, page=2, size=7),
            search.SearchRequest(size_range="1-10", industry="ind3", year_to=1990, tags=["t"]), search.SearchRequest(year_to=1900), search.SearchRequest(industry="none such"), search.SearchRequest()]
    shares = []
    for r in reqs:
        assert [x["company_id"] for x in cluster.search_clustered(table, r).collect()] == [x["company_id"] for x in search.search(co, r).collect()], r
        shares.append(table.files(r).count() / n)
    # 48 files: five to six cuts in all, so two of industry and country each, one of years (these lie around the middle cut)
    assert shares[1] < 0.25 and shares[2] < 0.6 and shares[3] < 0.3 and shares[5] == 0 and shares[6] == 1
    with pytest.raises(ValueError):
        cluster.search_clustered(table, search.SearchRequest(name="n1"))
    none = cluster.write_clustered(co.limit(0), 3, str(tmp_path / "none"))
    assert cluster.search_clustered(none, search.SearchRequest(industry="hot")).count() == 0


def test_one_field_of_a_large_clustered_table(spark, tmp_path):
    """With more files a single field rules out more of them: below a quarter."""
    co = spark.range(30_000).select(F.concat(F.lit("c"), "id").alias("company_id"), F.concat(F.lit("ind"), F.xxhash64("id") % 50).alias("industry"), F.lit("1-10").alias("size_range"),
                                    F.concat(F.lit("land"), F.xxhash64("id", F.lit(1)) % 30).alias("country"), (F.lit(1900) + F.col("id") % 120).cast("int").alias("year_founded"))
    table = cluster.write_clustered(co, 200, str(tmp_path / "large"))
    for r in (search.SearchRequest(industry="ind7"), search.SearchRequest(country="land3"), search.SearchRequest(industry="ind9", country="land5")):
        assert 0 < table.files(r).count() < 50, r


def test_row_limit_reads_the_leading_files_only(spark, tmp_path):
    """Thirty files of uneven size, one of them empty: rows up to a limit come from the first files, and are numbered without being moved."""
    n = 0
    for i in range(30):
        size = 0 if i == 2 else 5 + i % 7
        (tmp_path / f"f {i:02d}.csv").write_text("name,industry\n" + "".join(f"n{n + j},x\n" for j in range(size)))
        n += size
    for limit, files in ((1, 1), (5, 1), (6, 2), (12, 4), (23, 5), (n, 30), (n + 5, 30)):
        raw = ingest.read_company_csv(spark, str(tmp_path), rows=limit)
        assert len(raw.inputFiles()) == files, limit
        out = ingest.clean_companies(raw, "ordinal", limit=limit, embed_dim=None)
        assert sorted((int(r["company_id"]), r["name"]) for r in out.collect()) == [(j, f"n{j}") for j in range(min(limit, n))]
    plan = ingest.with_ordinal(raw)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ENSURE_REQUIREMENTS" not in plan and "BroadcastHashJoin" in plan
    assert ingest.read_company_csv(spark, str(tmp_path), rows=0).count() == 5


def test_keyed_table_writes_only_touched_buckets(spark, tmp_path):
    """Changes against a dictionary; a small one reads and writes the buckets of its keys; readers of before keep what they had."""
    path = str(tmp_path / "keyed")
    held = {f"k{i}": i for i in range(500)}
    schema = "v int, company_id string"
    table = first = keyed.create_keyed(spark.createDataFrame([(v, k) for k, v in held.items()], schema), 16, path=path)

    def check(t, want):
        assert sorted((r["company_id"], r["v"]) for r in t.rows().collect()) == sorted(want.items())

    check(table, held)
    new = {"k3": -1, "new": 7}
    table = table.upsert(spark.createDataFrame([(v, k) for k, v in new.items()], schema))
    touched = [d for d in os.listdir(f"{path}/v=1") if d.startswith("kb=")]
    assert 1 <= len(touched) <= 2 and sum(v == 1 for v in table.live.values()) == len(touched)
    check(first, held)
    held |= new
    check(table, held)
    one = spark.createDataFrame([("k3",), ("k3",), ("absent",), (None,)], "company_id string")
    assert [(r["company_id"], r["v"]) for r in table.lookup(one).collect()] == [("k3", -1)]
    assert len(table.lookup(one.limit(1)).inputFiles()) == 1
    gone = [k for k in held if hash_bucket(spark, k, 16) == hash_bucket(spark, "k3", 16)]
    table = table.delete(spark.createDataFrame([(k,) for k in gone], "company_id string"))  # a bucket left empty
    held = {k: v for k, v in held.items() if k not in gone}
    check(table, held)
    again = keyed.open_keyed(spark, path, table.schema, 16)
    assert again.live == table.live and again.version == table.version
    back = again.upsert(spark.createDataFrame([(5, "k3")], schema))
    check(back, held | {"k3": 5})
    assert back.upsert(spark.createDataFrame([], schema)) is back
    none = keyed.create_keyed(spark.createDataFrame([], schema), 4, path=str(tmp_path / "none"))
    assert none.rows().count() == 0
    check(none.upsert(spark.createDataFrame([(1, "a")], schema)), {"a": 1})


def hash_bucket(spark, key, n):
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(key)), F.lit(n))).first()[0]


def test_compacted_change_log_gives_way_to_later_epochs(spark, tmp_path):
    from firmscope.streaming.ingest_stream import DOC_COLS, compact_changes, current_companies
    log, dst = str(tmp_path / "log"), str(tmp_path / "compacted")
    cols = [F.lit(None).cast("string").alias(c) for c in DOC_COLS if c not in ("company_id", "name")]

    def append(where, rows):
        spark.createDataFrame(rows, "company_id string, name string, _epoch long").select("company_id", "name", *cols, "_epoch").write.mode("append").parquet(where)

    append(log, [("a", "a0", 0), ("b", "b0", 0), ("a", "a2", 2), ("c", "c1", 1)])
    out = compact_changes(spark, log, dst, 2)
    assert sorted((r["company_id"], r["name"]) for r in out.collect()) == [("a", "a2"), ("b", "b0"), ("c", "c1")]
    append(dst, [("b", "b9", 0)])
    assert {r["company_id"]: r["name"] for r in current_companies(spark, dst).collect()} == {"a": "a2", "b": "b9", "c": "c1"}
