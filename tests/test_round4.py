"""Bounded work of joins, streams, indexes, encoders and rules."""

import contextlib
import datetime
import io
import random
import re

import numpy as np

from firmscope.operators import search

REQUESTS = ("request_id long, name string, industry string, size_range string, country string, year_from int, year_to int, tags array<string>, "
            "page int, size int")
COMPANIES = ("company_id string, name string, domain string, industry string, locality string, country string, size_range string, year_founded int, "
             "tags array<string>")


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_years_with_fields_meet_year_by_year(spark):
    """A request with fields and years meets the first companies of each year, not all of its key."""
    rnd = random.Random(1)
    co = spark.createDataFrame([(f"{i:03d}", f"n{i}", "", rnd.choice(["it", "bio", None]), "", "us", "1-10", rnd.choice([None, 0, 1990, 1991, 1995, 9999]), None)
                                for i in range(300)], COMPANIES).cache()
    asked = [(i, None, rnd.choice(["IT", "bio", "none"]), None, rnd.choice([None, "US"]), rnd.choice([None, 0, 1991, -5]), rnd.choice([1990, 1995, 20000]), None,
              rnd.choice([1, 2]), rnd.choice([3, 40])) for i in range(20)]
    out = search.batch_search(co, spark.createDataFrame(asked, REQUESTS))
    assert not re.search(r"Join .*>= r_from", plan_of(out))
    got = {}
    for r in out.collect():
        got.setdefault(r["request_id"], []).append((r["rank"], r["company_id"]))
    for a in asked:
        one = search.search(co, search.SearchRequest(*a[1:]))
        assert sorted(got.get(a[0], [])) == sorted((r["rank"], r["company_id"]) for r in one.collect()), a


def run_stream(spark, make, rows):
    from firmscope.session import shared_path

    src, out, ckpt = (shared_path(spark, f"buckets-{x}") for x in ("src", "out", "ckpt"))
    schema = "event_id long, k string, ts timestamp"
    for i, part in enumerate((rows[:len(rows) // 2], rows[len(rows) // 2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/{i}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = make(s).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 8  # buckets, however many keys
    return {r["event_id"]: r[3] for r in spark.read.parquet(out).collect()}


def stream_rows():
    rnd, t0 = random.Random(2), datetime.datetime(2024, 1, 1)
    times = sorted(rnd.randrange(6000) for _ in range(1500))
    return [(i, rnd.choice([None, *map(str, range(300))]), t0 + datetime.timedelta(seconds=t)) for i, t in enumerate(times)], times


def test_ttl_stream_keeps_state_in_buckets(spark):
    from firmscope.streaming.cache_stream import ttl_hits_stream

    rows, times = stream_rows()
    got = run_stream(spark, lambda s: ttl_hits_stream(s, "k", "ts", "event_id", 700, "1 hour", buckets=4), rows)
    filled, want = {}, {}
    for (i, k, _), t in zip(rows, times):
        want[i] = k in filled and t < filled[k] + 700
        if not want[i]:
            filled[k] = t
    assert got == want


def test_zero_ttl_fills_every_row():
    from firmscope.operators.cache import fills_of_keys

    key, t = np.array([0, 0, 0, 1]), np.array([5, 5, 6, 1])
    filled, in_force, last = fills_of_keys(key, t, np.zeros(2, np.int64), np.zeros(2, bool), 0)
    assert filled.all() and in_force.tolist() == t.tolist() and last.tolist() == [6, 1]


def test_flights_keep_state_in_buckets(spark):
    from firmscope.streaming.flight_stream import flights_stream, keep_state_in_rocksdb, outcomes

    keep_state_in_rocksdb(spark)
    rows, times = stream_rows()
    got = run_stream(spark, lambda s: flights_stream(s, "k", "ts", "event_id", 200, 500, "1 hour", buckets=2), rows)
    want = {}
    for key in {k for _, k, _ in rows}:
        mine = [(i, t) for (i, k, _), t in zip(rows, times) if k == key]
        want |= dict(zip((i for i, _ in mine), outcomes(np.array([t for _, t in mine]), None, 200, 500)[0]))
    assert got == want


def test_hashed_embedding_works_its_slots_out_once(spark):
    from firmscope.operators.ingest import with_hashed_embedding

    df = with_hashed_embedding(spark.createDataFrame([("a b a",), ("",), (None,), ("c",)], "t string"), "t", "v", 8)
    plan = plan_of(df)
    assert plan.count("md5(") == 1 and plan.index("md5(") < plan.index("filter(")  # not inside the loop over the slots
    got = {r["t"]: r["v"] for r in df.collect()}
    assert got[""] == [0.0] * 8 and sorted(got["c"]) == [0.0] * 7 + [1.0]
    assert abs(sum(x * x for x in got["a b a"]) - 1) < 1e-6


def test_both_answers_of_a_quarantine_come_from_one_run_of_the_encoder(spark, tmp_path):
    from firmscope.operators.ingest import embed_with, quarantined

    log = str(tmp_path / "calls")

    def make():
        def encode(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return texts.map(lambda t: [float(len(t))])
        return encode

    df = spark.createDataFrame([(f"t{i}",) for i in range(20)], "t string")
    good, bad = quarantined(embed_with(df, "t", make))
    assert (good.count(), bad.count()) == (20, 0) and good.columns == ["t", "embedding"] and bad.columns == ["t"]
    assert len(open(log).read().split()) == 20


def test_shards_are_bounded_by_their_texts(spark, monkeypatch):
    from firmscope.operators import blockindex

    rows = [(i, " ".join(f"w{(i * j) % 91}" for j in range(200)) if i % 10 else None) for i in range(60)]
    c, q = spark.createDataFrame(rows, "doc_id long, t string"), spark.createDataFrame([(1, "w7 w8 w13")], "query_id long, query string")

    def best():
        index = blockindex.build_block_index(c, "doc_id", {"t": "t"})
        found = blockindex.top_documents(index, q, [blockindex.Clause("t", "query", 1.0)], 15).collect()
        return len(index.labels), sorted((r["rank"], r["doc_id"], r["score"]) for r in found)

    few, want = best()
    monkeypatch.setattr(blockindex, "SHARD_CHARS", 1000)
    many, got = best()
    assert few < many and many >= 40 and got == want


def test_knn_merges_what_reaches_the_kth_best():
    from firmscope.operators.knn import _Best

    rnd = np.random.default_rng(5)
    sim, ids = np.round(rnd.random((7, 400)), 2), np.array([f"d{i}" for i in rnd.permutation(400)])
    best, merges = _Best(7, 6), []
    merge = best.merge
    best.merge = lambda: merges.append(1) or merge()
    for lo in range(0, 400, 20):
        best.add(ids[lo:lo + 20], sim[:, lo:lo + 20])
    q, s, i = best.merge()
    for n in range(7):
        want = sorted(zip(-sim[n], ids))[:6]
        assert [(-a, b) for a, b in zip(s[q == n], i[q == n])] == want
    assert len(merges) < 12


def test_many_small_splits_share_tasks(spark, tmp_path):
    from firmscope.sources.quoted_csv import read_quoted_csv

    want = [(str(i), f'a\n"{i}", b\n\n' * (i % 7) + "z") for i in range(6000)]
    path = tmp_path / "q.csv"
    path.write_text("id,name\n" + "".join('{},"{}"\n'.format(i, t.replace('"', '""')) for i, t in want))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1024")
    try:
        splits = spark.read.text(str(path)).rdd.getNumPartitions()
        r = read_quoted_csv(spark, str(path))
        assert r.rdd.getNumPartitions() < splits / 2
        got = r.orderBy("_file", "_block", "_mid").collect()
    finally:
        spark.conf.set(key, before)
    assert [(x["id"], x["name"]) for x in got] == want


def test_a_task_holds_one_automaton(spark, monkeypatch):
    from firmscope.operators import intent

    rules = [(i, i % 5, f"Word{i % 40}x") for i in range(90)] + [(200, 0, None)]
    asked = [(1, "a word3x word4x"), (1, "a word3x word4x"), (2, None), (None, "word39x"), (4, "nothing")]
    r = spark.createDataFrame(rules, "rule_id long, priority long, phrase string")
    q = spark.createDataFrame(asked, "query_id long, query string")
    monkeypatch.setattr(intent, "MAX_RULES", 8)
    df = intent.rule_matches(q, r)
    nodes = [x for x in plan_of(df).splitlines() if "ArrowEvalPython" in x]
    assert len(nodes) > 4 and all(x.count("first(") == 1 for x in nodes)
    best = lambda t: min(((p, i) for i, p, w in rules if w and t and w.lower() in t), default=(0, None))[1]
    assert sorted(map(str, df.select("query_id", "query", "rule_id").collect())) == sorted(str(x) for x in spark.createDataFrame(
        [(a, t, best(t)) for a, t in asked], "query_id long, query string, rule_id long").collect())
