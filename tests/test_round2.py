"""Ids of any type, plans that don't rely on exchange reuse, no nested loops, and single wrong answers mended."""

import datetime as dt
import io
import contextlib
import random

import numpy as np
import pytest

from firmscope.functions.text import title_case
from firmscope.operators import cache, ingest, intent, knn, leads, metrics, retrieval, search, tags
from firmscope.plans import q_search

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def vectors(n, dim, seed):
    rnd = np.random.default_rng(seed)
    return [[float(x) for x in v] for v in rnd.normal(size=(n, dim)).astype(np.float32)]


@pytest.mark.parametrize("make, kind", [(lambda i: i, "long"), (lambda i: f"site{i}.com", "string")])
def test_knn_in_many_blocks_equals_brute_force(spark, make, kind):
    docs, asked = vectors(80, 5, 1), vectors(30, 5, 2)
    c = spark.createDataFrame([(make(i), v) for i, v in enumerate(docs)] + [(None, docs[0])], f"doc_id {kind}, embedding array<float>")
    q = spark.createDataFrame([(make(i), v) for i, v in enumerate(asked)] + [(make(3), asked[3]), (make(99), None)], f"query_id {kind}, vector array<float>")
    for metric in ("cosine", "l2"):
        whole = knn.knn(c, q, k=7, metric=metric)
        assert dict(whole.dtypes)["doc_id"] == dict(c.dtypes)["doc_id"]
        got = sorted((r["query_id"], r["knn_rank"], r["doc_id"]) for r in whole.collect())
        assert got == sorted((r["query_id"], r["knn_rank"], r["doc_id"]) for r in knn.knn(c, q, k=7, metric=metric, max_block_queries=4).collect())
        want = []
        for i, a in enumerate(np.array(asked)):
            d = np.array(docs)
            s = -(d @ a) / np.linalg.norm(d, axis=1) / np.linalg.norm(a) if metric == "cosine" else ((d - a) ** 2).sum(1)
            want += [(make(i), n + 1, make(int(j))) for n, j in enumerate(np.argsort(np.round(s, 9), kind="stable")[:7])]
        assert got == sorted(want)


def test_two_stage_retrieval_with_text_ids(spark):
    docs = [(f"site{i}.com", f"alpha beta{i} gamma", "software", "", "us", v) for i, v in enumerate(vectors(30, 4, 3))]
    corpus = spark.createDataFrame(docs, "doc_id string, name string, industry string, locality string, country string, embedding array<float>")
    q = spark.createDataFrame([("a", "beta7 alpha", docs[7][5]), ("b", "beta9", None)], "query_id string, query string, vector array<float>")
    idx = retrieval.build_hybrid_index(corpus)
    top = {r["query_id"]: r["doc_id"] for r in retrieval.two_stage_retrieval(idx, q).where("rank = 1").collect()}
    assert top == {"a": "site7.com", "b": "site9.com"}

    def failing(queries, texts):
        raise RuntimeError("down")

    fallen = retrieval.two_stage_retrieval(idx, q, reranker=retrieval.guarded_reranker(failing)).collect()
    assert fallen and all(r["re_rank_score"] == 0 for r in fallen)
    lengths = retrieval.two_stage_retrieval(idx, q, reranker=retrieval.guarded_reranker(lambda a, b: [float(len(t)) for t in b]))
    assert all(r["re_rank_score"] > 5 for r in lengths.collect())


@pytest.fixture
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield spark
    spark.conf.unset("spark.sql.exchange.reuse")


def test_ttl_hits_without_exchange_reuse(no_reuse):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("aaaaab"), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 20_000))) for i in range(3000)]
    log = no_reuse.createDataFrame(rows, "id long, k string, ts timestamp").repartition(5)
    got = {r["id"]: r["cache_hit"] for r in cache.label_ttl_hits(log, "k", "ts", "id", 300).collect()}
    filled, want = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = k in filled and t < filled[k] + dt.timedelta(seconds=300)
        if not want[i]:
            filled[k] = t
    assert got == want


def test_percentiles_without_exchange_reuse(no_reuse):
    rnd = random.Random(2)
    rows = [("hot" if i % 4 else "b", rnd.choice([rnd.gauss(0, 1), float(rnd.randint(0, 9))])) for i in range(5000)]
    df = no_reuse.createDataFrame(rows, "g string, v double").repartition(6)
    for r in metrics.exact_percentiles(df, "g", "v").collect():
        values = [v for g, v in rows if g == r["g"]]
        assert [r["p50"], r["p95"], r["p99"], r["p999"]] == pytest.approx(np.percentile(values, [50, 95, 99, 99.9]).tolist())


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_batch_search_has_no_nested_loop(spark):
    from firmscope.sources.tables import companies_from_customer
    co = companies_from_customer(spark, SF01)
    assert "NestedLoop" not in plan_of(search.batch_search(co, q_search.customer_requests(spark, SF01))) and \
        "Cartesian" not in plan_of(search.batch_search(co, q_search.order_requests(spark, SF01)))


def test_batch_search_kinds_agree_with_single_requests(spark):
    rnd = random.Random(3)
    rows = [(f"{i:04d}", f"name{i % 50} common", "", rnd.choice(["it", "bio"]), "", rnd.choice(["us", "de"]), "1-10",
             rnd.choice([None, *range(1990, 2010)]), rnd.sample(["x", "y", "z"], rnd.randint(0, 3))) for i in range(400)]
    co = spark.createDataFrame(rows, "company_id string, name string, domain string, industry string, locality string, country string, "
                                     "size_range string, year_founded int, tags array<string>").cache()
    asked = []
    for i in range(24):
        asked.append((i, rnd.choice([None, "", "name7", "common name3"]), rnd.choice([None, "IT"]), None, rnd.choice([None, "de", ""]),
                      rnd.choice([None, 0, 1995]), rnd.choice([None, 2003, 1980]), rnd.choice([None, [], ["x"], ["y", "x"]]), rnd.choice([1, 2]), rnd.choice([3, 10])))
    cols = "request_id long, name string, industry string, size_range string, country string, year_from int, year_to int, tags array<string>, page int, size int"
    got = {}
    for r in search.batch_search(co, spark.createDataFrame(asked, cols)).collect():
        got.setdefault(r["request_id"], []).append((r["rank"], r["company_id"]))
    idx = search.name_index(co)
    for a in asked:
        one = search.search(co, search.SearchRequest(*a[1:]), idx)
        assert sorted(got.get(a[0], [])) == sorted((r["rank"], r["company_id"]) for r in one.collect()), a


def test_dictionary_values_of_any_length(spark):
    q = spark.createDataFrame([(1, "firms in information technology and services since 1990")], "query_id long, query string")
    d = spark.createDataFrame([("industry", "information technology and services"), ("industry", "technology")], "field string, value string")
    r = intent.dictionary_intents(q, d).first()
    assert (r["industry"], r["year_from"]) == ("information technology and services", 1990)
    assert intent.dictionary_intents(q, d.limit(0)).first()["industry"] is None


def test_single_answers(spark):
    t = spark.createDataFrame([("3m company o'brien x-ray ÉCOLE",), (None,), ("",)], "s string")
    assert [r[0] for r in t.select(title_case("s")).collect()] == ["3M Company O'Brien X-Ray École", None, ""]
    c = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a"]), (3, None)], "company_id int, tags array<string>")
    assert [tuple(r) for r in tags.all_tags(c).collect()] == [("a", 2), ("b", 1)]
    one = spark.createDataFrame([("e", dt.datetime(2024, 1, 1), 5.0, True)], "endpoint string, ts timestamp, latency double, ok boolean")
    assert metrics.endpoint_stats(one).first()["requests_per_s"] is None
    assert metrics.endpoint_stats(one, elapsed=2.0).first()["requests_per_s"] == 0.5
    s = spark.createDataFrame([("/api/v2/search", 1.0), ("/api/v2/Standard", 2.0), ("Aggregated", 3.0)], "name string, requests_per_s double").coalesce(1)
    assert [tuple(r) for r in metrics.canonical_endpoints(s).collect()] == [("/api/v2/Standard", 2.0)]
    k = spark.createDataFrame([(1, "REVOKED", "x"), (2, "STARTED", "y")], "task_id int, state string, result string")
    assert [tuple(r) for r in leads.task_status(k).orderBy("task_id").collect()] == [(1, "failed", "x"), (2, "STARTED", None)]


def test_cache_values(spark):
    now = dt.datetime(2024, 1, 2)
    entries = spark.createDataFrame([("a", "null", now), ("b", "plain text", now), ("c", "{}", now), ("c", "[1]", now)], "key string, value string, filled_at timestamp")
    none = spark.createDataFrame([], cache.CACHE_SCHEMA)
    table = cache.cache_fill(none, entries, 60)
    asked = spark.createDataFrame([("a", now), ("b", now), ("c", now), ("d", now)], "k string, t timestamp")
    got = {r["k"]: r["cached_value"] for r in cache.cache_lookup(asked, table, "k", "t").collect()}
    assert got == {"a": None, "b": None, "c": "{}", "d": None}
    text = {r["k"]: r["cached_value"] for r in cache.cache_lookup(asked, table, "k", "t", json_values=False).collect()}
    assert text["b"] == "plain text" and text["d"] is None


def test_line_breaks_in_quoted_cells(spark, tmp_path):
    (tmp_path / "c.csv").write_text('name,domain\n"ibm\nus",ibm.com\nacme,acme.com\n')
    assert ingest.read_company_csv(spark, str(tmp_path), multi_line=True).count() == 2


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace
    from firmscope.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda p: None)
    conf = SimpleNamespace(get=lambda k, d=None: None)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_validators_take_what_the_reference_takes(spark):
    cases = [('{"name": "a", "year_from": 1990.0, "year_to": "2001", "requires_agent": "yes"}', True), ('{"name": 5}', False), ('{"name": null}', True),
             ('{"year_to": 1990.5}', False), ('{"year_to": true}', True), ('{"requires_agent": null}', False), ('{"requires_agent": 1}', True),
             ('{"requires_agent": 2}', False), ("{}", True), ("[]", False), ("null", False), ("nope", False), ("", False), (None, False)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, raw string")
    got = df.select("i", *[c.alias(n) for c, n in zip(intent.parse_intent("raw"), ("intent", "ok"))]).orderBy("i").collect()
    assert [bool(r["ok"]) for r in got] == [ok for _, ok in cases]
    assert (got[0]["intent"]["year_from"], got[0]["intent"]["year_to"], got[0]["intent"]["requires_agent"]) == (1990, 2001, True)
    lead = '{"name": "n", "industry": "i"%s}'
    payloads = [('{"summary": "s", "leads": [%s]}' % (lead % ""), True), ('{"summary": "s", "leads": []}', True), ('{"summary": 1, "leads": []}', False),
                ('{"summary": "s", "leads": [%s]}' % (lead % ', "locality": null'), False), ('{"summary": "s", "leads": [%s]}' % (lead % ', "domain": null'), True),
                ('{"summary": "s", "leads": [%s]}' % (lead % ', "year_founded": 1990.0'), True), ('{"summary": "s", "leads": [{"name": 3, "industry": "i"}]}', False),
                ('{"summary": "s", "leads": [{"name": "n"}]}', False), ('{"summary": "s", "leads": null}', False), ('{"summary": "s"}', False), ("{", False), (None, False)]
    p = leads.parse_leads(spark.createDataFrame([(i, "q", c) for i, (c, _) in enumerate(payloads)], "task_id int, query string, payload string"))
    assert [r["valid"] for r in p.orderBy("task_id").collect()] == [ok for _, ok in payloads]
    e = leads.explode_leads(p).collect()
    assert len(e) == 3 and {(r["locality"], r["size_range"]) for r in e} == {("", "Unknown")} and {r["year_founded"] for r in e} == {None, 1990}
    assert leads.dead_letters(p).count() == 8
