"""Ingest cleaning rules, tags, latency reporting and lead synthesis on literal fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from firmscope.functions.buckets import size_bucket
from firmscope.functions.text import highlight
from firmscope.operators.ingest import clean_companies, read_company_csv, synthetic_companies, with_ordinal
from firmscope.operators.leads import (NO_NEWS, SEARCH_UNAVAILABLE, context_with_fallback, dead_letters,
                                       evidence_context, explode_leads, parse_leads, task_status)
from firmscope.operators.metrics import compare_runs, endpoint_stats, report_lines
from firmscope.operators.tags import add_tags, all_tags

CSV = """,name,domain,year founded,industry,size range,locality,country,linkedin url,current employee estimate,total employee estimate
5872184,ibm,ibm.com,1911.0,information technology and services,10001+,"new york, new york, united states",united states,linkedin.com/company/ibm,274047,716906
4425416,tata consultancy services,tcs.com,1968.0,information technology and services,10001+,"bombay, maharashtra, india",india,x,190771,341369
21074,accenture,accenture.com,1989.0,information technology and services,10001+,"dublin, dublin, ireland",ireland,x,190689,455768
101,test company,test.com,,software,1-10,"san francisco, california",united states,,10,10
102,Bad Year,bad.com,abc,SOFTWARE,1-10,x,united states,,1,1
103,IBM Again,ibm.com,1912.0,Tech,10001+,armonk,united states,,1,1
104,No Domain Co,,2000.0,retail,11-50,y,us,,1,1
105,,,2001.0,retail,11-50,z,us,,1,1
106,Short Row,short.com
107,O'Brien & Sons,obrien.com,1950.0,legal,51-200,"dublin, ireland",ireland,,60,90
"""


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("csv") / "companies.csv"
    p.write_text(CSV)
    return read_company_csv(spark, str(p))


def test_natural_keys_last_wins_and_cleaning(raw):
    out = {r["company_id"]: r for r in clean_companies(raw, "natural", embed_dim=8).collect()}
    assert out["ibm.com"]["name"] == "ibm again" and out["ibm.com"]["year_founded"] == 1912  # later row wins
    assert out["test.com"]["year_founded"] is None  # empty year
    assert out["bad.com"]["year_founded"] is None and out["bad.com"]["industry"] == "software"  # lower-cased
    assert "no domain co" in out  # keyed by name
    assert "" not in out and None not in out  # no key → skipped
    assert out["short.com"]["industry"] == ""  # short row → NULL → ''
    assert out["obrien.com"]["name"] == "o'brien & sons"
    assert out["tcs.com"]["locality"] == "bombay, maharashtra, india"  # quoted commas kept
    assert out["ibm.com"]["tags"] == [] and len(out["ibm.com"]["embedding"]) == 8


def test_ordinal_mode_and_limit(raw):
    out = clean_companies(raw, "ordinal", limit=4, embed_dim=None).orderBy(F.col("company_id").cast("int")).collect()
    assert [r["company_id"] for r in out] == ["0", "1", "2", "3"]
    assert [r["name"] for r in out] == ["ibm", "tata consultancy services", "accenture", "test company"]
    assert clean_companies(raw, "ordinal", embed_dim=None, missing_year=0).where("company_id = '3'").first()[
        "year_founded"] == 0


def test_ordinal_is_dense_across_splits(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text("a\n" + "\n".join(str(i * 100 + j) for j in range(5 + i)) + "\n")
    df = with_ordinal(read_company_csv(spark, str(tmp_path)))
    ords = sorted(r["_ordinal"] for r in df.collect())
    assert ords == list(range(18))


def test_size_bucket_edges(spark):
    edges = [10, 11, 50, 51, 200, 201, 500, 501, 1000, 1001, 5000, 5001, 10000, 10001]
    got = [r[0] for r in spark.createDataFrame([(e,) for e in edges], "n int").select(size_bucket("n")).collect()]
    assert got == ["1-10", "11-50", "11-50", "51-200", "51-200", "201-500", "201-500", "501-1000", "501-1000",
                   "1001-5000", "1001-5000", "5001-10000", "5001-10000", "10001+"]


def test_highlight(spark):
    df = spark.createDataFrame([("IBM Consulting", "ibm"), ("", "x"), ("C++ shop", "c++"), ("abc", None)],
                               "t string, q string")
    got = [r[0] for r in df.select(highlight("t", "q")).collect()]
    assert got == ["**IBM** Consulting", "Unknown", "**C++** shop", "abc"]


def test_synthetic_rows_deterministic(spark):
    a = synthetic_companies(spark, 50).collect()
    b = synthetic_companies(spark, 50).repartition(7).orderBy("name").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(r["total employee estimate"] == int(r["current employee estimate"] * 3 / 2) for r in a)


def test_add_tags_semantics(spark):
    co = spark.createDataFrame([("1", None), ("2", ["vip"]), ("3", [])], "company_id string, tags array<string>")
    req = spark.createDataFrame([("1", " priority ", 1), ("1", "vip", 2), ("1", "priority", 3), ("2", "vip", 1),
                                 ("2", "new", 2), ("9", "x", 1)], "company_id string, tag string, seq long")
    upd, rej = add_tags(co, req)
    got = {r["company_id"]: r["tags"] for r in upd.collect()}
    assert got == {"1": ["priority", "vip"], "2": ["vip", "new"], "3": []}
    assert [r["company_id"] for r in rej.collect()] == ["9"]
    again, _ = add_tags(upd, req)  # idempotent
    assert {r["company_id"]: r["tags"] for r in again.collect()} == got
    top = [(r["tag"], r["doc_count"]) for r in all_tags(upd).collect()]
    assert top == [("vip", 2), ("new", 1), ("priority", 1)]
    assert all_tags(co.limit(0)).count() == 0


def test_latency_stats_and_report(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", t, 10.0, True), ("a", t + dt.timedelta(seconds=10), 30.0, True),
                                 ("a", t + dt.timedelta(seconds=5), 99.0, False),
                                 ("b", t + dt.timedelta(seconds=2), 1.0, False)],
                                "endpoint string, ts timestamp, latency double, ok boolean")
    s = {r["endpoint"]: r for r in endpoint_stats(log).collect()}
    assert s["a"]["request_count"] == 3 and s["a"]["failure_count"] == 1
    assert s["a"]["avg_latency"] == 20.0 and s["a"]["p50"] == 20.0 and s["a"]["requests_per_s"] == 0.3
    assert s["b"]["avg_latency"] == 0.0 and s["b"]["max_latency"] == 0.0  # no success → zeros
    base = spark.createDataFrame([("x", 10.0, 100.0), ("y", 0.0, 0.0), ("z", 5.0, 50.0)],
                                 "name string, requests_per_s double, avg_latency double")
    cur = spark.createDataFrame([("x", 15.0, 80.0), ("y", 3.0, 2.0)], "name string, requests_per_s double, "
                                "avg_latency double")
    cmp = {r["name"]: r for r in compare_runs(base, cur).collect()}
    assert cmp["x"]["rps_delta_pct"] == 50.0 and cmp["x"]["latency_delta_pct"] == 20.0
    assert cmp["y"]["rps_delta_pct"] is None and cmp["z"]["cur_rps"] == 0.0
    lines = {r["name"]: r["line"] for r in report_lines(compare_runs(base, cur)).collect()}
    assert lines["x"] == "| x | 10.00 | 15.00 | **+50.0%** | 100.00 | 80.00 | **-20.0%** |"
    assert lines["y"] == "| y | 0.00 | 3.00 | **+N/A** | 0.00 | 2.00 | **-N/A** |"


def test_evidence_context_and_fallbacks(spark):
    ev = spark.createDataFrame([("q1", 2, "http://b", "two"), ("q1", 1, "http://a", "one"), ("q1", 3, "http://c", "3"),
                                ("q1", 4, "http://d", "4")], "query_id string, rank int, url string, content string")
    ctx = evidence_context(ev).first()["context"]
    assert ctx == "Source: http://a\nSnippet: one\n\nSource: http://b\nSnippet: two\n\nSource: http://c\nSnippet: 3"
    q = spark.createDataFrame([("q1", False), ("q2", False), ("q3", True)], "query_id string, failed boolean")
    got = {r["query_id"]: r["context"] for r in context_with_fallback(q, evidence_context(ev), "failed").collect()}
    assert got["q2"] == NO_NEWS and got["q3"] == SEARCH_UNAVAILABLE


def test_leads_parse_explode_and_dead_letters(spark):
    payloads = spark.createDataFrame([
        ("t1", "q", '{"summary": "s", "leads": [{"name": "A", "industry": "x", "year_founded": 2001}, '
                    '{"name": "B", "industry": "y", "country": "us"}]}'),
        ("t2", "q", None), ("t3", "q", "{broken"), ("t4", "q", '{"summary": "s", "leads": [{"name": "C"}]}'),
    ], "task_id string, query string, payload string")
    parsed = parse_leads(payloads)
    leads = explode_leads(parsed).orderBy("pos").collect()
    assert [(r["name"], r["locality"], r["country"], r["size_range"], r["year_founded"]) for r in leads] == [
        ("A", "", "", "Unknown", 2001), ("B", "", "us", "Unknown", None)]
    assert len({r["lead_id"] for r in leads}) == 2
    dl = {r["task_id"]: r["exception"] for r in dead_letters(parsed).collect()}
    assert dl == {"t2": "empty model response", "t3": "invalid JSON", "t4": "validation error: a field is missing or of another type"}


def test_task_status_mapping(spark):
    t = spark.createDataFrame([("1", "PENDING", None), ("2", "SUCCESS", "ok"), ("3", "FAILURE", "boom")],
                              "task_id string, state string, result string")
    got = {r["task_id"]: (r["status"], r["result"]) for r in task_status(t).collect()}
    assert got == {"1": ("PENDING", None), "2": ("SUCCESS", "ok"), "3": ("failed", "boom")}


def test_embed_hook_builds_model_once_per_task(spark):
    from firmscope.operators.ingest import embed_with

    def make_model():
        def encode(texts):
            import pandas as pd
            return pd.Series([[float(len(t)), 1.0] for t in texts])
        return encode

    df = spark.createDataFrame([("ab",), ("abcd",)], "text string")
    got = [r["embedding"] for r in embed_with(df, "text", make_model).orderBy("text").collect()]
    assert got == [[2.0, 1.0], [4.0, 1.0]]


def test_approx_percentiles_close_to_exact(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", t + dt.timedelta(seconds=i), float(i % 97), True) for i in range(2000)],
                                "endpoint string, ts timestamp, latency double, ok boolean")
    ex = endpoint_stats(log, exact=True).first()
    ap = endpoint_stats(log, exact=False).first()
    for c in ("p50", "p95", "p99"):
        assert abs(ex[c] - ap[c]) <= 1.0


def test_exact_percentiles_hot_group_spans_slices(spark):
    import numpy as np

    from firmscope.operators.metrics import exact_percentiles
    rng = np.random.default_rng(7)
    hot = rng.normal(100, 30, 3000).round(3)
    cold = rng.normal(10, 2, 50).round(3)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, "g", "v").collect()}
    for g, vals in (("hot", hot), ("cold", cold)):
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)):
            assert got[g][name] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9), (g, name)


def test_stream_ingest_incremental_last_wins(spark, tmp_path):
    import time as _t

    from firmscope.streaming.ingest_stream import current_companies, start_ingest_stream
    cols = ["", "name", "domain", "year founded", "industry", "size range", "locality", "country"]
    header = ",".join(cols) + "\n"
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text(header + "1,Acme,acme.com,1999.0,Tech,11-50,x,us\n2,Beta,beta.com,,Food,1-10,y,uk\n")
    _t.sleep(1.1)
    (src / "b.csv").write_text(header + "3,Acme New,acme.com,2001.0,Tech,51-200,x,us\n")
    target, ck = str(tmp_path / "t"), str(tmp_path / "ck")
    start_ingest_stream(spark, str(src), cols, target, ck, embed_dim=None).awaitTermination()
    cur = {r["company_id"]: r for r in current_companies(spark, target).collect()}
    assert cur["acme.com"]["name"] == "acme new" and cur["acme.com"]["year_founded"] == 2001
    assert cur["beta.com"]["year_founded"] is None
    _t.sleep(1.1)
    (src / "c.csv").write_text(header + "4,Beta Two,beta.com,1980.0,Food,1-10,y,uk\n")
    start_ingest_stream(spark, str(src), cols, target, ck, embed_dim=None).awaitTermination()  # restart
    log_rows = spark.read.parquet(target).count()
    cur = {r["company_id"]: r for r in current_companies(spark, target).collect()}
    assert cur["beta.com"]["name"] == "beta two" and len(cur) == 2
    assert log_rows == 2 + 1 + 1  # one version per key and file; the restart replays nothing
