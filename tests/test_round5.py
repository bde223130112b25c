"""The intelligent search: answers of repeated, cached and id-less requests, and how they move."""

import re

from pyspark.sql import functions as F

from firmscope.functions.text import query_cache_key
from firmscope.operators.cache import cache_fill
from firmscope.operators.intelligent import intelligent_search
from firmscope.operators.knn import _blocks
from firmscope.operators.retrieval import build_hybrid_index



def test_answers_move_once_by_their_flight(spark):
    c = spark.createDataFrame([(i, f"red widget {'blue ' * i}", "tools", "", "de", None) for i in range(1, 6)],
                              "doc_id long, name string, industry string, locality string, country string, embedding array<float>")
    asked = [(3, "blue widget"), (1, "blue widget"), (None, "blue widget"), (None, "red"), (4, "who made it"), (5, None), (6, "cached one"), (None, "cached one")]
    q = spark.createDataFrame(asked, "query_id long, query string")
    entries = spark.createDataFrame([("cached one", '{"results": [], "agentic_task_id": "t"}')], "query string, value string").select(
        query_cache_key("search:", "query").alias("key"), "value", F.to_timestamp(F.lit("2024-01-01 12:00:00")).alias("filled_at"))
    cache = cache_fill(spark.createDataFrame([], "key string, value string, filled_at timestamp, expires_at timestamp"), entries, 86400)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        job = intelligent_search(q, build_hybrid_index(c, layout="blocks"), cache, F.to_timestamp(F.lit("2024-01-02 00:00:00")))
        found = {(r["query_id"], r["query"]): r for r in job.responses.collect()}
        plan = job.responses._jdf.queryExecution().executedPlan().toString()
        stored = {r["key"] for r in job.result_entries.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert set(found) == {(i, t or "") for i, t in asked} and job.responses.count() == len(asked) and len(stored) == 4
    ids = {k: None if r["results"] is None else [x["id"] for x in r["results"]] for k, r in found.items()}
    assert len(ids[1, "blue widget"]) == 5 and ids[1, "blue widget"] == ids[3, "blue widget"] == ids[None, "blue widget"]
    assert [s["company_id"] for s in found[1, "blue widget"]["diagnostics"]["scores"]] == ids[1, "blue widget"]
    assert ids[None, "red"] == [] and found[None, "red"]["diagnostics"]["route"] == "SemanticSearch"  # its id finds nothing
    assert found[4, "who made it"]["agentic_task_id"] and ids[4, "who made it"] == [] and found[4, "who made it"]["diagnostics"]["route"] == "AgenticSearch"
    for i in (6, None):
        r = found[i, "cached one"]
        assert r["cache_hit"] and r["results"] == [] and r["agentic_task_id"] == "t" and r["diagnostics"] is None
    assert re.search(r"SortMergeJoin \[(\w+)#", plan)[1] == "_flight"  # the join of the wide results is the last, none by text follows


def test_last_fill_wins_and_equal_times_take_the_greater_value(spark):
    rows = [("a", "x", "01"), ("a", "w", "02"), ("b", "m", "03"), ("b", "n", "03"), ("b", None, "03"), (None, "z", "01")]
    e = spark.createDataFrame(rows, "key string, value string, h string").withColumn("filled_at", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "h", F.lit(":00:00"))))
    got = cache_fill(spark.createDataFrame([], "key string, value string, filled_at timestamp, expires_at timestamp"), e, 3600)
    assert {(r["key"], r["value"]) for r in got.collect()} == {("a", "w"), ("b", "n"), (None, "z")}
    assert got.where(F.col("expires_at") != F.col("filled_at") + F.expr("interval 1 hour")).count() == 0


def test_blocks_hold_each_query_once(spark):
    for kind, ids in (("long", list(range(230))), ("string", [f"q{i}" for i in range(230)])):
        q = spark.createDataFrame([(i, [float(n), 0.5]) for n, i in enumerate(ids)], f"id {kind}, vec array<float>")
        found = list(_blocks(q, 40))
        assert all(0 < len(i) <= 40 and v.shape == (len(i), 2) for i, v in found)
        assert sorted((i.item(), *v) for own, vs in found for i, v in zip(own, vs.tolist())) == sorted((i, float(n), 0.5) for n, i in enumerate(ids))
