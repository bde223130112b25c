"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs its whole plan into Spark's ``noop`` sink (no collect), twice; the
reported time is the best (warm) run, the first run is kept under ``cold_first_run``. The hybrid
index is built once (like the reference's ingest + index step) and timed separately as
``index_build`` (part of the total); every other entry is one end-to-end query over the full tables.
Throughput: benchmark queries per second for D14/D1/D3 (semantic search), structured search
requests per second (C9, two distinct requests per customer; one per order is kept beside it, whose
filter sets repeat), intent resolution per second (E5) and dispatch per second (G9) over the user
turns, rows per second for ingest without and with embedding.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from firmscope.plans import q_ingest, q_intent, q_leads, q_reporting, q_retrieval, q_search
    from firmscope.operators.ingest import clean_companies, read_company_csv
    from firmscope.session import build_session
    from firmscope.sources.tables import read_table

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="firmscope-bench")
    times: dict[str, float] = {}

    cold: dict[str, float] = {}

    def run(name, fn, repeat: int = 2):
        best = None
        for i in range(repeat):
            t0 = time.time()
            df = fn()
            df.write.format("noop").mode("overwrite").save()
            dt = round(time.time() - t0, 3)
            if i == 0:
                cold[name] = dt
            best = dt if best is None else min(best, dt)
        times[name] = best

    # warm-up: JVM, Python workers, file listing
    read_table(spark, sf_dir, "part").write.format("noop").mode("overwrite").save()

    t0 = time.time()
    q_retrieval.hybrid_index(spark, sf_dir)
    times["index_build"] = round(time.time() - t0, 3)

    run("d14_two_stage_retrieval", lambda: q_retrieval.d14_two_stage(spark, sf_dir))
    run("d1_bm25_match", lambda: q_retrieval.d1_bm25_match(spark, sf_dir))
    run("d3_knn_top100", lambda: q_retrieval.d3_knn(spark, sf_dir))
    run("c9_batch_search", lambda: q_search.c9_batch(spark, sf_dir))
    run("c1_name_match", lambda: q_search.c1_name_match(spark, sf_dir))
    run("c9_batch_search_per_order", lambda: q_search.c9_orders(spark, sf_dir))
    run("c9_batch_search_per_customer", lambda: q_search.c9_customers(spark, sf_dir))
    run("g9_dispatch", lambda: q_leads.g9_dispatch(spark, sf_dir))
    # ingest: CSV derived from part written once, then read + clean + key + embed
    from firmscope.sources.company_csv import company_csv_path
    company_csv_path(spark, sf_dir)
    run("a4_csv_ingest_natural", lambda: q_ingest.a4_natural(spark, sf_dir))
    run("a4_d10_ingest_with_embedding", lambda: clean_companies(read_company_csv(spark, company_csv_path(spark, sf_dir)), id_mode="natural", embed_dim=64))
    run("e5_resolve_intents", lambda: q_intent.e5_resolve(spark, sf_dir))
    run("f4_ttl_hits_24h", lambda: q_intent.f4_ttl_24h(spark, sf_dir))
    run("h1_add_tags", lambda: q_reporting.h1_add(spark, sf_dir))
    run("i1_i2_endpoint_stats", lambda: q_reporting.i1_stats(spark, sf_dir))

    n_queries = read_table(spark, sf_dir, "benchmark").count()
    n_parts = read_table(spark, sf_dir, "part").count()
    n_orders = read_table(spark, sf_dir, "orders").count()
    n_customers = read_table(spark, sf_dir, "customer").count()
    n_user = read_table(spark, sf_dir, "conversations").where("role = 'user'").count()
    sf = sf_dir.rstrip("/").split("sf")[-1]
    out = {
        "metric": "total_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "throughput": {
            "d14_queries_per_s": round(n_queries / times["d14_two_stage_retrieval"], 2),
            "d1_queries_per_s": round(n_queries / times["d1_bm25_match"], 2),
            "d3_queries_per_s": round(n_queries / times["d3_knn_top100"], 2),
            "ingest_rows_per_s": round(n_parts / times["a4_csv_ingest_natural"], 1),
            "ingest_with_embedding_rows_per_s": round(n_parts / times["a4_d10_ingest_with_embedding"], 1),
            # per order: few distinct filter sets, answered once each; per customer: all distinct, half of them names
            "standard_search_requests_per_s": round(2 * n_customers / times["c9_batch_search_per_customer"], 1),
            "standard_search_repeated_requests_per_s": round(n_orders / times["c9_batch_search_per_order"], 1),
            "intent_resolution_queries_per_s": round(n_user / times["e5_resolve_intents"], 1),
            "agentic_dispatch_queries_per_s": round(n_user / times["g9_dispatch"], 1),
        },
        # burst of 100 requests on a local server; ours: whole request tables per plan
        "reference_requests_per_s": {"standard": 57.28, "semantic": 28.64, "agentic_dispatch": 9.55},
        "cold_first_run": cold,
        "config": {"master": f"local[{cpus}]", "shuffle_partitions": max(8, 2 * cpus), "aqe": True,
                   "timing": "best of 2 runs per query (warm JVM and Python workers)"},
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
