"""Benchmark of the headline operator families.

Runs each query to completion with the ``noop`` sink (full execution, no
driver collect) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints
one JSON line: total seconds, per-query seconds (median of
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))


def main():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("quarry-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(max(4, int(CPUS) * 2)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from quarry.operators import ann, dense, lexical, metrics, mining, prepare
    from quarry.plans import standins as st
    from quarry.session import checkpoint_dir, ship_package

    ship_package(spark)
    from quarry.streaming import requests as rq

    scratch = os.path.join(checkpoint_dir(spark), f"bench-{os.getpid()}")

    corpus = st.corpus(spark, SF_DIR)
    queries = st.queries_a(spark, SF_DIR)
    vec = st.vectors(spark, SF_DIR)
    counts = {
        "documents": corpus.count(), "queries": queries.count(), "vectors": vec.count(),
        "events": st.table(spark, SF_DIR, "events").count(),
    }
    idx_holder = {}
    # inputs that a user would already have as tables: the qrels stand-in is
    # derived once (timed separately) and written
    t0 = time.perf_counter()
    st.qrels_a(spark, SF_DIR).write.mode("overwrite").parquet(os.path.join(scratch, "qrels"))
    qrels_s = time.perf_counter() - t0
    qrels = spark.read.parquet(os.path.join(scratch, "qrels"))

    def chunk():
        return prepare.chunk_documents(corpus, 512, 80)

    def build():
        # L1 + S7: build and write the index tables, then reload them
        path = os.path.join(scratch, f"index-{uuid.uuid4().hex}")
        idx_holder["idx"] = lexical.build_lexical_index(corpus, "doc_id", "text", keep_tokens=False, path=path)
        return idx_holder["idx"].postings.limit(0)

    def search():
        return lexical.bm25_search(idx_holder["idx"], queries, k=100)

    def flat():
        return dense.flat_search(vec.withColumnRenamed("id", "query_id"), vec, k=10, exclude_self=True)

    # approximate indexes are built once (KMeans training), timed as setup
    approx = {}
    t0 = time.perf_counter()
    approx["ivf"] = ann.build_ivf(vec, nlist=16, seed=7)
    ivf_build_s = time.perf_counter() - t0
    t0 = time.perf_counter()
    approx["pq"] = ann.build_pq(vec, m=16, nbits=6, seed=7)
    pq_build_s = time.perf_counter() - t0

    def ivf():
        return ann.ivf_search(vec.withColumnRenamed("id", "query_id"), approx["ivf"], k=10, nprobe=14,
                              exclude_self=True)

    def pq():
        cand = ann.pq_search(vec.withColumnRenamed("id", "query_id"), approx["pq"], k=100, exclude_self=True)
        return dense.rescore(cand, vec, vec, 10)

    def mine():
        n1 = mining.mine_bm25(idx_holder["idx"], queries, qrels, k=100)
        return mining.mine_teacher(n1, queries, corpus, k=10, threshold=0.25)

    def evaluate():
        run = lexical.bm25_search(idx_holder["idx"], queries, k=100)
        return metrics.retrieval_metrics(run, qrels, (10, 50, 100), queries=queries)

    def errors():
        return rq.error_rate(st.requests(spark, SF_DIR), "5 minutes", "1 minute")

    def bucket():
        return rq.token_bucket(st.requests(spark, SF_DIR), rpm=60 / 21600, burst=2, idle_seconds=28800.0)

    plan = [("P5_chunk", chunk), ("L1_build_index", build), ("L4_bm25_search", search),
            ("D3_flat_search", flat), ("D4_ivf_search", ivf), ("D5_pq_search_rescore", pq),
            ("N1N2_mining", mine), ("M8_metrics", evaluate),
            ("R3_error_rate", errors), ("R1_token_bucket", bucket)]
    # untimed warm-up: JIT and codegen of the common operators
    prepare.chunk_documents(corpus.limit(200), 512, 80).write.format("noop").mode("overwrite").save()
    lexical.build_lexical_index(corpus.limit(200), "doc_id", "text", keep_tokens=False).postings \
        .write.format("noop").mode("overwrite").save()
    times, sizes = {}, {}
    for name, fn in plan:
        runs = []
        for _ in range(REPEAT):
            t0 = time.perf_counter()
            df = fn()
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
        if name in ("L1_build_index",):
            sizes[name] = idx_holder["idx"].postings.agg(F.sum(F.size("docs"))).first()[0]
    exact = flat()
    recall = {name: round(dense.validate_recall(fn(), exact, 10).first()["recall"], 4)
              for name, fn in (("D4_ivf", ivf), ("D5_pq", pq))}
    thr = {
        "chunked_docs_per_s": counts["documents"] / times["P5_chunk"],
        "postings_per_s": sizes["L1_build_index"] / times["L1_build_index"],
        "query_doc_scores_per_s_bm25": counts["queries"] * counts["documents"] / times["L4_bm25_search"],
        "query_doc_scores_per_s_dense": counts["vectors"] ** 2 / times["D3_flat_search"],
        "events_per_s_error_rate": counts["events"] / times["R3_error_rate"],
        "events_per_s_token_bucket": counts["events"] / times["R1_token_bucket"],
        # amortised per-query cost of a batch (compare with the reference's online latency table)
        "bm25_ms_per_query_top100": 1000.0 * times["L4_bm25_search"] / counts["queries"],
        "exact_dense_ms_per_query_top10": 1000.0 * times["D3_flat_search"] / counts["vectors"],
        "ivf_ms_per_query_top10": 1000.0 * times["D4_ivf_search"] / counts["vectors"],
    }
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(times.values()) + qrels_s + ivf_build_s + pq_build_s, 3),
        "unit": "sec",
        "queries": times | {"setup_qrels": round(qrels_s, 3), "setup_ivf_build": round(ivf_build_s, 3), "setup_pq_build": round(pq_build_s, 3)},
        "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
        "cpus": int(CPUS),
        "throughput": {k: round(v, 3) for k, v in thr.items()},
        "rows": counts,
        "setup_seconds": {"standin_qrels": round(qrels_s, 3), "ivf_build": round(ivf_build_s, 3),
                          "pq_build": round(pq_build_s, 3)},
        "recall_at_10_vs_exact": recall,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
