"""Write the formatted physical plans of the headline operators to PLANS.md.

usage: python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.operators import ann, dense, lexical, metrics, mining  # noqa: E402
from quarry.plans import standins as st  # noqa: E402
from quarry.session import get_session  # noqa: E402
from quarry.streaming import requests as rq  # noqa: E402

KEEP = ("Scan", "PushedFilters", "ReadSchema", "Join", "Exchange", "WindowGroupLimit", "Window",
        "MapInPandas", "FlatMapCoGroupsInPandas", "HashAggregate", "Generate", "BroadcastExchange",
        "AdaptiveSparkPlan", "InMemory", "Sort ")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head, _, details = text.partition("\n\n")
    picked = [ln if len(ln) < 300 else ln[:300] + " ...]" for ln in details.splitlines()
              if ln.startswith(("PushedFilters", "ReadSchema"))]
    return head + "\n\n" + "\n".join(sorted(set(picked)))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session()
    corpus, queries, vec = st.corpus(spark, sf), st.queries_a(spark, sf), st.vectors(spark, sf)
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-plans-", dir="/tmp"), "index")
    idx = lexical.build_lexical_index(corpus, "doc_id", "text", keep_tokens=False)
    lexical.save_lexical_index(idx, path)
    idx = lexical.load_lexical_index(spark, path, verify=False)
    run = lexical.bm25_search(idx, queries, k=100)
    q = vec.withColumnRenamed("id", "query_id")
    ivf = ann.build_ivf(vec, nlist=16, seed=7)
    sections = [
        ("L4 BM25 search over a saved index (top-100)", run),
        ("D3 exact dense search, broadcast path", dense.flat_search(q, vec, k=10, exclude_self=True)),
        ("D3 exact dense search in blocks of queries (the last block reads what was written)", dense.flat_search(q, vec, k=10, exclude_self=True,
                                                                         max_query_rows=0, block_rows=500)),
        ("D4 IVF search (sharded cells)", ann.ivf_search(q, ivf, k=10, nprobe=12, exclude_self=True)),
        ("M8 retrieval metrics", metrics.retrieval_metrics(run, st.qrels_a(spark, sf), (10, 50, 100))),
        ("N1 -> N2 mining (BM25 candidates minus positives, teacher top-10)",
         mining.mine_teacher(mining.mine_bm25(idx, queries, st.qrels_a(spark, sf), k=100), queries, corpus,
                             k=10, threshold=0.25)),
        ("R1 token bucket", rq.token_bucket(st.requests(spark, sf), rpm=60 / 21600, burst=2, idle_seconds=28800.0)),
        ("R4 exact latency quantiles per window (rank positions)",
         rq.latency_quantiles(st.requests(spark, sf), "1 hour", by=["event_type"])),
    ]
    out = ["# Physical plans of the headline operators", "",
           f"Generated by `scripts/explain_plans.py` on `{sf}` (tree of `explain('formatted')` plus the "
           "pushed filters and read schemas of every scan).", ""]
    for title, df in sections:
        out += [f"## {title}", "", "```", plan(df).rstrip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
