import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense, mining, relational


def test_search_rerank_top_k_smaller_than_k(spark):
    vecs = spark.createDataFrame([(i, [float(np.cos(i / 5)), float(np.sin(i / 5))]) for i in range(20)],
                                 "id long, embedding array<float>")
    corpus = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    req = spark.createDataFrame([
        ("a", [1.0, 0.0], 5, False, 3, "text 1"),
        ("b", [1.0, 0.0], 5, True, 3, "text 1"),   # rerank retrieves 3, returns 3 < k
        ("c", [1.0, 0.0], 2, True, 6, "text 1"),   # rerank over 6, cut to 2
    ], "query_id string, embedding array<float>, k int, rerank boolean, rerank_top_k int, query string")
    out = dense.search(req, vecs, corpus=corpus, scorer=dense.OverlapScorer())
    per = {q: sorted((r["rank"], r["doc_id"]) for r in out.filter(F.col("query_id") == q).collect()) for q in "abc"}
    assert [d for _, d in per["a"]] == [0, 1, 2, 3, 4]
    assert len(per["b"]) == 3 and len(per["c"]) == 2
    assert [r for r, _ in per["c"]] == [1, 2]
    assert all(r["text"].startswith("text") for r in out.collect())


def test_gated_rerank_importance(spark):
    run = spark.createDataFrame([("h", 1, 0.9, 1), ("h", 2, 0.8, 2), ("l", 1, 0.1, 1), ("n", 1, 0.1, 1), ("n", 2, 0.05, 2)],
                                "query_id string, doc_id long, score double, rank int")
    qs = spark.createDataFrame([("h", "abc"), ("l", "abc"), ("n", "abc")], "query_id string, query string")
    corpus = spark.createDataFrame([(1, "xyz"), (2, "abcd")], "doc_id long, text string")
    imp = spark.createDataFrame([("h", "high"), ("l", "low")], "query_id string, importance string")
    g = dense.gated_rerank(run, qs, corpus, threshold=0.6, importance=imp, k=10)
    reasons = {r["query_id"]: r["reason"] for r in g.collect()}
    assert reasons == {"h": "importance_high", "l": "importance_low", "n": "low_confidence"}
    top_n = g.filter("query_id = 'n' and rank = 1").first()["doc_id"]
    assert top_n == 2  # reranked by overlap with "abc"


def test_in_batch_negatives_exclude_own_and_cap(spark):
    q = spark.createDataFrame([(f"q{i}",) for i in range(10)], "query_id string")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i}", 1) for i in range(10)] + [("q0", "d1", 1)],
                                  "query_id string, doc_id string, rel int")
    n = mining.in_batch_negatives(q, qrels, batch_size=4, n=2, seed=1).collect()
    pos = {(f"q{i}", f"d{i}") for i in range(10)} | {("q0", "d1")}
    assert all((r["query_id"], r["doc_id"]) not in pos for r in n)
    counts = {}
    for r in n:
        counts[r["query_id"]] = counts.get(r["query_id"], 0) + 1
    assert max(counts.values()) <= 2


def test_ance_versioned_vectors(spark):
    qv = spark.createDataFrame([("q", [1.0, 0.0], 1), ("q", [0.0, 1.0], 2)], "id string, embedding array<float>, version int")
    dv = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 1), ("a", [1.0, 0.0], 2), ("b", [0.0, 1.0], 2)],
                               "id string, embedding array<float>, version int")
    cands = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, teacher_rank int")
    qrels = spark.createDataFrame([], "query_id string, doc_id string, rel int")
    v1 = mining.mine_ance(cands, qrels, qv, dv, margin=0.1, k=1, version=1).first()["doc_id"]
    v2 = mining.mine_ance(cands, qrels, qv, dv, margin=0.1, k=1, version=2).first()["doc_id"]
    assert (v1, v2) == ("a", "b")


def test_assign_batches_and_global_row_number(spark):
    df = spark.range(1000).withColumnRenamed("id", "qid").repartition(7)
    b = relational.assign_batches(df, "qid", batch_size=32, seed=3).collect()
    sizes = {}
    for r in b:
        sizes[r["batch_id"]] = sizes.get(r["batch_id"], 0) + 1
    assert sorted(sizes) == list(range(32)) and sum(sizes.values()) == 1000
    assert all(v == 32 for k, v in sizes.items() if k < 31) and sizes[31] == 1000 - 31 * 32
    g = relational.global_row_number(df, ["qid"], "rn").collect()
    assert sorted(r["rn"] for r in g) == list(range(1, 1001)) and all(r["rn"] == r["qid"] + 1 for r in g)


def test_search_through_ivf_full_probe_equals_exact(spark):
    from quarry.operators import ann
    rng = np.random.default_rng(4)
    V = rng.normal(size=(120, 4))
    vecs = spark.createDataFrame([(i, [float(x) for x in V[i]]) for i in range(120)], "id long, embedding array<float>")
    req = spark.createDataFrame([(f"r{i}", [float(x) for x in V[i]], 3) for i in range(10)],
                                "query_id string, embedding array<float>, k int")
    ivf = ann.build_ivf(vecs, nlist=4, seed=1)
    a = {(r["query_id"], r["doc_id"], r["rank"]) for r in dense.search(req, vecs).collect()}
    b = {(r["query_id"], r["doc_id"], r["rank"]) for r in dense.search(req, None, ivf=ivf, nprobe=4).collect()}
    assert a == b and len(a) == 30
