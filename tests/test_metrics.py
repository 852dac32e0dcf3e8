import math

import numpy as np
import pytest

from quarry.operators import metrics


def run_df(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, score double, rank bigint")


def qrels_df(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, rel int")


def ndcg_ref(labels, k):
    r = np.array(labels[:k], dtype=float)
    if len(r) == 0:
        return 0.0
    disc = np.log2(np.arange(2, len(r) + 2))
    idcg = np.sum(np.sort(r)[::-1] / disc)
    return 0.0 if idcg == 0 else float(np.sum(r / disc) / idcg)


def test_retrieval_metrics_against_reference_formulas(spark):
    run = run_df(spark, [("a", "d1", 3.0, 1), ("a", "d2", 2.0, 2), ("a", "d3", 1.0, 3),
                         ("b", "x1", 1.0, 1), ("b", "x2", 0.5, 2)])
    qrels = qrels_df(spark, [("a", "d2", 1), ("a", "d9", 1), ("b", "x1", 1), ("c", "z", 1)])
    m = {(r["metric"], r["k"]): r["value"] for r in metrics.retrieval_metrics(run, qrels, (1, 2, 10)).collect()}
    la, lb = [0, 1, 0], [1, 0]
    for k in (1, 2, 10):
        assert m[("ndcg", k)] == pytest.approx((ndcg_ref(la, k) + ndcg_ref(lb, k)) / 2)
    assert m[("mrr", 10)] == pytest.approx((0.5 + 1.0) / 2)
    assert m[("mrr", 1)] == pytest.approx(0.5)
    assert m[("recall", 10)] == pytest.approx((0.5 + 1.0) / 2)
    assert m[("precision", 2)] == pytest.approx((1 / 2 + 1 / 2) / 2)


def test_no_relevant_and_k0(spark):
    run = run_df(spark, [("a", "d1", 1.0, 1)])
    qrels = qrels_df(spark, [("zz", "q", 1)])
    m = {(r["metric"], r["k"]): r["value"] for r in metrics.retrieval_metrics(run, qrels, (0, 5)).collect()}
    assert m[("recall", 5)] == 0.0 and m[("precision", 0)] == 0.0 and m[("ndcg", 5)] == 0.0


def test_duplicate_retrieved_counts_once(spark):
    run = run_df(spark, [("a", "d1", 2.0, 1), ("a", "d1", 1.0, 2)])
    qrels = qrels_df(spark, [("a", "d1", 1)])
    m = {(r["metric"], r["k"]): r["value"] for r in metrics.retrieval_metrics(run, qrels, (2,)).collect()}
    assert m[("precision", 2)] == 0.5 and m[("recall", 2)] == 1.0


def ece_ref(conf, acc, n_bins=10):
    b = np.linspace(0, 1, n_bins + 1)
    e = 0.0
    for i in range(n_bins):
        m = (conf > b[i]) & (conf <= b[i + 1])
        if m.mean() > 0:
            e += abs(conf[m].mean() - acc[m].mean()) * m.mean()
    return e


def test_ece_edges(spark):
    conf = np.array([0.0, 0.1, 1.0, 0.3, 0.35, 0.7, 0.2, 0.9999])
    acc = np.array([1, 0, 1, 1, 0, 1, 0, 1], dtype=float)
    df = spark.createDataFrame([(float(c), float(a)) for c, a in zip(conf, acc)], "confidence double, accuracy double")
    got = metrics.ece(df).first()["ece"]
    assert got == pytest.approx(ece_ref(conf, acc))


def test_kendall_tau(spark):
    a = run_df(spark, [("q", d, 0.0, i + 1) for i, d in enumerate(["a", "b", "c", "d"])])
    b = run_df(spark, [("q", d, 0.0, i + 1) for i, d in enumerate(["b", "a", "c", "x"])])
    got = metrics.kendall_tau(a, b).first()["tau"]
    # common a,b,c: ranks (0,1,2) vs (1,0,2): one discordant of three pairs
    assert got == pytest.approx(1 / 3)
    one = run_df(spark, [("q", "a", 0.0, 1)])
    assert metrics.kendall_tau(one, one).first()["tau"] == 0.0


def test_risk_coverage(spark):
    rng = np.random.default_rng(0)
    scores = rng.random(257)
    labels = (rng.random(257) > 0.4).astype(float)
    df = spark.createDataFrame([(i, float(s), float(l)) for i, (s, l) in enumerate(zip(scores, labels))],
                               "id long, score double, label double")
    got = metrics.risk_coverage(df, "score", "label", 100, id_col="id").orderBy("point").collect()
    order = np.argsort(-scores, kind="stable")
    sl = labels[order]
    cov = np.arange(1, 258) / 257
    acc = np.cumsum(sl) / np.arange(1, 258)
    idx = np.linspace(0, 256, 100, dtype=int)
    assert [r["coverage"] for r in got] == pytest.approx(list(cov[idx]))
    assert [r["accuracy"] for r in got] == pytest.approx(list(acc[idx]))


def test_exact_quantiles_match_numpy(spark):
    from quarry.operators.relational import exact_quantiles
    rng = np.random.default_rng(7)
    vals = {g: rng.normal(size=int(rng.integers(1, 40))) for g in "abcd"}
    df = spark.createDataFrame([(g, float(v)) for g, vs in vals.items() for v in vs], "g string, x double")
    got = {r["g"]: (r["p50"], r["p95"]) for r in exact_quantiles(df, "x", ["g"], (0.5, 0.95)).collect()}
    for g, vs in vals.items():
        assert got[g] == pytest.approx((np.percentile(vs, 50), np.percentile(vs, 95)))
    allv = np.concatenate(list(vals.values()))
    r = exact_quantiles(df, "x", [], (0.5, 0.99)).first()
    assert (r["p50"], r["p99"]) == pytest.approx((np.percentile(allv, 50), np.percentile(allv, 99)))


def test_kendall_tau_of_long_lists_equals_all_pairs(spark):
    import random

    r = random.Random(3)
    rows_a, rows_b, want = [], [], {}
    for q, n in (("long", 700), ("two", 2), ("eight", 8)):
        x, y = list(range(n)), list(range(n))
        r.shuffle(x)
        r.shuffle(y)
        rows_a += [(q, d, x[d] + 1) for d in range(n)]
        rows_b += [(q, d, y[d] + 1) for d in range(n)]
        s = sum((1 if (x[i] - x[j]) * (y[i] - y[j]) > 0 else -1) for i in range(n) for j in range(i))
        want[q] = s / (n * (n - 1) / 2)
    rows_a.append(("alone", 1, 1))
    want["alone"] = 0.0
    schema = "query_id string, doc_id long, rank int"
    got = metrics.kendall_tau(spark.createDataFrame(rows_a, schema), spark.createDataFrame(rows_b, schema)).collect()
    assert {g["query_id"]: pytest.approx(g["tau"], abs=1e-12) for g in got} == want


def test_a_repeated_document_counts_once(spark):
    run = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "a", 0.9, 2), ("q", "b", 0.8, 3)], "query_id string, doc_id string, score double, rank int")
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "b", 1)], "query_id string, doc_id string, rel int")
    row = metrics.per_query_metrics(run, qrels, (2, 3)).first()
    assert (row["recall_2"], row["recall_3"]) == (0.5, 1.0)
    assert (row["precision_2"], row["precision_3"]) == pytest.approx((0.5, 2 / 3))
