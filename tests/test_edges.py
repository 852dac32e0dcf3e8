"""Edge cases from FIXTURES.md part C."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import dense, lexical, mining, relational, training
from quarry.streaming import requests as rq


def corpus(spark, docs):
    return spark.createDataFrame([(f"d{i}", i, t) for i, t in enumerate(docs)], "doc_id string, pos int, text string")


def scores_of(spark, docs, q, k=10, pad=False):
    idx = lexical.build_lexical_index(corpus(spark, docs), "doc_id", "text", pos_col="pos")
    qs = spark.createDataFrame([("q", q)], "query_id string, query string")
    return [(r["doc_id"], r["score"]) for r in lexical.bm25_search(idx, qs, k=k, pad_zero=pad).orderBy("rank").collect()]


def test_bm25_repeated_query_term_doubles(spark):
    docs = ["apple pie", "banana split", "cherry tart", "plum jam"]
    one = dict(scores_of(spark, docs, "apple"))
    two = dict(scores_of(spark, docs, "apple apple"))
    assert two["d0"] == pytest.approx(2 * one["d0"])


def test_bm25_idf_zero_and_negative_floor(spark):
    # "x" in 2 of 4 docs: idf = ln(2.5) - ln(2.5) = 0 -> no match;
    # "y" in 3 of 4 docs: negative idf -> epsilon * avg_idf
    docs = ["x y a", "x y b", "y c", "d"]
    assert scores_of(spark, docs, "x") == []
    idx = lexical.build_lexical_index(corpus(spark, docs), "doc_id", "text", pos_col="pos")
    raw = {r["term"]: r["idf"] for r in idx.terms.collect()}
    vals = [math.log(4 - df + 0.5) - math.log(df + 0.5) for df in (2, 3, 1, 1, 1, 1)]
    avg = sum(vals) / len(vals)
    assert raw["x"] == 0.0 and raw["y"] == pytest.approx(0.25 * avg)


def test_bm25_empty_document_counts(spark):
    idx = lexical.build_lexical_index(corpus(spark, ["a b", "", "c"]), "doc_id", "text", pos_col="pos")
    assert idx.stats["N"] == 3 and idx.stats["avgdl"] == pytest.approx(1.0)
    assert {r["doc_id"]: r["dl"] for r in idx.docs.collect()}["d1"] == 0


def test_bm25_ties_in_corpus_order_and_k_larger_than_rows(spark):
    docs = ["same words", "same words", "other"]
    res = scores_of(spark, docs, "same", k=10)
    assert [d for d, _ in res] == ["d0", "d1"]
    # "same" is in 2 of 3 docs: negative idf, and the floor eps * avg_idf is
    # negative too (avg_idf < 0), so the matches score below zero and the
    # zero-score document comes first when padding
    assert all(s < 0 for _, s in res)
    padded = scores_of(spark, docs, "same", k=10, pad=True)
    assert [d for d, _ in padded] == ["d2", "d0", "d1"]
    docs4 = ["same words", "same words", "other", "more text"]
    assert [d for d, _ in scores_of(spark, docs4, "same", k=10, pad=True)] == ["d0", "d1", "d2", "d3"]


def test_top_k_null_scores_last(spark):
    df = spark.createDataFrame([("q", "a", None), ("q", "b", 1.0), ("q", "c", 1.0)], "query_id string, doc_id string, score double")
    r = relational.top_k_per_group(df, ["query_id"], relational.score_order(), 2).orderBy("rank").collect()
    assert [x["doc_id"] for x in r] == ["b", "c"]


def _vec(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>")


def test_ance_without_positives_uses_zero(spark):
    qv = _vec(spark, [("q1", [1.0, 0.0])])
    dv = _vec(spark, [("a", [0.5, 0.0]), ("b", [-0.5, 0.0]), ("c", [0.0, 0.0])])
    cands = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3)], "query_id string, doc_id string, teacher_rank int")
    qrels = spark.createDataFrame([], "query_id string, doc_id string, rel int")
    got = [r["doc_id"] for r in mining.mine_ance(cands, qrels, qv, dv, margin=0.1, k=5).orderBy("ance_rank").collect()]
    assert got == ["a", "c"]  # score >= 0 - 0.1


def test_all_candidates_positive_and_missing_text(spark):
    docs = corpus(spark, ["alpha beta", "alpha gamma"])
    idx = lexical.build_lexical_index(docs, "doc_id", "text", pos_col="pos")
    q = spark.createDataFrame([("q", "alpha")], "query_id string, query string")
    qrels = spark.createDataFrame([("q", "d0", 1), ("q", "d1", 1)], "query_id string, doc_id string, rel int")
    assert mining.mine_bm25(idx, q, qrels, k=10).count() == 0
    cands = spark.createDataFrame([("q", "nope", 1)], "query_id string, doc_id string, bm25_rank int")
    t = mining.mine_teacher(cands, q, docs.select("doc_id", "text"), k=5, threshold=0.0).collect()
    assert len(t) == 1 and t[0]["teacher_score"] == 0.0  # "" text


def test_stage_union_keeps_teacher_score(spark):
    t = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2)], "query_id string, doc_id string, teacher_score double, teacher_rank int")
    a = spark.createDataFrame([("q", "b"), ("q", "c")], "query_id string, doc_id string")
    got = {r["doc_id"]: r["teacher_score"] for r in mining.combine_stages(t, a).collect()}
    assert got == {"a": 0.9, "b": 0.8, "c": 0.0}


def test_losses_single_document(spark):
    df = spark.createDataFrame([("q", 0, 3.0, -2.0)], "query_id string, pos long, student double, teacher double")
    r = training.kd_loss(df, 2.0).first()
    assert r["margin_mse"] == 0.0 and r["listwise_kd"] == pytest.approx(0.0) and r["contrastive"] == pytest.approx(0.0)


def test_listwise_teacher_probability_zero(spark):
    df = spark.createDataFrame([("q", 0, 0.0, 0.0), ("q", 1, 0.0, -5000.0)], "query_id string, pos long, student double, teacher double")
    kl = training.listwise_kl(df, 1.0).first()["listwise_kd"]
    assert kl == pytest.approx(math.log(2))  # p_t = (1, 0), p_s = (.5, .5)


def test_bucket_equal_timestamps_ordered_by_id(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, client long")
    d = {r["event_id"]: r["allowed"] for r in rq.token_bucket(df, rpm=1, burst=2, idle_seconds=None).collect()}
    assert d == {0: True, 1: True, 2: False}


def test_stream_late_row_dropped(spark, tmp_path):
    import pandas as pd
    base = dt.datetime(2024, 1, 1)
    d = tmp_path / "in"
    d.mkdir()
    pd.DataFrame({"ts": [base, base + dt.timedelta(hours=3)], "status": [200, 500]}).to_parquet(d / "a.parquet", coerce_timestamps="us")
    schema = spark.read.parquet(str(d)).schema
    name = "late_test"
    agg = rq.error_rate(spark.readStream.schema(schema).parquet(str(d)), "1 hour", "1 hour", watermark="10 minutes")
    q = agg.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    # a row for the first hour arriving after the watermark moved past it
    pd.DataFrame({"ts": [base + dt.timedelta(minutes=5)], "status": [500]}).to_parquet(d / "b.parquet", coerce_timestamps="us")
    pd.DataFrame({"ts": [base + dt.timedelta(hours=6)], "status": [200]}).to_parquet(d / "c.parquet", coerce_timestamps="us")
    q.processAllAvailable()
    q.stop()
    rows = {r["window_start"]: r["requests"] for r in spark.sql(f"select * from {name}").collect()}
    assert rows[base] == 1  # the late row was dropped


def test_containment_pairs_brute_force(spark):
    from quarry.plans.standins import containment_pairs
    docs = ["alpha beta gamma delta epsilon", "x alpha beta gamma", "gamma delta epsilon zeta",
            "beta gamma", "prefixalpha beta gamma deltasuffix", "a b c d e f a b c d e f", ""]
    items = ["alpha beta gamma", "beta gamma", "gamma delta epsilon zeta", "a b c d", "c d e f a",
             "nothing here at all", "alpha beta gamma delta", "pha beta gamma del"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]) for r in containment_pairs(i, d).collect()}
    want = {(qi, di) for qi, q in enumerate(items) for di, t in enumerate(docs) if q in t}
    assert got == want


def test_term_stats_and_maxsim(spark):
    postings = spark.createDataFrame([("a", "d0"), ("a", "d1"), ("a", "d2"), ("b", "d0"), ("c", "d1")],
                                     "term string, doc_id string")
    terms, avg_idf, vocab = lexical.term_stats(postings, 4, 0.25)
    raw = {"a": math.log(4 - 3 + 0.5) - math.log(3.5), "b": math.log(3.5) - math.log(1.5)}
    raw["c"] = raw["b"]
    avg = sum(raw.values()) / 3
    got = {r["term"]: (r["df"], r["idf"]) for r in terms.collect()}
    assert vocab == 3 and avg_idf == pytest.approx(avg)
    assert got["a"] == (3, pytest.approx(0.25 * avg)) and got["b"] == (1, pytest.approx(raw["b"]))
    run = spark.createDataFrame([("q", "doc1_0", 0.5), ("q", "doc1_1", 0.9), ("q", "doc_2_0", 0.3)],
                                "query_id string, doc_id string, score double")
    ms = {r["doc_id"]: r["score"] for r in relational.maxsim(run).collect()}
    assert ms == {"doc1": 0.9, "doc_2": 0.3}
