import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical

HARBOUR = [
    "Gulls circle above the harbour wall.",
    "The ferry leaves the harbour at noon.",
    "Noon bells ring over a quiet market.",
    "Fresh bread and salt cheese fill the market stalls.",
    "A ferry, a ferry! shouts the baker's child.",
    "Rain drums on slate roofs.",
]


def corpus(spark, docs):
    return spark.createDataFrame([(f"doc_{i}", i, t) for i, t in enumerate(docs)], "chunk_id string, pos int, text string")


def search(spark, docs, q, k=3, pad=False):
    idx = lexical.build_lexical_index(corpus(spark, docs), "chunk_id", "text", pos_col="pos")
    qs = spark.createDataFrame([("q", q)], "query_id string, query string")
    rows = lexical.bm25_search(idx, qs, k=k, pad_zero=pad).orderBy("rank").collect()
    return [(r["doc_id"], r["score"]) for r in rows]


def brute_force(docs, q, k1=1.5, b=0.75, eps=0.25):
    toks = [d.lower().split() for d in docs]
    n = len(toks)
    avgdl = sum(map(len, toks)) / n
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    avg = sum(idf.values()) / len(idf)
    idf = {w: (eps * avg if v < 0 else v) for w, v in idf.items()}
    out = []
    for t in toks:
        s = 0.0
        for w in q.lower().split():
            tf = t.count(w)
            s += idf.get(w, 0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avgdl))
        out.append(s)
    return out


def test_only_documents_with_a_query_term(spark):
    assert {d for d, _ in search(spark, HARBOUR, "slate roofs bread", k=6)} == {"doc_3", "doc_5"}


def test_rare_terms_lead(spark):
    assert search(spark, HARBOUR, "the gulls")[0][0] == "doc_0"


def test_score_by_hand(spark):
    """``slate`` stands once in one of two documents of 2 and 4 words: idf ln(1.5) - ln(1.5) = 0; of three
    documents: ln(2.5) - ln(1.5); lengths 2, 4, 3 and mean 3."""
    docs = ["slate roof", "rain on old roofs", "a quiet market"]
    idf = math.log(2.5) - math.log(1.5)
    got = search(spark, docs, "slate", k=3)
    assert len(got) == 1 and got[0][0] == "doc_0"
    assert abs(got[0][1] - idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 3))) < 1e-9


def test_padding_with_documents_that_do_not_match(spark):
    assert search(spark, HARBOUR, "violin concerto", k=4) == []
    assert search(spark, HARBOUR, "violin concerto", k=4, pad=True) == [(f"doc_{i}", 0.0) for i in range(4)]


@pytest.mark.parametrize("q", ["harbour ferry", "ferry ferry the noon", "the a on", "market"])
def test_scores_match_brute_force(spark, q):
    want = brute_force(HARBOUR, q)
    res = search(spark, HARBOUR, q, k=len(HARBOUR), pad=True)
    assert [d for d, _ in res] == [f"doc_{i}" for i in sorted(range(len(want)), key=lambda i: (-round(want[i], 9), i))]
    assert all(abs(s - want[int(d[4:])]) < 1e-9 for d, s in res)


def test_empty_corpus_raises(spark):
    empty = spark.createDataFrame([], "chunk_id string, text string")
    with pytest.raises(ValueError):
        lexical.build_lexical_index(empty, "chunk_id", "text")


def test_missing_index_path(spark):
    with pytest.raises(FileNotFoundError):
        lexical.load_lexical_index(spark, "/tmp/quarry-no-such-index-xyz")


def test_round_trip_and_checksum(spark):
    idx = lexical.build_lexical_index(corpus(spark, HARBOUR), "chunk_id", "text", pos_col="pos")
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-idx-", dir="/tmp"), "idx")
    lexical.save_lexical_index(idx, path)
    back = lexical.load_lexical_index(spark, path)
    qs = spark.createDataFrame([("q", "ferry market")], "query_id string, query string")
    a = lexical.bm25_search(idx, qs, k=5).collect()
    b = lexical.bm25_search(back, qs, k=5).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    # corrupt one table: checksum must fail
    bad = back.postings.limit(3)
    bad.write.mode("overwrite").parquet(path + "/postings_tmp")
    spark.read.parquet(path + "/postings_tmp").write.mode("overwrite").parquet(path + "/postings")
    with pytest.raises(ValueError):
        lexical.load_lexical_index(spark, path)


def test_changed_tokens_and_unreadable_tables_are_errors(spark):
    idx = lexical.build_lexical_index(corpus(spark, HARBOUR), "chunk_id", "text", pos_col="pos")
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-idx-", dir="/tmp"), "idx")
    lexical.save_lexical_index(idx, path)
    assert lexical.load_lexical_index(spark, path).tokens.count() == len(HARBOUR)
    spark.createDataFrame([("doc_0", ["other"])], "doc_id string, tokens array<string>").write.mode("overwrite").parquet(path + "/tokens")
    with pytest.raises(ValueError):
        lexical.load_lexical_index(spark, path)
    spark.range(1).selectExpr("'{broken' AS value").write.mode("overwrite").text(path + "/meta")
    with pytest.raises(json.JSONDecodeError):
        lexical.load_lexical_index(spark, path)


def test_doc_text(spark):
    idx = lexical.build_lexical_index(corpus(spark, HARBOUR), "chunk_id", "text", pos_col="pos")
    ids = spark.createDataFrame([("doc_0",), ("nope",)], "doc_id string")
    got = {r["doc_id"]: r["text"] for r in lexical.doc_text(idx, ids).collect()}
    assert got["doc_0"] == "gulls circle above the harbour wall."
    assert got["nope"] == ""
