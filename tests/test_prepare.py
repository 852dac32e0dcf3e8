import json
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import checks, prepare
from quarry.sources import readers


def chunk_ref(text, doc_id, mx, stride):
    toks = text.split()
    n = len(toks)
    if n <= mx:
        return [(f"{doc_id}_0" if doc_id else "0", text, n)]
    out, s, i = [], 0, 0
    while s < n:
        e = min(s + mx, n)
        out.append((f"{doc_id}_{i}" if doc_id else str(i), " ".join(toks[s:e]), e - s))
        i += 1
        if e >= n:
            break
        s += mx - stride
    return out


@pytest.mark.parametrize("n,mx,stride", [(10, 10, 3), (11, 10, 3), (60, 10, 3), (25, 10, 0), (0, 5, 1)])
def test_chunk_windows(spark, n, mx, stride):
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = [(r["chunk_id"], r["text"], r["tokens"]) for r in
           prepare.chunk_documents(df, mx, stride).orderBy("chunk_index").collect()]
    assert got == chunk_ref(text, "d", mx, stride)


def test_chunk_bad_stride(spark):
    df = spark.createDataFrame([("d", "a b")], "doc_id string, text string")
    with pytest.raises(ValueError):
        prepare.chunk_documents(df, 10, 10)


def test_chunk_offsets_substrings(spark):
    text = "One sentence here.  " * 20 + "\U0001F600 tail"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = prepare.chunk_offsets(df, 10, 3).orderBy("chunk_index").collect()
    assert rows[0]["start_char"] == 0
    for r in rows:
        assert text[r["start_char"]:r["end_char"]] == r["text"]
        assert len(r["text"].split()) == r["tokens"]
    assert rows[-1]["end_char"] == len(text)


@pytest.mark.parametrize("text", ["", "   ", " lead and trail  ", "a b c d e f g h i j k", "\u00a0a\u2003b  c\n\nd\te f ", "\U0001F600 " * 23, "x"])
@pytest.mark.parametrize("mx,stride", [(4, 1), (5, 0), (100, 10)])
def test_chunk_offsets_equal_slices_of_the_text(spark, text, mx, stride):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = [tuple(r) for r in prepare.chunk_offsets(df, mx, stride).orderBy("chunk_index").collect()]
    places = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    if len(places) <= mx:
        want = [("d_0", "d", 0, text, len(places), 0, len(text))]
    else:
        firsts = range(0, len(places) - stride, mx - stride)
        want = [(f"d_{i}", "d", i, text[places[f][0]:places[min(f + mx, len(places)) - 1][1]], min(mx, len(places) - f),
                 places[f][0], places[min(f + mx, len(places)) - 1][1]) for i, f in enumerate(firsts)]
    assert got == want


def test_explode_both_layouts(spark):
    qa = spark.createDataFrame(
        [("1", "q one", (["p a", "", "p c"], [0, 1])), (None, "q two", (["x"], [1])), ("3", "q3", None)],
        prepare.QA_SCHEMA)
    rows = prepare.explode_passages(qa).orderBy("query_id", "passage_idx").collect()
    got = [(r["query_id"], r["passage_idx"], r["doc_id"], r["text"], r["is_relevant"]) for r in rows]
    assert got == [("1", 0, "q1_p1", "p a", 0), ("1", 2, "q1_p2", "p c", 0), ("q two", 0, "qq two_p1", "x", 1)]
    lst = spark.createDataFrame([("1", "q", [("p a", 1), ("", 0), ("p c", None)])], prepare.QA_SCHEMA_LIST)
    got2 = [(r["doc_id"], r["is_relevant"]) for r in prepare.explode_passages(lst).orderBy("doc_id").collect()]
    assert got2 == [("q1_p1", 1), ("q1_p2", 0)]


def test_read_qa_jsonl_skips_malformed(spark):
    d = tempfile.mkdtemp(prefix="quarry-json-", dir="/tmp")
    p = os.path.join(d, "qa.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"query_id": "7", "query": "q", "passages": {"passage_text": ["a"], "is_selected": [1]}}) + "\n")
        f.write("{not json\n\n")
        f.write(json.dumps({"query": "no id", "passages": {"passage_text": ["b", "c"], "is_selected": [1]}}) + "\n")
    df = readers.read_qa_jsonl(spark, p)
    rows = sorted((r["query_id"], r["query"]) for r in df.collect())
    assert rows == [("7", "q"), ("no id", "no id")]
    ex = prepare.explode_passages(df)
    assert sorted((r["doc_id"], r["is_relevant"]) for r in ex.collect()) == [
        ("q7_p1", 1), ("qno id_p1", 1), ("qno id_p2", 0)]


def test_duplicates_and_required(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a"), (7, "b")],
                               "pos long, id string")
    r = checks.check_duplicates(df, "id", "pos").first()
    assert (r["total_ids"], r["num_duplicates"], r["has_duplicates"], r["duplicate_ids"]) == (2, 3, True, "a,a,b")
    req = {x["field"]: (x["missing"], x["schema_valid"]) for x in checks.check_required(df, ["id", "nope"]).collect()}
    assert req == {"id": (1, False), "nope": (7, False)}


def test_validate_requests(spark):
    df = spark.createDataFrame([("ok", 10, 20), ("", 10, 20), ("x" * 1001, 10, 20), ("ok", 0, 20), ("ok", 5, 201)],
                               "query string, k int, rerank_top_k int")
    got = [r["reason"] for r in checks.validate_requests(df).collect()]
    assert got == [None, "query too short", "query too long", "k out of range", "rerank_top_k out of range"]


def test_integrity_report_and_summary(spark):
    df = spark.createDataFrame([(1, "a", "t"), (2, "a", None)], "pos long, id string, text string")
    rep = checks.integrity_report(df, "ds", "train", "id", "pos", ["id", "text"], expected_count=2)
    assert [r["passed"] for r in rep.collect()] == [False] * 3
    s = checks.integrity_summary(rep).first()
    assert s["splits_failed"] == 1 and not s["passed"] and "duplicates" in s["errors"]


def test_take_first_and_catalog(spark, sf):
    cat = readers.Catalog(root=sf)
    cat.register("docs", {"all": "documents.parquet"})
    assert cat.read(spark, "docs", "all").count() > 0
    with pytest.raises(KeyError):
        cat.path("unknown", "all")


def test_chunk_default_ids(spark):
    df = spark.createDataFrame([(2, "c d"), (1, "a b")], "o int, text string")
    got = sorted((r["chunk_id"], r["text"]) for r in prepare.chunk_documents(df, 5, 1, id_col=None, order_col="o").collect())
    assert got == [("0_0", "a b"), ("1_0", "c d")]


def test_combine_title(spark):
    df = spark.createDataFrame([("T", "body"), ("", "body"), (None, "body")], "title string, text string")
    assert [r["text"] for r in prepare.combine_title(df).collect()] == ["T\nbody", "body", "body"]


def test_validate_encode_requests(spark):
    df = spark.createDataFrame([(["a"],), ([],), (["x"] * 101,), (None,)], "texts array<string>")
    assert [r["reason"] for r in checks.validate_encode_requests(df).collect()] == [
        None, "too few texts", "too many texts", "too few texts"]
